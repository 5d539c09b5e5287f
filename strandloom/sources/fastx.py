"""FASTA and FASTQ as DataFrames: file_idx, read_num, fmt, header, seq, qual (and mates).

FASTA is read by splitting on the header mark, so records may span any number of lines.
FASTQ is a strict four-line grammar whose quality lines may begin like headers, so its
records are found by line number: a line's place in the file is its place in its
partition and the lines of earlier partitions, which needs one counting pass; only the
four lines of a FASTQ record then meet in a shuffle.
Gzipped files (also of several members) are read by the Hadoop codec.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNIFF_BYTES = 4096
READ_COLUMNS = ("file_idx", "read_num", "fmt", "header", "seq", "qual")


def sniff(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(fasta or fastq, whether it is gzipped), from the first SNIFF_BYTES of the (first) file."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(at) or []
    files = [s.getPath() for f in found for s in (system.listStatus(f.getPath()) if f.isDirectory() else [f]) if s.getLen()]
    if not files:
        raise ValueError(f"{path}: no data")
    stream = system.open(files[0])
    try:
        head = bytes(stream.readNBytes(SNIFF_BYTES))
    finally:
        stream.close()
    zipped = head[:2] == b"\x1f\x8b"
    if zipped:
        head = zlib.decompressobj(31).decompress(head)
    first = head.lstrip()[:1]
    if first == b">":
        return "fasta", zipped
    if first == b"@":
        return "fastq", zipped
    raise ValueError(f"{path}: neither FASTA nor FASTQ")


def read_fasta(spark: SparkSession, path: str, file_idx: int = 0) -> DataFrame:
    """Records of a FASTA file in file order; blank lines and trailing white space go."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\r", "")
    split = raw.select(body.alias("body")).where(F.trim("body") != "").select(numbered("line"), "body")
    header = F.regexp_replace(F.substring_index("body", "\n", 1), r"\s+$", "")
    seq = F.regexp_replace(F.expr("substring(body, length(substring_index(body, '\n', 1)) + 1)"), r"\s+", "")
    records = split.select("line", F.concat(F.lit(">"), header).alias("header"), seq.alias("seq"))
    return _ranked(records).select(F.lit(file_idx).alias("file_idx"), "read_num", F.lit("fasta").alias("fmt"), "header", "seq", F.lit(None).cast("string").alias("qual"))


def numbered(name: str):
    """Partition (from bit 33 on) and place in it: rises along a file."""
    return F.monotonically_increasing_id().alias(name)


def _ranked(records: DataFrame) -> DataFrame:
    """``line`` as a gapless read_num: one count for each partition of the scan, then an offset."""
    part = F.shiftright(F.col("line"), 33)
    rows = records.select("*", part.alias("_part"))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, base))
        base += counts[p]
    place = F.col("line").bitwiseAND((1 << 33) - 1)
    if len(offsets) <= 1:
        return rows.withColumn("read_num", place).drop("_part")
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _base long"))
    return rows.join(known, "_part").withColumn("read_num", place + F.col("_base")).drop("_part", "_base")


def read_fastq(spark: SparkSession, path: str, file_idx: int = 0) -> DataFrame:
    """Records of a FASTQ file in file order, four lines each; the third is dropped."""
    lines = spark.read.text(path).select(numbered("line"), "value")
    ranked = _ranked(lines).withColumnRenamed("read_num", "at")
    at = F.col("at") % 4
    pick = lambda k: F.max(F.when(at == k, F.regexp_replace("value", r"\s+$", "")))
    out = ranked.groupBy(F.floor(F.col("at") / 4).cast("long").alias("read_num")).agg(pick(0).alias("header"), pick(1).alias("seq"), pick(3).alias("qual"))
    return out.where("header <> ''").select(F.lit(file_idx).alias("file_idx"), "read_num", F.lit("fastq").alias("fmt"), "header", "seq", "qual")


def read_sequences(spark: SparkSession, path: str, file_idx: int = 0) -> DataFrame:
    fmt, _ = sniff(spark, path)
    return (read_fasta if fmt == "fasta" else read_fastq)(spark, path, file_idx)


def read_reads(spark: SparkSession, paths: Iterable[str], interleaved: bool = False) -> DataFrame:
    """Reads of one file, or the mates of two; pair_id and mate where they are paired, read_id always."""
    paths = list(paths)
    if not 1 <= len(paths) <= 2:
        raise ValueError("one or two files of reads")
    files = [read_sequences(spark, p, k) for k, p in enumerate(paths)]
    reads = files[0]
    if len(files) == 2:
        reads = reads.unionByName(files[1]).withColumns({"pair_id": F.col("read_num"), "mate": F.col("file_idx")})
    elif interleaved:
        reads = reads.withColumns({"pair_id": F.floor(F.col("read_num") / 2).cast("long"), "mate": (F.col("read_num") % 2).cast("int")})
    else:
        reads = reads.withColumns({"pair_id": F.lit(None).cast("long"), "mate": F.lit(0)})
    return reads.withColumn("read_id", F.concat_ws("_", "file_idx", "read_num"))


def unpaired(reads: DataFrame) -> DataFrame:
    """Reads of a pair whose mate is missing: empty for sound input."""
    pairs = reads.groupBy("pair_id").agg(F.countDistinct("mate").alias("mates"), F.count(F.lit(1)).alias("reads"))
    return pairs.where("mates <> 2 OR reads <> 2")


def read_stats(reads: DataFrame, length: Column | None = None) -> DataFrame:
    """One row: reads, total, least, largest and mean length (of ``seq``, where it is not given)."""
    n = (F.length("seq") if length is None else length).cast("long")
    total = reads.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(n), F.lit(0)).alias("total_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))
    return total.withColumn("mean_len", F.expr("CASE WHEN reads > 0 THEN total_len DIV reads END"))


def too_long(reads: DataFrame, limit: int) -> DataFrame:
    return reads.where(F.length("seq") > limit)


def references(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """db, ref_num, ref_id, header, seq, len of all reference files; equal paths count once."""
    from strandloom.functions.encode import display_id

    out = None
    for db, path in enumerate(dict.fromkeys(paths)):
        own = read_sequences(spark, path).select(F.lit(db).alias("db"), F.col("read_num").alias("ref_num"), display_id(F.col("header")).alias("ref_id"), "header", "seq", F.length("seq").alias("len"))
        out = own if out is None else out.unionByName(own)
    return out
