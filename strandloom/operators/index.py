"""The seed index as tables.

Every (L + 1)-mer of a reference gives two seed entries, its first half with the next
L / 2 + 1 letters and its last half with the first ones reversed; both carry the code of
the L-mer prefix. Positions list where each L-mer prefix occurs. Tables are partitioned by
nothing but their keys: joins hash on the half, and a partition column db keeps
databases apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.functions.encode import index_alphabet, kmer_code

PART_MB_PER_KMER = 9.5e-6


def background(refs: DataFrame) -> DataFrame:
    """db, nt, n: letter counts of the references, N left out."""
    seq = index_alphabet(F.regexp_replace("seq", "N", ""))
    counts = [F.sum(F.length(seq) - F.length(F.replace(seq, F.lit(b)))).alias(b) for b in "ACGT"]
    wide = refs.groupBy("db").agg(*counts)
    return wide.select("db", F.expr("stack(4, 'A', A, 'C', C, 'G', G, 'T', T) AS (nt, n)"))


def totals(refs: DataFrame) -> DataFrame:
    return refs.groupBy("db").agg(F.count(F.lit(1)).alias("n_refs"), F.sum(F.length("seq").cast("long")).alias("total_len"), F.max(F.length("seq").cast("long")).alias("max_len"))


def check_lengths(refs: DataFrame, config: SearchConfig) -> None:
    """Raises when a reference is too short to hold a k-mer."""
    short = refs.where(F.length("seq") < config.kmer).select("ref_id", F.length("seq").alias("n")).first()
    if short is not None:
        raise ValueError(f"reference {short['ref_id']} of length {short['n']} is shorter than the seed length {config.kmer}")


def kmers(refs: DataFrame, config: SearchConfig) -> DataFrame:
    """db, ref_num, pos, kmer for every window of the references."""
    n = config.kmer
    coded = refs.where(F.length("seq") >= n).select("db", "ref_num", index_alphabet(F.col("seq")).alias("seq"))
    letters = F.col("seq").cast("binary")
    starts = F.sequence(F.lit(0), F.length("seq") - n, F.lit(config.interval))
    rows = F.transform(starts, lambda p: F.struct(p.alias("pos"), F.substring(letters, p + 1, F.lit(n)).cast("string").alias("kmer")))
    return coded.select("db", "ref_num", F.explode(rows).alias("x")).select("db", "ref_num", "x.*")


def entries(windows: DataFrame, config: SearchConfig) -> tuple[DataFrame, DataFrame]:
    """(forward, reverse) seed entries: db, half, tail, code; each once."""
    h = config.half
    code = kmer_code(F.substring("kmer", 1, config.seed)).alias("code")
    forward = windows.select("db", F.substring("kmer", 1, h).alias("half"), F.substring("kmer", h + 1, h + 1).alias("tail"), code)
    back = windows.select("db", F.substring("kmer", h + 2, h).alias("half"), F.reverse(F.substring("kmer", 1, h + 1)).alias("tail"), code)
    return forward.distinct(), back.distinct()


def positions(windows: DataFrame, config: SearchConfig) -> DataFrame:
    """db, code, ref_num, pos: the first ``max_pos`` places of each L-mer prefix (0: all)."""
    out = windows.select("db", kmer_code(F.substring("kmer", 1, config.seed)).alias("code"), "ref_num", "pos")
    if not config.max_pos:
        return out
    order = Window.partitionBy("db", "code").orderBy("ref_num", "pos")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= config.max_pos).drop("_n")


def parts(refs: DataFrame, config: SearchConfig) -> DataFrame:
    """db, ref_num, part: references dealt in order to index parts of bounded size.

    The greedy fold over a database's references reads only their lengths; it runs in one
    task for each database.
    """
    limit, n = config.part_mb, config.kmer

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, part = 0.0, 0
        for batch in batches:
            out = []
            for size in batch.column("len").to_pylist():
                mb = (size - n + 1) * PART_MB_PER_KMER
                if mb > limit:
                    out.append(None)  # alone over the limit: left out of the index
                    continue
                if used + mb > limit:
                    used, part = 0.0, part + 1
                used += mb
                out.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("db"), batch.column("ref_num"), pa.array(out, pa.int32())], ["db", "ref_num", "part"])

    rows = refs.select(F.col("db").cast("int").alias("db"), F.col("ref_num").cast("long").alias("ref_num"), F.length("seq").cast("long").alias("len"))
    ordered = rows.repartition("db").sortWithinPartitions("db", "ref_num")

    def by_db(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunks = None, []
        for batch in batches:
            for db in sorted(set(batch.column("db").to_pylist())):
                own = batch.filter(pa.compute.equal(batch.column("db"), db))
                if db != held and chunks:
                    yield from fold((held,), iter(chunks))
                    chunks = []
                held = db
                chunks.append(own)
        if chunks:
            yield from fold((held,), iter(chunks))

    return ordered.mapInArrow(by_db, "db int, ref_num long, part int")


def build(refs: DataFrame, config: SearchConfig, path: str) -> None:
    """Writes the index tables under ``path``, partitioned by database."""
    check_lengths(refs, config)
    windows = kmers(refs, config)
    forward, back = entries(windows, config)
    tables = {"forward": forward, "reverse": back, "positions": positions(windows, config), "references": refs, "parts": parts(refs, config)}
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy("db").parquet(f"{path}/{name}")


class SeedIndex:
    """The tables of an index, lazily made or read."""

    def __init__(self, refs: DataFrame, forward: DataFrame, back: DataFrame, places: DataFrame):
        self.refs, self.forward, self.back, self.places = refs, forward, back, places
        self.sent: dict = {}

    @classmethod
    def of(cls, refs: DataFrame, config: SearchConfig) -> SeedIndex:
        windows = kmers(refs, config)
        return cls(refs, *entries(windows, config), positions(windows, config))

    @classmethod
    def load(cls, spark, path: str) -> SeedIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("references"), read("forward"), read("reverse"), read("positions"))


def ready(spark, path: str) -> bool:
    """Whether all tables of an index are there, wholly written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("forward", "reverse", "positions", "references", "parts"):
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            return False
    return True


def ensure(refs: DataFrame, config: SearchConfig, path: str, mode: int = 2) -> SeedIndex:
    """The index at ``path``. mode 0: it must be there; 1: build it; 2: build it where it is missing."""
    spark = refs.sparkSession
    if mode == 1 or (mode == 2 and not ready(spark, path)):
        build(refs, config, path)
    elif not ready(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    return SeedIndex.load(spark, path)
