"""Reports: read files, tabular and pairwise alignments, SAM, clusters and the run summary.

Every report is a DataFrame of lines (or of rows with a line column); ``save_lines`` writes
them in parallel, optionally as gzip.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.functions.encode import align_alphabet, display_id, reverse_complement, sam_id
from strandloom.functions.stats import bit_score, e_value

_WIDTH = 60


def clipped_cigar() -> Column:
    """CIGAR with soft clips for the unaligned ends of the read."""
    after = F.col("read_len") - F.col("read_end") - 1
    head = F.when(F.col("read_begin") > 0, F.concat(F.col("read_begin").cast("string"), F.lit("S"))).otherwise("")
    tail = F.when(after > 0, F.concat(after.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(head, "cigar", tail)


def sequence_in_strand(seq: Column, strand: Column) -> Column:
    return F.when(strand, align_alphabet(seq)).otherwise(reverse_complement(align_alphabet(seq)))


def fastx_lines(reads: DataFrame) -> DataFrame:
    """The text of each read: two lines, or four with a quality."""
    text = F.when(F.col("qual").isNull(), F.concat_ws("\n", "header", "seq")).otherwise(F.concat_ws("\n", F.col("header"), F.col("seq"), F.lit("+"), F.col("qual")))
    return reads.withColumn("line", text)


def save_lines(lines: DataFrame, path: str, zipped: bool = False, by: tuple[str, ...] = ()) -> None:
    """Writes the ``line`` column as text, in a folder for each value of ``by``."""
    out = lines.select(*by, "line").write.mode("overwrite").option("compression", "gzip" if zipped else "none")
    (out.partitionBy(*by) if by else out).text(path)


def output_name(prefix: str, file: str, fmt: str, zipped: bool) -> str:
    """prefix, the file's kind where there are several, and the format's suffix."""
    kind = "" if file == "all" else f"_{file}"
    return f"{prefix}{kind}.{'fa' if fmt == 'fasta' else 'fq'}{'.gz' if zipped else ''}"


def significant(x: float) -> str:
    """Three significant digits in the shortest form."""
    return f"{x:.3g}"


def blast_columns(rated: DataFrame, reads: DataFrame, refs: DataFrame, stats) -> DataFrame:
    """The twelve tabular columns as numbers, with cigar, qcov and qstrand. stats: a ScoreStats."""
    named = rated.join(reads.select("read_id", display_id(F.col("header")).alias("qseqid")), "read_id")
    named = named.join(refs.select("db", "ref_num", F.col("ref_id").alias("sseqid")), ["db", "ref_num"])
    total = F.col("matches") + F.col("mismatches") + F.col("gaps")
    return named.select(
        "qseqid", "sseqid", (F.col("matches") / total * 100).alias("pident"), (F.col("read_end") - F.col("read_begin") + 1).alias("length"), F.col("mismatches").alias("mismatch"), "gaps",
        (F.col("read_begin") + 1).alias("qstart"), (F.col("read_end") + 1).alias("qend"), (F.col("ref_begin") + 1).alias("sstart"), (F.col("ref_end") + 1).alias("send"),
        e_value(F.col("score"), stats.lam, stats.k, stats.full_ref, stats.full_read).alias("evalue"), bit_score(F.col("score"), stats.lam, stats.k).alias("bitscore"),
        clipped_cigar().alias("cigar"), ((F.col("read_end") - F.col("read_begin") + 1) / F.col("read_len") * 100).alias("qcov"), F.when(F.col("strand"), "+").otherwise("-").alias("qstrand"),
    )


def blast_lines(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tabular lines: twelve columns, then cigar, qcov and qstrand in the order asked for."""
    names = ["qseqid", "sseqid", "pident", "length", "mismatch", "gaps", "qstart", "qend", "sstart", "send", "evalue", "bitscore", *[x for x in extra if x in ("cigar", "qcov", "qstrand")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for n in names:
                values = batch.column(n).to_pylist()
                columns.append([significant(v) if n in ("pident", "evalue", "qcov") else str(v) for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(["\t".join(r) for r in zip(*columns, strict=True)], pa.string())], ["line"])

    return rows.select(*names).mapInArrow(run, "line string")


def null_rows(missed: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tabular rows for reads without an alignment: a star, zeros, and stars or zeros for what is added."""
    fill = {"cigar": "*", "qcov": "0", "qstrand": "*"}
    rest = [F.lit(fill[x]) for x in extra if x in fill]
    return missed.select("read_id", F.concat_ws("\t", display_id(F.col("header")), F.lit("*"), *[F.lit("0")] * 10, *rest).alias("line"))


def pairwise_text(name: str, ref_name: str, score: int, bits: int, expect: float, strand: bool, read: str, ref: str, read_begin: int, ref_begin: int, cigar: str) -> str:
    """One alignment as blocks of at most 60 columns: target, marks and query."""
    top, mid, low = [], [], []
    r, q = ref_begin, read_begin
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        size = int(n)
        if op == "M":
            a, b = ref[r : r + size], read[q : q + size]
            top.append(a)
            low.append(b)
            mid.append("".join("|" if x == y else "*" for x, y in zip(a, b, strict=True)))
            r, q = r + size, q + size
        elif op == "I":
            top.append("-" * size)
            mid.append(" " * size)
            low.append(read[q : q + size])
            q += size
        else:
            top.append(ref[r : r + size])
            mid.append(" " * size)
            low.append("-" * size)
            r += size
    rows = ["".join(x) for x in (top, mid, low)]
    out = [f"Sequence ID: {ref_name}", f"Query ID: {name}", f"Score: {score} bits ({bits})\tExpect: {significant(expect)}\tstrand: {'+' if strand else '-'}", ""]
    t, u = ref_begin + 1, read_begin + 1
    for at in range(0, len(rows[0]), _WIDTH):
        a, m, b = (x[at : at + _WIDTH] for x in rows)
        t_end, u_end = t + len(a) - a.count("-") - 1, u + len(b) - b.count("-") - 1
        out += [f"Target: {t:>8}    {a}    {t_end}", " " * 20 + m, f"Query: {u:>9}    {b}    {u_end}", ""]
        t, u = t_end + 1, u_end + 1
    return "\n".join(out)


def pairwise_lines(rated: DataFrame, reads: DataFrame, refs: DataFrame, stats) -> DataFrame:
    """Pairwise reports, one line value for each alignment."""
    rows = rated.join(reads.select("read_id", display_id(F.col("header")).alias("qname"), "seq"), "read_id")
    rows = rows.join(refs.select("db", "ref_num", "ref_id", align_alphabet(F.col("seq")).alias("rseq")), ["db", "ref_num"])
    rows = rows.select("qname", "ref_id", "score", bit_score(F.col("score"), stats.lam, stats.k).alias("bits"), e_value(F.col("score"), stats.lam, stats.k, stats.full_ref, stats.full_read).alias("expect"), "strand", sequence_in_strand(F.col("seq"), F.col("strand")).alias("read"), "rseq", "read_begin", "ref_begin", "cigar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pairwise_text(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["line"])

    return rows.mapInArrow(run, "line string")


def sam_rows(rated: DataFrame, reads: DataFrame, refs: DataFrame) -> DataFrame:
    """SAM columns of each alignment."""
    rows = rated.join(reads.select("read_id", sam_id(F.col("header")).alias("qname"), "seq", "qual"), "read_id").join(refs.select("db", "ref_num", sam_id(F.col("header")).alias("rname")), ["db", "ref_num"])
    qual = F.coalesce(F.when(F.col("strand"), F.col("qual")).otherwise(F.reverse("qual")), F.lit("*"))
    return rows.select(
        "read_id", "qname", F.when(F.col("strand"), 0).otherwise(16).alias("flag"), "rname", (F.col("ref_begin") + 1).alias("pos"), F.lit(255).alias("mapq"), clipped_cigar().alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        sequence_in_strand(F.col("seq"), F.col("strand")).alias("seq"), qual.alias("qual"), F.col("score").alias("as"), (F.col("mismatches") + F.col("gaps")).alias("nm"),
    )


def sam_null_rows(missed: DataFrame) -> DataFrame:
    """SAM columns of reads without an alignment."""
    zero, star = F.lit(0), F.lit("*")
    return missed.select("read_id", sam_id(F.col("header")).alias("qname"), F.lit(4).alias("flag"), star.alias("rname"), zero.alias("pos"), F.lit(255).alias("mapq"), star.alias("cigar"), star.alias("rnext"), zero.alias("pnext"), zero.alias("tlen"), align_alphabet(F.col("seq")).alias("seq"), F.coalesce("qual", star).alias("qual"), zero.alias("as"), zero.alias("nm"))


def sam_lines(rows: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", F.concat(F.lit("AS:i:"), "as"), F.concat(F.lit("NM:i:"), "nm"))
    return rows.select(line.alias("line"))


def sam_header(refs: DataFrame, command: str, with_refs: bool) -> DataFrame:
    """Header lines in order: ``ord`` and ``line``."""
    one = refs.sparkSession.range(1)
    out = one.select(F.lit(0).cast("long").alias("ord"), F.lit("@HD\tVN:1.0\tSO:unsorted").alias("line"))
    if with_refs:
        out = out.unionByName(refs.select((F.col("ref_num") + 1).cast("long").alias("ord"), F.concat(F.lit("@SQ\tSN:"), sam_id(F.col("header")), F.lit("\tLN:"), F.length("seq").cast("string")).alias("line")))
    return out.unionByName(one.select(F.lit((1 << 62)).cast("long").alias("ord"), F.lit(f"@PG\tID:strandloom\tVN:1.0\tCL:{command}").alias("line")))


def otu_lines(groups: DataFrame) -> DataFrame:
    """ref_id and its reads, tab separated, in order of ref_id."""
    return groups.orderBy("ref_id").select(F.concat_ws("\t", F.col("ref_id"), F.concat_ws("\t", "read_ids")).alias("line"))


def summary_text(s: dict, config: SearchConfig, run: dict | None = None) -> str:
    """The run log from a summary row. run: command, references, reads (files) and seconds, as far as known."""
    share = lambda n: 100.0 * n / s["reads"] if s["reads"] else 0.0
    run = run or {}
    lines = [f"Command: {run['command']}"] if run.get("command") else []
    if "references" in run:
        lines += ["Reference files:", *(f"    {x}" for x in run["references"]), "Reads files:", *(f"    {x}" for x in run["reads"])]
    lines += [
        "Parameters summary:",
        f"    Number of alignments = {config.num_alignments} ({'best' if config.best else 'first'})",
        f"    Seed length = {config.seed}, passes = {','.join(map(str, config.steps))}",
        f"    SW match = {config.match}, mismatch = {config.mismatch}, gap open = {config.gap_open}, gap extend = {config.gap_ext}, ambiguous = {config.ambiguous}",
        f"    E-value threshold = {config.evalue:g}, minimal score = {s['minimal_score']}",
        "Results:",
        f"    Total reads = {s['reads']}",
        f"    Total reads passing E-value threshold = {s['aligned']} ({share(s['aligned']):.2f})",
        f"    Total reads failing E-value threshold = {s['reads'] - s['aligned']} ({share(s['reads'] - s['aligned']):.2f})",
    ]
    if config.otu_map or config.de_novo:
        lines += [f"    Total reads for de novo clustering = {s['denovo']}", f"    Total reads passing %id and %coverage thresholds = {s['id_cov']}", f"    Total OTUs = {s['otus']}"]
    lines += [f"    Minimum read length = {s['min_len']}", f"    Maximum read length = {s['max_len']}", f"    Mean read length = {s['mean_len']}"]
    lines += ["Coverage by database:"] + [f"    {name}\t\t{share(n):.2f}" for name, n in s["per_db"]]
    if "seconds" in run:
        lines.append(f"Finished at {run['finished']}, after {run['seconds']:.1f} seconds")
    return "\n".join(lines) + "\n"
