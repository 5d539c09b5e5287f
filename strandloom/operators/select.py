"""What is kept of a read's alignments, and the classes and counts that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.functions.stats import rounded_ratio


def best_n(alignments: DataFrame, n: int) -> DataFrame:
    """The n best alignments of each read, earlier ones first on ties (0: all)."""
    if not n:
        return alignments
    order = Window.partitionBy("read_id").orderBy(F.col("score").desc(), "discovery_ord")
    return alignments.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def first_n(alignments: DataFrame, n: int) -> DataFrame:
    """The first n alignments of each read in order of discovery (0: all)."""
    if not n:
        return alignments
    order = Window.partitionBy("read_id").orderBy("discovery_ord")
    return alignments.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def kept(alignments: DataFrame, config: SearchConfig) -> DataFrame:
    return (best_n if config.best else first_n)(alignments, config.num_alignments)


def with_ratios(alignments: DataFrame) -> DataFrame:
    """identity and coverage, rounded to thousandths."""
    identity = F.col("matches") / (F.col("matches") + F.col("mismatches") + F.col("gaps"))
    coverage = (F.abs(F.col("read_end") - F.col("read_begin")) + 1) / F.col("read_len")
    return alignments.withColumns({"identity": rounded_ratio(identity), "coverage": rounded_ratio(coverage)})


def classed(rated: DataFrame, config: SearchConfig) -> DataFrame:
    """``class`` of each alignment by the identity and coverage thresholds."""
    i, c = F.col("identity") >= config.identity, F.col("coverage") >= config.coverage
    name = F.when(i & c, "id_cov").when(i, "id_only").when(c, "cov_only").otherwise("denovo")
    return rated.withColumn("class", name)


CLASSES = ("id_cov", "id_only", "cov_only", "denovo")


def class_counts(marked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Alignments in each class, for all reads or for each."""
    return marked.groupBy(*by).agg(*[F.coalesce(F.sum((F.col("class") == c).cast("long")), F.lit(0)).alias(f"n_{c}") for c in CLASSES])


def denovo_reads(marked: DataFrame) -> DataFrame:
    """Reads all of whose alignments fail both thresholds."""
    rest = " + ".join(f"n_{c}" for c in CLASSES[:-1])
    return class_counts(marked, ("read_id",)).where(f"n_denovo > 0 AND {rest} = 0").select("read_id")


def otu_map(marked: DataFrame) -> DataFrame:
    """ref_id, read_ids: the reads, in order, that match each reference at both thresholds."""
    passing = marked.where(F.col("class") == "id_cov").select("ref_id", "read_id").distinct()
    return passing.groupBy("ref_id").agg(F.sort_array(F.collect_list("read_id")).alias("read_ids"))


def otu_total(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("class") == "id_cov").agg(F.countDistinct("ref_id").alias("otus"))


def per_db(alignments: DataFrame) -> DataFrame:
    """db, first_hits, best_hits: reads whose first, and whose best, alignment is in the database."""
    ends = alignments.groupBy("read_id").agg(F.min_by("db", "discovery_ord").alias("first"), F.max_by("db", F.struct("score", (-F.col("discovery_ord")).alias("o"))).alias("best"))
    both = ends.select(F.explode(F.array(F.struct(F.col("first").alias("db"), F.lit(1).alias("f"), F.lit(0).alias("b")), F.struct(F.col("best").alias("db"), F.lit(0).alias("f"), F.lit(1).alias("b")))).alias("x"))
    return both.groupBy(F.col("x.db").alias("db")).agg(F.sum("x.f").alias("first_hits"), F.sum("x.b").alias("best_hits"))


def aligned(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    return reads.join(alignments.select("read_id").distinct(), "read_id", "left_semi")


def other(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    return reads.join(alignments.select("read_id").distinct(), "read_id", "left_anti")


#: Reads up to which a join sends their ids to every task, instead of dealing out all reads.
FEW_READS = 1_000_000


def ids_of(found: DataFrame) -> DataFrame:
    """The read ids of ``found``, a written table, marked for broadcast where they are few."""
    ids = found.select("read_id").distinct()
    return F.broadcast(ids) if ids.limit(FEW_READS + 1).count() <= FEW_READS else ids


def among(reads: DataFrame, found: DataFrame) -> DataFrame:
    """The reads that ``found``, a written table, has rows of."""
    return reads.join(ids_of(found), "read_id", "left_semi")
