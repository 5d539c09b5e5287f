"""Where the mates of a pair go: aligned and other outputs under the pairing options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import SearchConfig


def with_hits(reads: DataFrame, hit_ids: DataFrame) -> DataFrame:
    """``hit`` for each read, and ``h0`` and ``h1`` for its pair. One join, one aggregation by pair."""
    marked = reads.join(hit_ids.select("read_id").distinct().withColumn("_hit", F.lit(True)), "read_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")
    pairs = marked.groupBy("pair_id").agg(*[F.coalesce(F.max(F.when(F.col("mate") == m, F.col("hit"))), F.lit(False)).alias(f"h{m}") for m in (0, 1)])
    return marked.join(pairs, "pair_id")


def routes(marked: DataFrame, config: SearchConfig) -> DataFrame:
    """``output`` (aligned or other) and ``file`` (all, fwd, rev, paired, singleton_rev, ...) of each mate."""
    both, either = F.col("h0") & F.col("h1"), F.col("h0") | F.col("h1")
    side = F.when(F.col("mate") == 0, "fwd").otherwise("rev")
    hit: Column = F.col("hit")
    if config.sout:
        together = F.when(hit, both).otherwise(~either)
        group = F.when(together, "paired").otherwise("singleton")
        file = F.concat_ws("_", group, side) if config.out2 else group
    else:
        hit = either if config.paired_in else both if config.paired_out else hit
        file = side if config.out2 else F.lit("all")
    return marked.withColumn("output", F.when(hit, "aligned").otherwise("other")).withColumn("file", file)


def denovo_routes(marked: DataFrame, denovo_ids: DataFrame, config: SearchConfig) -> DataFrame:
    """De novo mates alone, with the file that each goes to."""
    own = marked.join(denovo_ids.select("read_id").distinct(), "read_id", "left_semi")
    both = own.groupBy("pair_id").agg((F.countDistinct("mate") == 2).alias("_both"))
    side = F.when(F.col("mate") == 0, "fwd").otherwise("rev")
    group = F.when(F.col("_both"), "paired").otherwise("singleton")
    file = (F.concat_ws("_", group, side) if config.out2 else group) if config.sout else side if config.out2 else F.lit("all")
    return own.join(both, "pair_id").withColumn("output", F.lit("denovo")).withColumn("file", file).drop("_both")
