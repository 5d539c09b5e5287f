"""Candidate references of a read: counted, ranked, and windowed by grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import SearchConfig

_READ = ("db", "read_id", "strand")


def candidate_refs(places: DataFrame, config: SearchConfig) -> DataFrame:
    """db, read_id, strand, ref_num, hits for references with enough hits."""
    return places.groupBy(*_READ, "ref_num").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= config.num_seeds)


def ranked(candidates: DataFrame) -> DataFrame:
    """``rank`` of each candidate: more hits first, then the smaller reference number."""
    order = Window.partitionBy(*_READ).orderBy(F.col("hits").desc(), "ref_num")
    return candidates.withColumn("rank", F.row_number().over(order))


def within_budget(candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """``level`` counts the drops in hits; those a search stops at once it has aligned are left out."""
    order = Window.partitionBy(*_READ).orderBy(F.col("hits").desc())
    return candidates.withColumn("level", F.dense_rank().over(order)).where(F.col("level") <= config.min_lis)


def frames(places: DataFrame, reads: DataFrame, config: SearchConfig) -> DataFrame:
    """For each hit of a read on a reference, how many hits lie in the frame that starts at it.

    One sorted pass over three events a hit; a frame that ends before it starts holds none.
    """
    key = [*_READ, "ref_num"]
    sized = places.join(reads.select("read_id", F.length("seq").alias("_len")), "read_id")
    reach = F.col("pos") + F.col("_len") - F.col("win") - config.seed + 1
    # a frame's begin, the hits, and a frame's end, in order of place: the hits counted between are those inside
    event = lambda at, kind: F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"))
    events = sized.select(*key, "pos", "win", F.explode(F.array(event(F.col("pos"), 0), event(F.col("pos"), 1), event(reach, 2))).alias("e"))
    order = Window.partitionBy(*key).orderBy("e.at", "e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("_n", F.sum((F.col("e.kind") == 1).cast("int")).over(order)).where("e.kind <> 1")
    inside = F.sum(F.when(F.col("e.kind") == 2, F.col("_n")).otherwise(-F.col("_n"))).cast("int")
    return counted.groupBy(*key, "pos", "win").agg(inside.alias("in_frame"))
