"""Seed search: read windows joined with the index on an exact half and at most one edit in the other.

A window is two halves. The forward search takes index entries whose half equals the
first and whose tail is within one edit of the second; the reverse search the other
way round, and only for windows without an exact forward hit. An exact hit replaces all
others of its window unless the search is full.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.functions.encode import reverse_complement, seed_alphabet
from strandloom.operators import scan
from strandloom.operators.index import SeedIndex
from strandloom.tables import written

#: Distinct index rows up to which the join may broadcast them (about 60 bytes each).
BROADCAST_ROWS = 1_000_000


def strands(reads: DataFrame, config: SearchConfig) -> DataFrame:
    """read_id, strand (true: forward), seq in the seed alphabet, for each strand searched."""
    base = reads.select("read_id", seed_alphabet(F.col("seq")).alias("seq"))
    sides = []
    if config.forward:
        sides.append(F.struct(F.lit(True).alias("strand"), F.col("seq").alias("s")))
    if config.reverse:
        sides.append(F.struct(F.lit(False).alias("strand"), reverse_complement(F.col("seq")).alias("s")))
    return base.select("read_id", F.explode(F.array(*sides)).alias("x")).select("read_id", "x.strand", F.col("x.s").alias("seq"))


def windows(stranded: DataFrame, config: SearchConfig, upto: int = 0, fresh: bool = True) -> DataFrame:
    """read_id, strand, win, w1, w2 of pass ``upto``; fresh: without the windows of earlier passes."""
    seed, half, steps = config.seed, config.half, config.steps
    starts = F.sequence(F.lit(0), F.length("seq") - seed, F.lit(steps[upto]))
    if fresh and upto:
        earlier = steps[:upto]
        starts = F.filter(starts, lambda w: reduce(and_, [w % step != 0 for step in earlier]))
    # cut from bytes, each in constant time, before the explode, which then copies no sequence
    letters = F.col("seq").cast("binary")
    cut = lambda w, at: F.substring(letters, w + at + 1, F.lit(half)).cast("string")
    rows = F.transform(starts, lambda w: F.struct(w.alias("win"), cut(w, 0).alias("w1"), cut(w, half).alias("w2")))
    return stranded.where(F.length("seq") >= seed).select("read_id", "strand", F.explode(rows).alias("x")).select("read_id", "strand", "x.*")


def spread(reads: DataFrame) -> DataFrame:
    """``reads`` over as many partitions as the cluster runs at once, where the files give fewer."""
    n = reads.sparkSession.sparkContext.defaultParallelism
    return reads.repartition(n, "read_id") if reads.rdd.getNumPartitions() < n else reads


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over a fixed number of tasks, rows of equal keys in one.

    Few bytes may be long work, which an adaptive plan would leave to one task. The hash
    is a key that no join or union has: Spark leaves out an exchange on keys by which the
    rows already lie, and an adaptive plan then moves the rows of a join below it.
    """
    session = rows.sparkSession
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism)
    return rows.repartition(n, F.xxhash64(*keys))


def one_edit(pattern: Column, tail: Column, half: int) -> Column:
    """Whether a prefix of the tail of half - 1 to half + 1 letters is within one edit of the pattern.

    One edit leaves a beginning or an end of the pattern as it is, so most tails go by two
    comparisons of a few letters before any distance is taken.
    """
    k = half // 2
    start = F.substring(pattern, 1, k) == F.substring(tail, 1, k)
    # the rest of the pattern stands unmoved, or moved by one letter
    rest = F.substring(pattern, k + 1, half)
    end = (rest == F.substring(tail, k + 1, half - k)) | (rest == F.substring(tail, k, half - k)) | (rest == F.substring(tail, k + 2, half - k))
    near = [F.levenshtein(pattern, F.substring(tail, 1, n), 1) for n in (half - 1, half, half + 1)]
    return (start | end) & ((near[0] >= 0) | (near[1] >= 0) | (near[2] >= 0))


def exact(pattern: Column, tail: Column, half: int) -> Column:
    return F.substring(tail, 1, half) == pattern


def side_hits(found: DataFrame, entries: DataFrame, config: SearchConfig, key: str, other: Column, small: bool, but: DataFrame | None = None) -> DataFrame:
    """One sub-search: db, read_id, strand, win, code, is_exact, each code of a window once.

    but: windows (by db) that are left out.
    """
    named = entries.select("db", F.col("half").alias(key), F.col("tail").alias("_tail"), "code")
    joined = found.join(F.broadcast(named) if small else named, key).where(one_edit(other, F.col("_tail"), config.half))
    if but is not None:
        joined = joined.join(but, ["db", "read_id", "strand", "win"], "left_anti")
    out = joined.select("db", "read_id", "strand", "win", "code", exact(other, F.col("_tail"), config.half).alias("is_exact"))
    return out.groupBy("db", "read_id", "strand", "win", "code").agg(F.max("is_exact").alias("is_exact"))


def hits(found: DataFrame, index: SeedIndex, config: SearchConfig, small: bool | None = None) -> DataFrame:
    """db, read_id, strand, win, code of all accepted seeds."""
    if small is None:
        small = index.forward.count() <= BROADCAST_ROWS
    ahead = side_hits(found, index.forward, config, "w1", F.col("w2"), small)
    if config.full_search:
        back = side_hits(found, index.back, config, "w2", F.reverse("w1"), small)
        return ahead.unionByName(back).select("db", "read_id", "strand", "win", "code").distinct()
    # written, as it is used twice: only windows without an exact hit are searched back
    ahead = written(ahead, "hits-ahead")
    solved = ahead.where("is_exact").select("db", "read_id", "strand", "win").distinct()
    back = side_hits(found, index.back, config, "w2", F.reverse("w1"), small, solved)
    return settle(ahead.withColumn("side", F.lit(0)).unionByName(back.withColumn("side", F.lit(1))))


def settle(found: DataFrame) -> DataFrame:
    """Of each window's codes: the least exact one of a side alone where there is one, else all."""
    w = ["db", "read_id", "strand", "win"]
    best = found.groupBy(*w, "side").agg(F.min(F.when(F.col("is_exact"), F.col("code"))).alias("_only"), F.collect_set("code").alias("_all"))
    codes = F.when(F.col("_only").isNotNull(), F.array("_only")).otherwise(F.col("_all"))
    return best.select(*w, F.explode(codes).alias("code")).distinct()


def search(reads: DataFrame, index: SeedIndex, config: SearchConfig, small: bool, upto: int = 0, coded: Callable = scan.letters_of) -> DataFrame:
    """``hits`` on the fresh windows of pass ``upto`` of reads (read_id, seq); small: in one Arrow pass over the reads, with ``coded`` letters."""
    if not small:
        return hits(windows(strands(reads, config), config, upto), index, config, small)
    found = scan.hits(reads, index, config, upto, back="all" if config.full_search else "rest", coded=coded)
    if config.full_search:
        return found.select("db", "read_id", "strand", "win", "code").distinct()
    # rows of one read_id count together
    of = lambda side, which: F.when((F.col("side") == side) & which, F.col("code"))
    every, is_exact = F.lit(True), F.col("is_exact")
    w = ["db", "read_id", "strand", "win"]
    sums = [(F.min(of(k, is_exact)).alias(f"_only{k}"), F.collect_set(of(k, every)).alias(f"_all{k}")) for k in (0, 1)]
    picked = [F.when(F.col(f"_only{k}").isNotNull(), F.array(f"_only{k}")).otherwise(F.col(f"_all{k}")) for k in (0, 1)]
    codes = F.when(F.col("_only0").isNotNull(), picked[0]).otherwise(F.array_union(picked[0], picked[1]))
    return found.groupBy(*w).agg(*(x for pair in sums for x in pair)).select(*w, F.explode(codes).alias("code"))


def search_side(reads: DataFrame, index: SeedIndex, config: SearchConfig, back: bool, small: bool, coded: Callable = scan.letters_of) -> DataFrame:
    """``side_hits`` of one sub-search on the first pass's windows of reads (read_id, seq)."""
    if small:
        found = scan.hits(reads, index, config, 0, ahead=not back, back="all" if back else "none", coded=coded)
        return found.groupBy("db", "read_id", "strand", "win", "code").agg(F.max("is_exact").alias("is_exact"))
    cut = windows(strands(reads, config), config, 0)
    if back:
        return side_hits(cut, index.back, config, "w2", F.reverse("w1"), small)
    return side_hits(cut, index.forward, config, "w1", F.col("w2"), small)


def exact_hits(found: DataFrame, index: SeedIndex) -> DataFrame:
    """Windows whose whole L-mer is an indexed one: an equi-join and nothing else."""
    from strandloom.functions.encode import kmer_code

    codes = index.forward.select("db", "code").distinct()
    keyed = found.select("read_id", "strand", "win", kmer_code(F.concat("w1", "w2")).alias("code"))
    return keyed.join(codes, "code").select("db", "read_id", "strand", "win", "code")


def placed(found: DataFrame, index: SeedIndex) -> DataFrame:
    """db, read_id, strand, win, ref_num, pos: each hit at all its places in the references."""
    return found.join(index.places, ["db", "code"]).select("db", "read_id", "strand", "win", "ref_num", "pos")


def seeded_reads(found: DataFrame, config: SearchConfig) -> DataFrame:
    """Reads (and strands) with enough windows that hit."""
    return found.groupBy("db", "read_id", "strand").agg(F.countDistinct("win").alias("windows")).where(F.col("windows") >= config.num_seeds)
