"""Sharding along a Hilbert curve (DataFrame functions only on the main path).

Metadata columns are quantised to a few bits each in their own order, so that the cells
of a column hold about equal bytes; their cell's index on a Hilbert curve orders the
rows, and runs of equal bytes are cut from that order. So each shard spans a small box of
the metadata and readers can skip files, by least and greatest value, on any of them.

Defined cases: a null text has size 1 (no bytes plus 1) and crc32 of the empty text;
null metadata fall in the first cell; equal rows may swap places; an empty table gives an
empty result; extra columns are ignored; a shard may stay empty when there are fewer
rows than shards. Equal texts take the cell of their group (the least lang and source
among them), lie side by side there, and stay in one shard unless the group is larger
than both the largest row and a twentieth of a shard, when it is cut between rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import written

ROWS_PER_RANGE = 250_000


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer columns of ``bits`` bits each (Skilling's transform)."""
    n = len(dims)
    if n * bits > 62:
        raise ValueError("the index must fit in 62 bits")
    long = lambda x: F.lit(x).cast("long")
    start = F.array(*[d.cast("long") for d in dims])
    steps = F.array(*[F.array(long(1 << b), long(i)) for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else F.array().cast("array<array<bigint>>")

    def undo(x: Column, step: Column) -> Column:
        q, i = step[0], step[1].cast("int")
        low = q - 1
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
        flip = x[i].bitwiseAND(q) != 0
        return F.transform(x, lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((j == 0) & (i == 0), v).when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(steps, start, undo)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(a[i - 1])).otherwise(v))) if n > 1 else x
    tops = F.array(*[long(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")

    def entangle(a: Column) -> Column:
        t = F.aggregate(tops, long(0), lambda t, q: F.when(a[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(a, lambda v: v.bitwiseXOR(t))

    # one-element arrays bind a value once, so that no expression is written out again
    fixed = F.transform(F.array(gray), entangle)[0]
    places = F.array(*[F.array(long(b), long(i)) for b in range(bits - 1, -1, -1) for i in range(n)])
    gather = lambda a: F.aggregate(places, long(0), lambda h, p: h * 2 + F.call_function("shiftright", a[p[1].cast("int")], p[0].cast("int")).bitwiseAND(1))
    return F.transform(F.array(fixed), gather)[0]


def cuts(rows: DataFrame, column: str, weight: str, bits: int) -> list[tuple[int, object]]:
    """(cell, its first value) of the cells of a column, in order; cells hold about equal sums of ``weight``.

    A value's cell follows from the weight of all smaller ones, so that a value with a
    third of the weight leaves a third of the cells unused behind it and neighbours stay
    neighbours. Weights are summed by value first; the values are ranked in ranges of
    bounded size. Only a cell's first value, at most 2 ** bits of them, comes to the driver.
    """
    values = written(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.sum(weight).alias("_w")), "shard-values")
    n, total = values.agg(F.count(F.lit(1)), F.sum("_w")).first()
    if not n:
        return []
    ranged = written(values.repartitionByRange(max(1, -(-n // ROWS_PER_RANGE)), "_v").withColumn("_part", F.spark_partition_id()), "shard-ranks")
    sums = ranged.groupBy("_part").agg(F.sum("_w").alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_b"))
    own = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_at", F.coalesce(F.sum("_w").over(own), F.lit(0))).join(F.broadcast(base), "_part")
    # the middle of a value's own weight: values of one cell each spread evenly over all cells
    middle = F.col("_at") + F.col("_b") + F.col("_w") / 2
    cell = F.least(F.floor(middle * (1 << bits) / total), F.lit((1 << bits) - 1)).cast("int")
    return [(r["_c"], r["_v"]) for r in placed.groupBy(cell.alias("_c")).agg(F.min("_v").alias("_v")).orderBy("_c").collect()]


def quantised(column: Column, known: list[tuple[int, object]]) -> Column:
    """The cell of a column's value by its ``cuts``; nulls are in cell 0."""
    out = F.lit(0)
    for cell, first in known:
        out = F.when(column >= F.lit(first), F.lit(cell)).otherwise(out) if first is not None else out
    return F.coalesce(F.when(column.isNotNull(), out), F.lit(0)).cast("long")


def shard_by_curve(rows: DataFrame, dims: list[Column], bits: int, id_column: str, shards: int) -> DataFrame:
    """``rows`` (id, size, _group, ...) with shard and slot; near equal sums of ``size`` in each shard.

    Rows of equal _group have equal ``dims`` and lie together. Rows are range partitioned
    by (cell, group, hash of the id), of which no value is hot, so a large group
    spreads over tasks; running sums come from one small row for each partition.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_cell", hilbert_index(dims, bits)).withColumn("_tie", F.xxhash64(F.col(id_column), F.lit(7)))
    held = written(keyed, "shard-keys")
    n = held.count()
    parts = max(1, -(-n // ROWS_PER_RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000))
    ranged = written(held.repartitionByRange(parts, "_cell", "_group", "_tie", id_column).withColumn("_part", F.spark_partition_id()), "shard-ranges")

    order = Window.partitionBy("_part").orderBy("_cell", "_group", "_tie", id_column)
    whole = Window.partitionBy("_part", "_cell", "_group")
    key = F.struct("_cell", "_group")
    # of each range: its sums, and the groups at its two ends, which may go on in the next range
    ranges = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_low"), F.max(key).alias("_high"), F.max("size").alias("_largest"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.select("*", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0")), "shard-sums")
    total = ranges.agg(F.sum("_bytes"), F.max("_largest")).first()
    all_bytes, largest = (total[0] or 1), (total[1] or 1)
    most = max(largest, all_bytes // (20 * shards))

    placed = ranged.join(F.broadcast(ranges.select("_part", "_b0", "_r0")), "_part")
    placed = placed.select(
        "*",
        # by rows: equal rows, too, are cut between
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") + F.col("_b0")).alias("_at"),
        (F.row_number().over(order) - 1 + F.col("_r0")).alias("_row"),
        F.sum("size").over(whole).alias("_here"),
    ).withColumn("_first", F.min("_at").over(whole))
    # groups that end one range and begin another: at most two for each range
    ends = ranges.select(F.explode(F.array("_low", "_high")).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    ends = ends.where("_n > 1").select(F.col("_k._cell").alias("_cell"), F.col("_k._group").alias("_group"))
    crossing = ranged.select("_cell", "_group", "size", "_part").join(F.broadcast(ends), ["_cell", "_group"]).groupBy("_cell", "_group").agg(F.sum("size").alias("_all"))
    placed = placed.join(F.broadcast(crossing), ["_cell", "_group"], "left")
    # a group cut by a range's edge but small enough starts where the earlier range's part starts
    shard_of = lambda at: F.least(F.floor(at * shards / all_bytes), F.lit(shards - 1)).cast("int")
    spans = placed.where(F.col("_all").isNotNull()).groupBy("_cell", "_group").agg(F.min("_at").alias("_start"))
    placed = placed.join(F.broadcast(spans), ["_cell", "_group"], "left")
    extent, start = F.coalesce("_all", "_here"), F.coalesce("_start", "_first")
    placed = placed.withColumn("shard", shard_of(F.when(extent <= most, start).otherwise(F.col("_at"))))
    placed = written(placed.drop("_here", "_first", "_all", "_start", "_cell", "_group", "_tie", "_part", "_b0", "_r0"), "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first_row"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("_row") - F.col("_first_row")).cast("long")).drop("_row", "_first_row", "_at")


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = 5) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the metadata of its cell."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text).cast("long") + 1).alias("size")
    rows = written(docs.select("doc_id", size, F.crc32(text).alias("text_crc32"), "lang", "source", F.xxhash64(text).alias("_group")), "shard-input")
    groups = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min("lang").alias("_lang"), F.min("source").alias("_source")).where("_n > 1").drop("_n")
    # written, so that the join's two sides are plain exchanges and a large group can be split
    rows = rows.join(written(groups, "shard-groups"), "_group", "left").withColumn("lang", F.coalesce("_lang", "lang")).withColumn("source", F.coalesce("_source", "source"))
    rows = written(rows.drop("_lang", "_source"), "shard-metadata")
    dims = [quantised(F.col(c), cuts(rows, c, "size", bits)) for c in ("lang", "source", "size")]
    out = shard_by_curve(rows, dims, bits, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "lang", "source")
