"""Exact top-k inner products by norm buckets.

Vectors are ordered by length and packed in blocks of similar length (the buckets). For a
query with k-th best score theta so far, a block of largest length L can hold a better
vector only if cos >= theta / (|q| L), the block's local threshold. Over 1 the block is
skipped. Else the threshold says which of two prunings pays for this block and query:

* coordinate pruning: a vector's coordinates, where the query has its largest, must fall
  in the interval that the threshold allows. The block's sorted coordinates tell how many
  vectors are left before any is touched; it is chosen when few are.
* length pruning: the block is in order of length, and only a prefix can reach theta.

What is left is verified by exact integer products. Blocks are dealt over panels in turn
and every task takes its blocks from the longest on, so theta, which starts from the
longest SEEDS vectors, rises in each of them. A task holds queries of GROUP_BYTES at most
and streams blocks; the number of tasks follows from the products to make.

Vectors of one length in random directions (as in a table of random unit vectors) allow
neither pruning at the low thresholds that their best scores give: all their products are
made. ``top_k(..., counts=True)`` tells the number.

Defined cases: vectors that are null, or hold a null or non-finite component, take no
part, nor do null ids; vectors of another dimension than the query's are no candidates;
ties go to the smaller id; a query's own row is no candidate, other rows are, also those
of its id or its vector; repeated query rows have a list each; a query with fewer
candidates returns all; scores saturate at 64 bits; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import written

BLOCK = 4096
BLOCK_BYTES = 8 << 20
QUERY_BLOCK = 512
#: Products of a block of queries with a block of vectors that one task makes, about.
PAIRS_PER_TASK = 64
GROUP_BYTES = 64 << 20
SEEDS = 1024
#: Coordinates of a query that are looked at, and the share of a block's vectors that must be left for it to pay.
FOCUS = 3
COORDINATE_SHARE = 0.125
_EXACT = float(1 << 53)
_NONE = -(1 << 63)
_SCHEMA = "kind int, panel int, dim int, largest double, ids binary, keys binary, rows binary, theta binary"


def quantise(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    top = float(1 << 52)
    return F.when(embedding.isNotNull() & fine, F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(top)), F.lit(-top)))))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _blocks(size: int, queries: bool, seeds: dict | None = None, k: int = 0, panels: int = 1):
    """Packs the rows of a partition, in order, into blocks of one dimension.

    Blocks of vectors get panels in turn; blocks of queries get the k-th best score among the seeds.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        number = TaskContext.get().partitionId()

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, keys, rows = (np.concatenate(x) for x in held.pop(dim))
            norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
            theta = first_scores(rows, keys, seeds.get(dim), k).tobytes() if queries else None
            number += 1
            values = [[0 if queries else 1], [number % panels], [dim], [float(norms.max())], [ids.tobytes()], [keys.tobytes()], [rows.tobytes()], [theta]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], _SCHEMA.replace(",", "").split()[::2])

        for batch in batches:
            values, sizes = _matrix(batch.column("v"))
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            at = np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                rows = values[(at[pick][:, None] + np.arange(dim)).ravel()].reshape(len(pick), dim)
                most = max(1, min(size, BLOCK_BYTES // (8 * dim)))
                while len(pick):
                    own = held.setdefault(dim, [[], [], []])
                    room = most - sum(map(len, own[0]))
                    for x, part in zip(own, (ids[pick[:room]], keys[pick[:room]], rows[:room]), strict=True):
                        x.append(part)
                    full = len(pick) >= room
                    pick, rows = pick[room:], rows[room:]
                    if full:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return pack


def first_scores(q: np.ndarray, keys: np.ndarray, seeds: tuple | None, k: int) -> np.ndarray:
    """Each query's k-th best score among the seeds (its own row left out), or the least number."""
    if seeds is None or len(seeds[0]) <= k:
        return np.full(len(q), _NONE)
    scores = products(q, seeds[1])
    scores[keys[:, None] == seeds[0]] = _NONE
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``q`` with all of ``rows``, saturated at 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:
        return (q.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < float(1 << 63):
        return q @ rows.T
    exact = q.astype(object) @ rows.astype(object).T
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(int(x), low), high) for x in r] for r in exact], np.int64).reshape(len(q), len(rows))


class Block:
    """Vectors of one dimension in order of length, with their unit coordinates sorted where asked for."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.keys, self.rows, self.norms = ids[order], keys[order], rows[order], norms[order]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of unit coordinate f in rising order."""
        if f not in self._sorted:
            unit = self.rows[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self._sorted[f] = (order, unit[order])
        return self._sorted[f]

    def feasible(self, direction: np.ndarray, t: float, limit: float) -> np.ndarray | None:
        """Places of the vectors that may have cos >= t with a unit vector, by its largest coordinates; None if over ``limit``."""
        best: tuple | None = None
        spans = []
        for f in np.argsort(-np.abs(direction))[:FOCUS].tolist():
            c = float(direction[f])
            spread = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - c * c)) + 1e-7
            low = t * c - spread if c > -t else -1.0
            high = t * c + spread if c < t else 1.0
            if high - low > 1:
                continue  # too wide to be worth a sorted list
            order, values = self.coordinate(f)
            s, e = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            spans.append((order, s, e))
            if best is None or e - s < best[2] - best[1]:
                best = spans[-1]
        if best is None:
            return None
        keep = best[0][best[1] : best[2]]
        for order, s, e in spans:
            if order is not best[0] and len(keep):
                inside = np.zeros(len(self.ids), bool)
                inside[order[s:e]] = True
                keep = keep[inside[keep]]
        return np.sort(keep) if len(keep) <= limit else None


class Asked:
    """A block of queries with their k best so far."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int):
        self.ids, self.keys, self.q, self.k = ids, keys, q, k
        self.theta = theta.copy()
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.who, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.verified = np.zeros(len(ids), np.int64)

    def _take(self, asks: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the entries of a product table that may be among the k best."""
        self.verified[asks] += scores.shape[1]
        least = self.theta[asks]
        if scores.shape[1] > self.k + 1:
            # one more than k, as a query's own row may be among them
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k - 1, axis=1)[:, scores.shape[1] - self.k - 1])
        a, i = np.nonzero(scores >= least[:, None])
        other = self.keys[asks[a]] != keys[i]
        a, i = a[other], i[other]
        return asks[a], scores[a, i], ids[i]

    def meet(self, block: Block) -> None:
        """Takes in what a block holds above each query's local threshold."""
        slack = 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(self.theta > 0, self.theta / np.maximum(self.length, 1e-300), -1.0)
            local = np.where(self.theta > 0, reach / block.norms[0] if block.norms[0] > 0 else np.inf, -1.0)
        got = []
        by_length = []
        for j in np.flatnonzero(local <= 1 + slack).tolist():
            keep = None
            if local[j] > 0:
                n = int(np.searchsorted(-block.norms, -(reach[j] * (1 - slack)), side="right"))
                keep = block.feasible(self.q[j] / self.length[j], min(1.0, float(local[j]) * (1 - slack)), COORDINATE_SHARE * n)
            if keep is None:
                by_length.append(j)
            elif len(keep := keep[keep < n]):
                got.append(self._take(np.array([j]), products(self.q[j : j + 1], block.rows[keep]), block.ids[keep], block.keys[keep]))
        if by_length:
            own = np.array(by_length)
            least = reach[own].min()
            n = int(np.searchsorted(-block.norms, -(least * (1 - slack)), side="right")) if least > 0 else len(block.ids)
            if n:
                got.append(self._take(own, products(self.q[own], block.rows[:n]), block.ids[:n], block.keys[:n]))
        if got:
            who, score, vec = (np.concatenate(x) for x in zip(*got, (self.who, self.score, self.vec), strict=True))
            order = np.lexsort((vec, -score, who))
            who, score, vec = who[order], score[order], vec[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == self.k - 1
            self.theta[who[last]] = np.maximum(self.theta[who[last]], score[last])
            self.who, self.score, self.vec = (x[rank < self.k] for x in (who, score, vec))


def _search(k: int):
    names = ["query_key", "query_id", "vec_id", "score", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list[Asked]] = {}
        for batch in batches:
            for kind, dim, ids, keys, rows, theta in zip(*(batch.column(c).to_pylist() for c in ("kind", "dim", "ids", "keys", "rows", "theta")), strict=True):
                i, own = np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64)
                r = np.frombuffer(rows, np.int64).reshape(len(i), dim)
                if kind == 0:
                    asked.setdefault(dim, []).append(Asked(i, own, r, np.frombuffer(theta, np.int64), k))
                elif dim in asked:
                    block = Block(i, own, r)
                    for a in asked[dim]:
                        a.meet(block)
        for a in (a for some in asked.values() for a in some):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.keys[a.who], a.ids[a.who], a.vec, a.score, a.verified[a.who])], names)

    return run


def top_k(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = 10, scale: int = 1024, counts: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best of all other rows.

    counts: with verified, the products that were made for the query.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_column).cast("long").alias("id"), is_query.alias("asks"), quantise(F.col(vector_column), scale).alias("v"))
    base = base.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # a row's key is fixed by being written
    held = written(base.withColumn("norm", norm).withColumn("key", F.monotonically_increasing_id()), "search-rows")
    n, queries, query_bytes = held.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.sum(F.when(F.col("asks"), F.size("v") * F.lit(8).cast("long")))).first()
    blocks_of, query_blocks = -(-n // BLOCK), -(-queries // QUERY_BLOCK)
    groups = max(1, -(-(query_bytes or 0) // GROUP_BYTES))
    panels = max(1, min(blocks_of, max(spark.sparkContext.defaultParallelism, -(-blocks_of * query_blocks // (PAIRS_PER_TASK * groups)))))
    longest = (F.col("norm").desc(), F.col("key"))
    ranged = held.repartitionByRange(max(1, -(-blocks_of // 8)), *longest).sortWithinPartitions(*longest)
    packed = ranged.select("id", "key", "v").mapInArrow(_blocks(BLOCK, False, panels=panels), _SCHEMA)

    # the longest vectors, of a fixed number, give each query a first k-th best score
    seeds: dict[int, tuple] = {}
    for dim, own in _by_dim(held.orderBy(*longest).limit(SEEDS).select("key", "v").collect()).items():
        seeds[dim] = (np.array([r["key"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64))
    asks = held.where("asks").select("id", "key", "v").mapInArrow(_blocks(QUERY_BLOCK, True, seeds, k), _SCHEMA)

    # blocks of queries go to every panel of their group, blocks of vectors to every group of their panel
    asks = asks.withColumn("group", F.pmod(F.xxhash64("keys"), F.lit(groups)).cast("int")).withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1))))
    packed = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = asks.unionByName(packed).repartitionById(panels * groups, (F.col("panel") * groups + F.col("group")).cast("int"))
    dealt = dealt.sortWithinPartitions("panel", "group", "kind", F.col("largest").desc())
    found = dealt.select("kind", "dim", "ids", "keys", "rows", "theta").mapInArrow(_search(k), "query_key long, query_id long, vec_id long, score long, verified long")
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["verified"] if counts else []))


def _by_dim(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["v"]), []).append(r)
    return out
