"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in Arrow batches. Trees grow on the driver from a
bounded sample of labelled documents (SAMPLE_ROWS, those of least id hash), with features in
at most BINS bins and gradient sums by bin. The fitted trees are flattened into arrays
of node feature, threshold, children and value, which numpy walks for all rows and
trees of a batch at once.

Defined cases: null texts score as empty ones, which get a score; without labels of
both kinds every score is the share of label 1 (0.5 without any); several labels of a
document count by their mean; of rows of one doc_id that of the least text hash is learned
from; null doc_ids are scored but not learned from; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _words
from strandloom.llm._shared import fold, raw, slices, texts_of

SAMPLE_ROWS = 20_000
BINS = 64
ACCEPT = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "non_ascii", "space", "newline",
    "stop_comma", "loud", "symbol", "bar", "brackets", "quote", "control", "distinct_words", "top_word", "distinct_trigrams",
    "repeated_lines", "log_lines", "line_length", "entropy", "long_words",
)


def _classes() -> np.ndarray:
    """For each byte, which of the byte-share features it counts for."""
    sets = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "non_ascii": bytes(range(128, 256)), "space": b" \t", "newline": b"\n\r",
        "stop_comma": b".,", "loud": b"!?", "symbol": b"#$%&*@^~+=", "bar": b"|/\\_", "brackets": b"<>{}[]()", "quote": b"\"'`:;", "control": bytes([*range(9), *range(11, 13), *range(14, 32), 127]),
    }
    out = np.zeros((256, len(sets)))
    for k, members in enumerate(sets.values()):
        out[list(members), k] = 1
    return out


_CLASSES = _classes()


def _spread(owner_at: np.ndarray, keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of distinct keys, share of the commonest key) of each row."""
    sizes = np.diff(owner_at)
    owner = np.repeat(np.arange(rows, dtype=np.uint64), sizes)
    joint = np.sort(owner << np.uint64(40) | keys >> np.uint64(24))
    distinct, most = np.ones(rows), np.zeros(rows)
    if len(joint):
        start = np.flatnonzero(np.concatenate(([True], joint[1:] != joint[:-1])))
        runs = np.diff(np.concatenate((start, [len(joint)])))
        own = (joint[start] >> np.uint64(40)).astype(np.int64)
        has = sizes > 0
        distinct[has] = np.bincount(own, minlength=rows)[has] / sizes[has]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        most[own[first]] = np.maximum.reduceat(runs, first) / sizes[own[first]]
    return distinct, most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a large_string array without nulls."""
    n = len(texts)
    body, at = raw(texts)
    size = np.diff(at)
    owner = np.repeat(np.arange(n), size)
    histogram = np.bincount(owner * 256 + body, minlength=n * 256).reshape(n, 256)
    scale = np.maximum(size, 1)[:, None]
    share = histogram @ _CLASSES / scale
    p = histogram / scale
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    hashes, word_at, start, end = _words.words_at(texts)
    words = np.diff(word_at)
    of = np.repeat(np.arange(n), words)
    length = (end - start).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))
    long = np.bincount(of, length > 14, n) / some
    distinct, top = _spread(word_at, hashes, n)
    tri, tri_at = _words.ngrams(hashes, word_at, 3)
    distinct3, _ = _spread(tri_at, tri, n)
    repeated, lines = np.zeros(n), np.ones(n)
    for k, text in enumerate(texts.to_pylist()):
        own = text.split("\n")
        lines[k] = len(own)
        if len(own) > 1:
            repeated[k] = 1 - len(set(own)) / len(own)
    columns = [np.log1p(size), np.log1p(words), mean, spread, *share.T, distinct, top, distinct3, repeated, np.log1p(lines), np.log1p(size / lines), entropy, long]
    return np.stack(columns, 1).astype(np.float32)


class Trees:
    """Boosted trees for a logistic score, kept as flat node arrays."""

    def __init__(self, base: float):
        self.base = base
        self.roots = np.zeros(0, np.int32)
        self.feature, self.left, self.right = (np.zeros(0, np.int32) for _ in range(3))
        self.threshold, self.value = np.zeros(0, np.float32), np.zeros(0)
        self.depth = 0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, least: int = 5, l2: float = 1.0, bins: int = BINS) -> Trees:
        n, width = x.shape
        mean = float(y.mean()) if n else 0.5
        if mean in (0.0, 1.0) or n < 2 * least:
            out = cls(0.0)
            out.base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
            return out
        out = cls(float(np.log(mean / (1 - mean))))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)
        cell = binned + np.arange(width) * bins
        raw_score = np.full(n, out.base)
        nodes: list[list] = []  # feature, threshold, left, right, value
        roots = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw_score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0, 0.0])
            level = [(roots[-1], np.arange(n))]
            for d in range(depth + 1):
                after = []
                for node, rows in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    nodes[node][4] = rate * gs / (hs + l2)
                    split = cls._split(cell[rows], g[rows], h[rows], width, bins, least, l2) if d < depth and len(rows) >= 2 * least else None
                    if split is None:
                        raw_score[rows] += nodes[node][4]
                        continue
                    f, b = split
                    goes = binned[rows, f] <= b
                    nodes[node][:4] = [f, float(edges[f][b]), len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                    after += [(nodes[node][2], rows[goes]), (nodes[node][3], rows[~goes])]
                level = after
        for k, node in enumerate(nodes):
            if node[0] < 0:
                node[2] = node[3] = k  # leaves lead to themselves
        table = list(zip(*nodes, strict=True))
        out.roots, out.depth = np.array(roots, np.int32), depth
        out.feature = np.maximum(np.array(table[0], np.int32), 0)
        out.threshold = np.array(table[1], np.float32)
        out.left, out.right = np.array(table[2], np.int32), np.array(table[3], np.int32)
        out.value = np.array(table[4])
        return out

    @staticmethod
    def _split(cell, g, h, width, bins, least, l2):
        flat = cell.ravel()
        each = lambda w: np.bincount(flat, None if w is None else np.repeat(w, width), width * bins).reshape(width, bins).cumsum(1)
        gl, hl, nl = each(g), each(h), each(None)
        gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least) | (nt - nl < least)] = -1
        best = int(gain.argmax())
        return None if gain.flat[best] <= 1e-9 else divmod(best, bins)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1: all trees are walked together, a level at a time."""
        total = np.full(len(x), self.base)
        if len(self.roots):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, folds: int = 5) -> Trees:
    """Trees from the labelled documents outside fold 0, ``most`` of them at most."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
    marked = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = statistics(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label"), pa.array(list(rows), pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # of rows that share a doc_id one is learned from, so no more than ``most`` come here
    joined = joined.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = joined.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, x array<float>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return Trees.fit(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with a score; texts are scored whole."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = shared.value.scores(statistics(texts_of(part)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    mine = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"))
    scored = score(mine, fit(docs, labels, folds=folds), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    trees = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.scores(statistics(texts_of(part))) >= accept))

    return docs.mapInArrow(run, docs.schema)
