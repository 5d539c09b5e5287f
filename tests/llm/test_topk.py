import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import topk_search as S


def _brute(rows, k):
    ok = [(i, [math.floor(1024 * np.float32(x).item()) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for m, (q, a) in enumerate(ok):
        if q % 100 == 0:
            own = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(ok) if n != m and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("spread", ["even", "skewed", "tight"])
def test_search_is_that_of_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "SEEDS", 30)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 6))
    if spread == "skewed":
        v *= np.exp(rng.normal(size=(600, 1)) * 2)
    if spread == "tight":
        v = np.repeat(v[:60], 10, 0) + rng.normal(size=(600, 6)) * 0.01
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v.astype(np.float32))]
    rows[7], rows[8], rows[9], rows[11] = (7, None), (8, [float("nan")] * 6), (9, [None] * 6), (11, [float("inf")] * 6)
    rows += [(100, rows[101][1]), (100, rows[100][1]), (100, rows[100][1]), (3, rows[4][1]), (3, rows[3][1]), (None, rows[5][1])]  # repeated ids and rows
    rows += [(700, [1.0, 2.0]), (701, [3.0, -1.0]), (1000, rows[0][1]), (1100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = S.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _brute(rows, 5)


def _checked(spark, v, k=10):
    rows = [(n, [float(x) for x in r]) for n, r in enumerate(v.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = S.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k, counts=True).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _brute(rows, k)
    most = {}
    for r in got:
        most[r.query_id] = max(most.get(r.query_id, 0), r.verified)
    return sum(most.values()) / len(most) / len(rows)


def test_shares_of_products_that_are_made(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 100)
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 1000)
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    plain = unit(rng.normal(size=(2000, 16)))
    clustered = unit(np.repeat(np.eye(16)[:10] * 3 + unit(rng.normal(size=(10, 16))), 200, 0) + rng.normal(size=(2000, 16)) * 0.02)
    lengths = plain * np.exp(rng.normal(size=(2000, 1)))
    assert _checked(spark, clustered) < 0.5  # by coordinates
    assert _checked(spark, lengths) < 0.5  # by length
    assert _checked(spark, plain) <= 1


def test_coordinates_keep_all_that_reach_the_threshold():
    rng = np.random.default_rng(2)
    rows = rng.integers(-900, 900, (500, 5))
    block = S.Block(np.arange(500), np.arange(500), rows)
    unit = block.rows / block.norms[:, None]
    for t in (0.7, 0.9, 0.97):
        for j in range(40):
            d = unit[j * 7]
            keep = block.feasible(d, t, 500)
            if keep is not None:
                assert set(np.flatnonzero(unit @ d >= t)) <= set(keep.tolist())


def test_equal_vectors_go_by_id(spark):
    rows = [(k, [0.5, 0.5]) for k in range(40)]
    got = S.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", F.col("vec_id") == 0, 3).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert S.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect() == []


def test_products_are_exact_for_large_components():
    q, rows = np.array([[1 << 40, 3]]), np.array([[1 << 22, 1], [-(1 << 40), 7]])
    assert S.products(q, rows).tolist() == [[(1 << 62) + 3, -(1 << 63)]]
