"""Options, statistics, index parts, edits and pair routing."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.functions import encode, stats
from strandloom.operators import index, routing, seeds, select


def test_options_that_do_not_go_together():
    bad = [{"paired_in": True, "paired_out": True}, {"sout": True, "paired_in": True}, {"other": True}, {"otu_map": True, "best": False}, {"mismatch": 1}, {"gap_ext": 6}, {"blast": ("0", "cigar")}, {"edges": "11"}, {"forward": False, "reverse": False}, {"min_id": 1.5}, {"print_all_reads": True}, {"num_seeds": 0}, {"passes": (3, 2)}]
    for options in bad:
        with pytest.raises(ValueError):
            SearchConfig(**options)
    with pytest.warns(UserWarning, match="18 is used"):
        assert SearchConfig(seed=7).seed == 18


def test_derived_options():
    c = SearchConfig()
    assert c.steps == (18, 9, 3) and c.with_(passes=(9, 9, 3)).steps == (9, 3)
    assert c.with_(otu_map=True).identity == 0.97 and c.identity == 0 and c.ambiguous == -3
    assert [c.with_(**o).outputs for o in ({}, {"out2": True}, {"sout": True}, {"out2": True, "sout": True})] == [1, 2, 2, 4]
    assert c.zipped(True) and not c.zipped(False) and c.with_(zip_out=1).zipped(False) and not c.with_(zip_out=0).zipped(True)


def test_ungapped_lambda():
    even = dict.fromkeys("ACGT", 0.25)
    lam = stats.ungapped_lambda(even, 2, -3)
    assert abs(lam - 0.6337) < 1e-3
    assert abs(0.25 * math.exp(2 * lam) + 0.75 * math.exp(-3 * lam) - 1) < 1e-9


def test_estimated_parameters_are_near_known_ones():
    lam, k = stats.gumbel_parameters({"A": 0.25, "C": 0.25, "G": 0.25, "T": 0.25}, SearchConfig())
    assert 0.5 < lam <= 0.634 and 0.02 < k <= 1
    again = stats.gumbel_parameters(dict.fromkeys("ACGT", 0.25), SearchConfig(), seed=99)
    assert abs(again[0] - lam) < 0.04 * lam and abs(again[1] - k) < 0.35 * k
    assert stats.gumbel_parameters({}, SearchConfig(gumbel=(0.6, 0.3))) == (0.6, 0.3)


def test_least_score_falls_as_known_with_the_e_value():
    # a known series of least scores by E-value; the steps depend on lambda alone
    known = {1: 48, 1e-3: 60, 1e-7: 75, 1e-12: 95, 1e-15: 106}
    got = {e: stats.score_stats(dict.fromkeys("ACGT", 0.25), 10_000_000, 5_000, 500_000, 5_000, SearchConfig(evalue=e, gumbel=(0.6, 0.35))).minimal_score for e in known}
    assert all(abs((got[e] - got[1]) - (known[e] - known[1])) <= 2 for e in known)


def test_one_edit_is_that_of_plain_edit_distance(spark):
    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = random.Random(1)
    rows = []
    for _ in range(600):
        p = [rng.choice("ACGT") for _ in range(9)]
        t = list(p) + [rng.choice("ACGT")]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = [rng.choice("ACGT") for _ in range(rng.randrange(2))]
        t = (t + ["A"] * 10)[:10]
        rows.append(("".join(p), "".join(t)))
    df = spark.createDataFrame(rows, "p string, t string")
    for r in df.select("p", "t", seeds.one_edit(F.col("p"), F.col("t"), 9).alias("ok")).collect():
        assert r.ok == (min(lev(r.p, r.t[:n]) for n in (8, 9, 10)) <= 1)


def test_parts_restart_when_full(spark):
    refs = spark.createDataFrame([(0, k, "A" * n) for k, n in enumerate((118, 118, 118, 5000, 30))], "db int, ref_num long, seq string")
    rows = index.parts(refs, SearchConfig(part_mb=0.002)).orderBy("ref_num").collect()
    assert [r.part for r in rows] == [0, 0, 1, None, 1]


def test_index_letters(spark):
    df = spark.createDataFrame([("acgtuRYSWKMBDHVNnx-",)], "s string")
    r = df.select(encode.index_alphabet(F.col("s")), encode.seed_alphabet(F.col("s")), encode.align_alphabet(F.col("s"))).first()
    assert tuple(r) == ("ACGTTACGAGACAAAAAAA", "ACGTT" + "A" * 14, "ACGTT" + "N" * 14)
    names = spark.createDataFrame([(">>a b\tc",), ("@x\ty z",)], "h string").select(encode.display_id(F.col("h")), encode.sam_id(F.col("h"))).collect()
    assert [tuple(n) for n in names] == [("a", "a"), ("x\ty", "x")]


def _want(c, h, mate):
    h0, h1 = h
    side = ("fwd", "rev")[mate]
    if c.sout:
        group = "paired" if (h0 and h1 if h[mate] else not h0 and not h1) else "singleton"
        return ("aligned" if h[mate] else "other", f"{group}_{side}" if c.out2 else group)
    hit = (h0 or h1) if c.paired_in else (h0 and h1) if c.paired_out else h[mate]
    return ("aligned" if hit else "other", side if c.out2 else "all")


@pytest.mark.parametrize("options", [{}, {"paired_in": True}, {"paired_out": True}, {"out2": True}, {"out2": True, "paired_in": True}, {"out2": True, "paired_out": True}, {"sout": True}, {"sout": True, "out2": True}])
def test_routing_table(spark, options):
    c = SearchConfig(paired=True, **options)
    pairs = list(itertools.product((True, False), repeat=2))
    reads = spark.createDataFrame([(f"{p}_{m}", p, m) for p in range(4) for m in (0, 1)], "read_id string, pair_id long, mate int")
    hits = spark.createDataFrame([(f"{p}_{m}",) for p, h in enumerate(pairs) for m in (0, 1) if h[m]], "read_id string")
    for r in routing.routes(routing.with_hits(reads, hits), c).collect():
        assert (r.output, r.file) == _want(c, pairs[r.pair_id], r.mate), (options, r)


def test_denovo_routing_takes_denovo_mates_alone(spark):
    reads = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1)], "read_id string, pair_id long, mate int")
    ids = spark.createDataFrame([("a",), ("b",), ("d",)], "read_id string")
    got = {r.read_id: r.file for r in routing.denovo_routes(reads, ids, SearchConfig(paired=True, sout=True, out2=True)).collect()}
    assert got == {"a": "paired_fwd", "b": "paired_rev", "d": "singleton_rev"}


def test_best_and_first(spark):
    a = spark.createDataFrame([("q", 0, 10, 0), ("q", 1, 30, 1), ("q", 0, 30, 2), ("q", 1, 5, 3)], "read_id string, db int, score int, discovery_ord long")
    pick = lambda df: sorted(r.discovery_ord for r in df.collect())
    assert pick(select.best_n(a, 2)) == [1, 2] and pick(select.best_n(a, 1)) == [1] and pick(select.best_n(a, 0)) == [0, 1, 2, 3]
    assert pick(select.first_n(a, 2)) == [0, 1]
    assert sorted(tuple(r) for r in select.per_db(a).collect()) == [(0, 1, 0), (1, 0, 1)]
