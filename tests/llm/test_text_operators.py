"""Secret scan, language ranks, quality trees and Hilbert shards."""

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import hilbert_shard as H
from strandloom.llm import lang_rank as L
from strandloom.llm import quality_gbt as Q
from strandloom.llm import secret_scan as S
from strandloom.llm._bpe import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.tiktoken")


def _base(text):
    out = []
    for k, (_, p, flags, group, least) in enumerate(S.BASE):
        for m in re.finditer(p, text, flags):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "API-KEY", "=", ": ", '"', "'", "abc", "deadbeef" * 4, "AKIA", "ABCDEFGHIJ0123456789", " ", "é", "x1", "ſecret=abcdefg", "K"]), max_size=14))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert S.base_spans(text) == _base(text)


def test_random_strings_and_known_ones():
    e = S.TokenEfficiency(VOCABULARY)
    secret = "x9Qv7LmZ2pTfWk4RbN8s"
    text = f"key {secret} then id user_session_handler_2024 and {'a' * 30} {hashlib.md5(b'1').hexdigest()} 123e4567-e89b-12d3-a456-426614174000 4041894974608795 2024-01-15T10-20-30 a/b/c/2024/01/15/page me.some.one.long2@example.com"
    assert [text[s:t] for s, _, t in S.random_spans(text, e)] == [secret]
    assert S.mask(text, S.random_spans(text, e)).startswith("key [SECRET] then")


@pytest.mark.parametrize("letters", [string.ascii_letters, string.ascii_uppercase, string.ascii_letters + "+/"])
def test_random_strings_without_a_digit(letters):
    rng, e = random.Random(3), S.TokenEfficiency(VOCABULARY)
    keys = ["".join(rng.choice(letters) for _ in range(20)) for _ in range(300)]
    whole = [S.random_spans(f"key {k} then", e) == [(4, len(S.BASE), 24)] for k in keys]
    assert sum(whole) >= 290
    words = "internationalization INTERNATIONALIZATION getElementsByTagName Rechtsschutzversicherungsgesellschaften ---------------- someone-with-long-name@example.com /usr/local/share/applications"
    assert S.random_spans(words, e) == []


def test_scan_rows(odd_docs, no_docs):
    rows = S.scan_documents(odd_docs, VOCABULARY).collect()
    assert len(rows) == odd_docs.count() and all(r.n_assign == r.n_access == r.n_hex == 0 for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert S.scan_documents(no_docs, VOCABULARY).count() == 0


def test_masking_keeps_rows_and_columns(spark, odd_docs):
    out = S.mask_documents(odd_docs, VOCABULARY)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    one = spark.createDataFrame([(1, "token = 'abcdef123' and é password=zzzzzz")], "doc_id long, text string")
    assert S.mask_documents(one, VOCABULARY).first().text == "[SECRET]' and é [SECRET]"


def _profile(texts, most):
    count = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f"\x01{w}\x01"
            count.update(w)
            count.update(padded[k : k + 2] for k in range(len(padded) - 1))
            count.update(padded[k : k + 3] for k in range(len(padded) - 2))
    rank = sorted(count, key=lambda g: (-count[g], g.rjust(3, "\0")))[:most]
    return {g: k for k, g in enumerate(rank)}


def test_ranks_are_those_of_plain_counts(spark):
    rng = random.Random(4)
    langs = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["kat", "hond", "vogel", "vis"]}
    rows = [(k, " ".join(rng.choices(w, k=12)), lang) for k, (lang, w) in enumerate(itertools.islice(itertools.cycle(langs.items()), 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    own = {lang: _profile([t for _, t, x in learned if x == lang], 50) for lang in langs}
    for r in L.identify(docs, size=50).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id)
        mine = _profile([text], 50)
        far = {lang: sum(abs(p[g] - k) if g in p else 50 for g, k in mine.items()) for lang, p in own.items()}
        best = min(sorted(far), key=far.get)
        assert (r.lang_pred, round(r.score, 9)) == (best, round(1 - far[best] / (50 * len(mine)), 9))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_odd_cases(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in L.identify(odd_docs).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[5].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 7
    assert L.identify(no_docs).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_trees_learn_and_flat_walk_is_the_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(float)
    t = Q.Trees.fit(x[:600], y[:600])
    s = t.scores(x[600:])
    assert ((s >= 0.5) == (y[600:] == 1)).mean() > 0.95
    for k in range(20):
        total = t.base
        for root in t.roots:
            at = root
            while t.left[at] != at:
                at = t.left[at] if x[600 + k, t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        assert abs(1 / (1 + np.exp(-total)) - s[k]) < 1e-9


def test_statistics_of_one_text_do_not_depend_on_its_batch():
    texts = ["A b c.\nA b c.", "", "!!! LOUD ### 123", "é" * 9, "one two three four five"]
    whole = Q.statistics(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], Q.statistics(pa.array([t], pa.large_string()))[0])
    assert whole.shape == (5, len(Q.FEATURES)) and np.isfinite(whole).all()


def _plain_statistics(t):
    """A few of the features by plain Python."""
    b, w = t.encode(), [x for x in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()]
    lines = t.split("\n")
    tri = list(zip(w, w[1:], w[2:]))
    return {
        "log_bytes": np.log1p(len(b)), "log_words": np.log1p(len(w)), "word_length": sum(len(x.encode()) for x in w) / max(1, len(w)),
        "upper": sum(65 <= x <= 90 for x in b) / max(1, len(b)), "digit": sum(48 <= x <= 57 for x in b) / max(1, len(b)), "newline": sum(x in b"\n\r" for x in b) / max(1, len(b)),
        "distinct_words": len(set(w)) / len(w) if w else 1, "top_word": max(map(w.count, w)) / len(w) if w else 0, "distinct_trigrams": len(set(tri)) / len(tri) if tri else 1,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 1 else 0, "long_words": sum(len(x.encode()) > 14 for x in w) / max(1, len(w)),
        "entropy": -sum(p * np.log2(p) for p in (b.count(x) / len(b) for x in set(b))) if b else 0,
    }


def test_statistics_are_plain_ones():
    texts = ["", "One two\nOne two\nthree", "é à 東京 x1 x1 x1 x1", "a" * 40 + " 12 12, END", " ".join(f"w{k % 7}" for k in range(300))]
    got = Q.statistics(pa.array(texts, pa.large_string()))
    for row, t in zip(got, texts, strict=True):
        for name, want in _plain_statistics(t).items():
            assert abs(row[Q.FEATURES.index(name)] - want) < 1e-5, (name, t[:20])


def test_first_split_is_the_best_of_all():
    """The root of the first tree by brute force over all features and bin edges."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = ((x[:, 2] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    t = Q.Trees.fit(x, y, trees=1, depth=1)
    g, h = y - y.mean(), y.mean() * (1 - y.mean())
    best = max(((gl := g[x[:, f] <= e].sum()) ** 2 / ((nl := (x[:, f] <= e).sum()) * h + 1) + (g.sum() - gl) ** 2 / ((300 - nl) * h + 1), f, e) for f in range(4) for e in np.unique(np.quantile(x[:, f], np.linspace(0, 1, Q.BINS + 1)[1:-1])) if 5 <= (x[:, f] <= e).sum() <= 295)
    assert (t.feature[0], t.threshold[0]) == (best[1], np.float32(best[2]))


def test_repeated_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * (1 + k % 3)) for k in range(60)] + [(7, f"other {j}") for j in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int")
    one, two = (Q.fit(d, labels, most=30) for d in (docs, docs.repartition(7)))
    x = np.random.default_rng(1).normal(size=(20, len(Q.FEATURES))).astype(np.float32)
    assert np.array_equal(one.scores(x), two.scores(x))


def test_quality_odd_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert Q.classify(no_docs, labels).count() == 0
    assert {r.score for r in Q.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert Q.accepted(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 100 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_hilbert_steps_go_to_a_neighbour(spark):
    for n, bits in ((2, 3), (3, 2)):
        size = 1 << bits
        points = list(itertools.product(range(size), repeat=n))
        df = spark.createDataFrame(points, [f"x{k}" for k in range(n)])
        rows = df.select("*", H.hilbert_index([F.col(f"x{k}") for k in range(n)], bits).alias("h")).collect()
        walk = [tuple(r)[:n] for r in sorted(rows, key=lambda r: r.h)]
        assert sorted(r.h for r in rows) == list(range(size**n))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(walk))


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(9)
    rows = [(k, "x" * rng.randrange(200) if k % 3 else "same text", rng.choice(["en", "fr", None]), f"s{k % 7}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = H.shard_documents(docs).collect()
    size = Counter()
    slots = {}
    for r in got:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    text = {i: t for i, t, _, _ in rows}
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert sorted(r.doc_id for r in got) == list(range(1500)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(abs(v - mean) for v in size.values()) <= 2 * max(201, mean / 20)


@pytest.mark.parametrize("hot", [7, None])
def test_a_third_of_the_same_row_is_cut_between(spark, hot):
    rows = [(k, f"text {k}", "en", "s") for k in range(600)] + [(hot, "same text", "en", "s")] * 300
    got = H.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 16
    assert len(got) == 900 and len(size) == 16 and max(abs(v - mean) for v in size.values()) <= 40


def test_random_parts_are_no_identifier():
    e = S.TokenEfficiency(VOCABULARY)
    rng = random.Random(4)
    part = lambda: "".join(rng.choices(string.ascii_lowercase, k=4)) + "".join(rng.choices(string.digits, k=4))
    found = sum(bool(S.random_spans("-".join(part() for _ in range(3)), e)) for _ in range(300))
    letters = sum(bool(S.random_spans("".join(rng.choices(string.ascii_letters, k=24)), e)) for _ in range(300))
    assert found > 240 and letters > 290
    assert S.random_spans("ghp_QwErTyUiOpAsDfGhJkLzXcVbNmQw is found", e) == [(0, 3, 32)]
    for name in ("user_profile-settings_v2", "src/main/java/com/example/App", "release-2024-candidate-17", "HTTPRequestHandlerFactory"):
        assert S.random_spans(name, e) == [], name


def test_all_rows_the_same_fill_all_shards(spark):
    for row in ((None, None, None, None), (5, "same", "en", "s")):
        got = H.shard_documents(spark.createDataFrame([row] * 4000, "doc_id long, text string, lang string, source string")).collect()
        rows = Counter(r.shard for r in got)
        assert len(got) == 4000 and len(rows) == 16 and max(rows.values()) <= 251


def test_cells_hold_equal_weight_in_order(spark):
    """By brute force: each value's cell from the weight of all smaller ones and half its own."""
    rng = random.Random(3)
    weights = {f"v{k}": rng.randrange(1, 50) for k in range(200)} | {"hot": 4000}
    rows = [(v, 1) for v, w in weights.items() for _ in range(w)] + [(None, 1)] * 30
    df = spark.createDataFrame(rows, "x string, w int")
    got = {r.x: r.c for r in df.select("x", H.quantised(F.col("x"), H.cuts(df, "x", "w", 4)).alias("c")).distinct().collect()}
    total, at = sum(weights.values()), 0
    for v in sorted(weights):
        assert got[v] == int((at + weights[v] / 2) * 16 / total), v
        at += weights[v]
    assert got[None] == 0
    assert H.cuts(df.limit(0), "x", "w", 4) == []


def test_cut_is_that_of_a_plain_walk(spark):
    """By brute force: rows in order of cell, group and tie; a group goes where it begins, a large one row by row."""
    rng = random.Random(8)
    rows = [(k, rng.randrange(16), rng.choice([k, k, 5000 + k % 40]), rng.randrange(1, 90)) for k in range(900)] + [(k, 3, 7777, 60) for k in range(900, 1200)]
    rows = [(i, g * 7 % 16 if g >= 5000 else x, g, n) for i, x, g, n in rows]
    df = spark.createDataFrame(rows, "doc_id long, x long, _group long, size long")
    got = {r.doc_id: r.shard for r in H.shard_by_curve(df, [F.col("x"), F.col("x") * 0], 4, "doc_id", 8).collect()}
    keyed = df.select("*", H.hilbert_index([F.col("x"), F.col("x") * 0], 4).alias("c"), F.xxhash64("doc_id", F.lit(7)).alias("t")).collect()
    total, largest = sum(r["size"] for r in keyed), max(r["size"] for r in keyed)
    sums, at, first, place = Counter(), 0, {}, {}
    for r in sorted(keyed, key=lambda r: (r.c, r._group, r.t, r.doc_id)):
        sums[r._group] += r["size"]
        first.setdefault(r._group, at)
        place[r.doc_id] = at
        at += r["size"]
    small = lambda g: sums[g] <= max(largest, total // 160)
    assert got == {r.doc_id: min(7, (first[r._group] if small(r._group) else place[r.doc_id]) * 8 // total) for r in keyed}


def test_filters_open_few_shards(spark):
    """The share of shards whose least and greatest value let in a language, a source or a range of sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("l"), F.col("source").alias("s"))
    rows = H.shard_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(docs, "doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)

    def opened(key, asked):
        spans = [(min(key(r) for r in own), max(key(r) for r in own)) for own in by.values()]
        return sum(low <= b and high >= a for a, b in asked for low, high in spans) / len(asked) / len(by)

    langs, sources = sorted({r.lang for r in rows}), sorted({r.source for r in rows})
    sizes = sorted(r["size"] for r in rows)
    assert opened(lambda r: r.lang, [(x, x) for x in langs]) < 0.5
    assert opened(lambda r: r.source, [(x, x) for x in sources]) < 0.7
    assert opened(lambda r: r["size"], [(sizes[k], sizes[min(k + 50, len(sizes) - 1)]) for k in range(0, len(sizes), 50)]) < 0.75


def test_shard_odd_cases(odd_docs, no_docs):
    rows = H.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.shard < 16 and r.grown_shard is None for r in rows)
    assert next(r for r in rows if r.doc_id == 2)["size"] == 1
    assert H.shard_documents(no_docs).count() == 0
