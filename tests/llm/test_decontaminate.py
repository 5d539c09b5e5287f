import random

import numpy as np
import pyarrow as pa

from strandloom.llm import _words
from strandloom.llm import decontaminate as D


def _score(a, b):
    """Smith-Waterman by the plain recurrence."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
    return max(map(max, h))


def test_alignment_is_the_plain_recurrence():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))]
        b = [[rng.randrange(1, 6) for _ in range(9)] for _ in range(3)]
        got = D.align(np.array(a, np.uint64), np.array(b, np.uint64)).tolist()
        assert got == [_score(a, x) for x in b]


def _made(seed=1):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((2, 12, 40, 150))))) for k in range(20)]
    docs = []
    for k in range(120):
        own = rng.choices(words, k=rng.choice((5, 60, 200)))
        if k % 3 == 0:
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice((0, 0, len(part) // 10, len(part) // 6))):
                part[rng.randrange(len(part))] = rng.choice(words)
            at = rng.randrange(len(own))
            own[at:at] = part
        docs.append((k, " ".join(own)))
    return docs, items


def test_contamination_is_that_of_aligning_everything(spark):
    docs, items = _made()
    want = set()
    for d, text in docs:
        for i, item in items:
            own = item.split()
            if len(own) < D.NGRAM:
                found = f" {item} " in f" {text} "
            else:
                row = _words.words(pa.array([text], pa.large_string()))[0][None, :]
                found = D.align(_words.words(pa.array([item], pa.large_string()))[0], row)[0] >= D.needed(len(own))
            if found:
                want.add((d, i))
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    kept = D.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in docs} - {d for d, _ in want}


def test_joins_by_shuffle_find_the_same(spark, monkeypatch):
    docs, items = _made(3)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r)[:3] for r in D.contaminated(d, b).collect()}
    kept = {r.doc_id for r in D.clean(d, b).collect()}
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert {tuple(r)[:3] for r in D.contaminated(d, b).collect()} == whole
    assert {r.doc_id for r in D.clean(d, b).collect()} == kept


def test_recall_on_edited_copies_and_the_share_of_seeds(spark):
    """Edited copies of the items in prose of a small vocabulary, against aligning everything."""
    rng = random.Random(12)
    words = [f"c{k}" for k in range(40)] * 25 + [f"r{k}" for k in range(1500)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((10, 20, 50))))) for k in range(40)]
    docs = []
    for k in range(400):
        own, part = rng.choices(words, k=120), rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, len(part) // 3 + 1)):
            at = rng.randrange(len(part))
            part[at : at + rng.choice((0, 1, 1, 1))] = [rng.choice(words)]
        own[40:40] = part if k % 2 else []
        docs.append((k, " ".join(own)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hashed = {i: _words.words(pa.array([t], pa.large_string()))[0] for i, t in items}
    want = {(k, i) for k, t in docs for row in [_words.words(pa.array([t], pa.large_string()))[0][None, :]] for i, own in hashed.items() if D.align(own, row)[0] >= D.needed(len(own))}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    assert got <= want and 120 < len(want) < 250 and len(got) >= 0.97 * len(want)
    grams = D.item_grams(D.benchmark_items(b))
    known = D.Filter.of(grams.select("gram").distinct())
    sown = D.seeds(grams, D.gram_counts(d, known, []).join(grams.select("gram").distinct(), "gram", "left_semi"))
    assert sown.where("rare").count() < 0.36 * grams.count()


def test_counts_are_plain_counts(spark):
    docs, items = _made(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    grams = D.item_grams(D.benchmark_items(b))
    counts = D.gram_counts(d, D.Filter.of(grams.select("gram").distinct()), []).collect()
    plain, around = {}, {}
    for _, t in docs:
        h = _words.words(pa.array([t], pa.large_string()))[0]
        g = _words.ngrams(h, np.array([0, len(h)]), D.NGRAM)[0].view(np.int64).tolist()
        w = t.split()
        for k, x in enumerate(g):
            plain[x] = plain.get(x, 0) + 1
            around.setdefault(x, set()).add((w[k - 1] if k else None, w[k + 3] if k + 3 < len(w) else None))
    asked = {r.gram for r in grams.where("NOT short").collect()}
    got = {r.gram: (r.n, bin(r.bits & (1 << 64) - 1).count("1")) for r in counts if r.gram in asked}
    assert {x: n for x, (n, _) in got.items()} == {x: n for x, n in plain.items() if x in asked}
    assert all(bits <= len(around[x]) and (len(around[x]) > 2 or bits >= 1) for x, (_, bits) in got.items())


def test_odd_cases(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the cat sat on the mat"), (3, "the cat sat on the mat"), (None, "x y z")], "item_id long, text string")
    rows = D.contaminated(odd_docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 3)] * 4
    assert D.clean(odd_docs, items).count() == odd_docs.count() - 2
    assert D.clean(odd_docs, items).columns == odd_docs.columns
    assert D.contaminated(no_docs, items).count() == 0
    assert D.contaminated(odd_docs, items.limit(0)).count() == 0


def test_hot_copies_with_every_fourth_word_changed(spark):
    item = [f"v{k}" for k in range(40)]
    changed = [w if k % 4 else f"x{k}" for k, w in enumerate(item)]
    docs = [(k, " ".join([f"a{k}", *changed, f"b{k}"])) for k in range(30)] + [(30, " ".join(item)), (31, "nothing of it")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in D.contaminated(d, b).collect()) == list(range(31))
    assert [r.doc_id for r in D.clean(d, b).collect()] == [31]
