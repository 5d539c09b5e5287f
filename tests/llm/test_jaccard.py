import random
import re

import numpy as np
import pytest

from strandloom.llm import jaccard_join as J


def _set(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows):
    """(class_id, links) of each row by comparing all pairs."""
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        ids[r] = min(ids.get(r, i), i)
    return sorted((rows[k][0], ids[find(k)], links[k]) for k in range(len(rows)))


def _corpus(seed, groups, copies):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    rows, at = [], 0
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice((6, 30, 120)))
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.choice((1, 2, copies))):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((at, " ".join(own)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "size"), [(512, 1 << 24), (3, 1 << 24), (512, 2000)])
def test_join_is_that_of_all_pairs(spark, monkeypatch, block, size):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCK_BYTES", size)
    rows = [*_corpus(5, 30, 9), (900, "one two"), (901, "one two"), (902, ""), (903, "..")]
    got = J.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == _brute(rows)


def test_odd_cases(odd_docs, no_docs):
    got = {(r.doc_id, r.class_id, r.n_links) for r in J.join_documents(odd_docs).collect()}
    assert {(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (None, None, 0)} == got
    assert J.join_documents(no_docs).collect() == []
    kept = J.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert J.one_of_each(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = _corpus(8, 12, 6)
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted({c for _, c, _ in _brute(rows)})


def test_a_doc_id_of_two_texts_stays_for_each_class(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (2, one + " more"), (3, two), (4, three), (1, three), (1, one), (5, None), (5, "x y z"), (None, one)]
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (1, two), (1, three), (5, None), (5, "x y z"), (None, one)], key=str)
    rows = [(1, one), (2, two), (2, one + " more"), (3, two)]
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, one), (2, two)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(1001, 1000)], "node long, root long")
    got = {r.node: r.root for r in J.components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 301)) and got[1001] == 1000


def test_unfinished_components_are_an_error(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)], "node long, root long")
    with pytest.raises(RuntimeError, match="not converged in 2 rounds"):
        J.components(edges, rounds=2)
    assert J.components(edges.limit(0)).count() == 0


def test_exact_similarity_of_any_sets():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, most, rng.integers(1, 300)).astype(np.uint64)) for most in (40, 300, 300, 90, 5000) for _ in range(8)]
    sets += [sets[3], sets[12]]
    left, right = np.triu_indices(len(sets), 1)
    for t in (0.8, 0.5):
        want = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= t for a, b in zip(left, right, strict=True)]
        assert J.verify(sets, left, right, t).tolist() == want and any(want)


def test_long_near_copies_stay_within_tiles_of_bytes(spark, monkeypatch):
    """A hundred near copies of 3,000 words against all pairs, in tiles of a few members."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 200_000)
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(3000)]
    rows = []
    for k in range(100):
        own = list(base)
        for _ in range(rng.randrange(70)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
        rows.append((k, " ".join(own)))
    got = J.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == _brute(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    least = J.least_matches()
    lost = 0
    for _ in range(400):
        core = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((core, rng.integers(0, 1 << 63, 20, dtype=np.uint64)))) for _ in range(2))
        s = np.stack([J.minhash(x).astype(np.uint8) for x in (a, b)])
        left, _ = J.prune(s, np.zeros((2, J.BANDS), np.int32), 0, np.array([0]), np.array([1]), least)
        lost += not len(left)
    assert lost == 0


def test_unlike_pairs_are_pruned():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 150, dtype=np.uint64)) for _ in range(60)]
    s = np.stack([J.minhash(x).astype(np.uint8) for x in sets])
    left, right = np.triu_indices(60, 1)
    assert len(J.prune(s, np.zeros((60, J.BANDS), np.int32), 0, left, right, J.least_matches())[0]) == 0
