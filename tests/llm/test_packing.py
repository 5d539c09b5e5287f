import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandloom.llm.bestfit_pack import BestFit, pack, pack_documents, runs
from strandloom.llm._bpe import vocabulary


def _plain(lengths, capacity, most):
    """The same rule over a list of open bins."""
    opened, made, out = [], 0, []  # (free, order), bins of equal free: the last one in goes first
    for n in lengths:
        fits = [b for b in opened if b[0] >= n]
        if fits:
            free = min(b[0] for b in fits)
            b = [x for x in opened if x[0] == free][-1]
            opened.remove(b)
            free, own = b
        else:
            if n < capacity and len(opened) >= most:
                low = min(x[0] for x in opened)
                opened.remove([x for x in opened if x[0] == low][-1])
            free, own = capacity, made
            made += 1
        out.append((own, capacity - free))
        if free - n:
            opened.append((free - n, own))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 8))
def test_bitset_follows_the_rule(lengths, most):
    bins = BestFit(40, most)
    assert [bins.place(n) for n in lengths] == _plain(lengths, 40, most)


def test_every_piece_is_placed_once(spark, odd_docs):
    rows = pack_documents(odd_docs, vocabulary("word_bpe_49k.json"), 1, 512, 4).collect()
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for r in odd_docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512


def test_no_documents(no_docs):
    assert pack_documents(no_docs, vocabulary("word_bpe_49k.json")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 7))
def test_runs_do_not_depend_on_batches(sizes, size):
    rows = list(range(sum(sizes)))
    ends = np.cumsum([0, *sizes])
    batches = [pa.record_batch({"x": pa.array(rows[a:b], pa.int64())}) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert [b.column("x").to_pylist() for b in runs(iter(batches), size)] == [rows[k : k + size] for k in range(0, len(rows), size)]


def test_equal_rows_spread_over_tasks_and_bins_fill(spark):
    rows = [(None, 0, 0, 700, 5)] * 3000 + [(k, 0, 0, 100 + k % 900, k) for k in range(3000)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(cut, 1000, 16, per_task=1500, run=64).collect()
    assert len(out) == len(rows)
    tasks = {}
    for r in out:
        tasks.setdefault(r.sequence_id >> 40, []).append(r.doc_id is None)
    assert len(tasks) == 4 and all(300 < sum(x) < 1200 for x in tasks.values())
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
        assert sum(n for _, n in own) <= 1000
