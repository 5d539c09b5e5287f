"""Piece encoding against the library, Elias-Fano against plain arrays, files against direct encoding."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandloom.llm import ef_tokens
from strandloom.llm._bpe import PieceEncoder, vocabulary

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["a  b", "  lead", " one", "x\n y", "tab\t z", "é É ſ İ", "", "  ", "a\x1c b", "<|endoftext|> hi", "it's 'tis don't we'LL", "a 　 b", "x²½ a1b2c3", "Σας ΟΔΟΣ", "ét́", "tail. tail, .", "😀 x", None]
PARTS = ["a", "b", " ", " ", "  ", "Ze", ".", ",", "'s", "\n", "é", "1", "²", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "endoftext", "\u0338", "\u3000"]
_made = {}


def _pair(name, as_text=False):
    if (name, as_text) not in _made:
        plain = Tokenizer.from_file(vocabulary(name))
        if as_text:
            plain.encode_special_tokens = True
        _made[name, as_text] = (PieceEncoder(vocabulary(name), 2, special_as_text=as_text), plain)
    return _made[name, as_text]


def _same(name, texts, as_text=False):
    mine, plain = _pair(name, as_text)
    ids, at = mine.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], t


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_whole_texts(name):
    _same(name, ODD)
    _same(name, ODD[::-1])


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(NAMES), st.lists(st.text(st.sampled_from("ab Ze.,'!\n\t é1s ²"), max_size=24), min_size=1, max_size=6))
def test_any_text_gives_the_librarys_ids(name, texts):
    _same(name, texts)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(NAMES), st.booleans(), st.lists(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), min_size=1, max_size=6))
def test_special_strings_are_what_the_library_makes_of_them(name, as_text, texts):
    _same(name, texts, as_text)


def test_special_strings_are_their_tokens():
    for name, token in zip(NAMES, (50256, 49407), strict=True):
        ids, _ = _pair(name)[0].encode(pa.array(["x <|endoftext|>y"]))
        assert token in ids.tolist()


def test_a_vocabulary_of_another_kind_is_left_to_the_library(tmp_path):
    from tokenizers import Regex, normalizers, pre_tokenizers

    for k, change in enumerate((lambda t: setattr(t, "normalizer", normalizers.NFKC()), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.Split(Regex("b"), "isolated")), lambda t: t.add_tokens(["lead one"]))):
        plain = Tokenizer.from_file(vocabulary(NAMES[0]))
        change(plain)
        plain.save(f"{tmp_path}/{k}.json")
        mine = PieceEncoder(f"{tmp_path}/{k}.json", 2)
        assert mine.whole
        ids, at = mine.encode(pa.array(ODD, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=900))
def test_elias_fano_selects_what_was_put_in(gaps):
    values = np.cumsum(gaps)
    made = ef_tokens.EliasFano.from_bytes(ef_tokens.EliasFano.of(values).to_bytes())
    assert made.all().tolist() == values.tolist()
    for i in {0, len(values) - 1, len(values) // 2, *range(0, len(values), 97)}:
        assert made.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 700))
    assert len(ef_tokens.EliasFano.of(values).to_bytes()) * 8 / 10_000 < 2 + np.log2(700) + 1


def test_segment_random_access():
    ids = np.arange(10, dtype=np.uint16)
    s = ef_tokens.Segment.of_bytes(ef_tokens.encode_segment(np.array([0, -(1 << 63), (1 << 63) - 1]), 1, np.array([1, 4, 10]), ids, False))
    assert s.doc_ids() == [None, -(1 << 63), (1 << 63) - 1]
    assert s.document(0).tolist() == [0] and s.document(1).tolist() == [1, 2, 3] and s.document(2).tolist() == [4, 5, 6, 7, 8, 9]
    assert [x.tolist() for x in s.with_id((1 << 63) - 1)] == [[4, 5, 6, 7, 8, 9]] and s.with_id(7) == []
    with pytest.raises(ValueError, match="no token segment"):
        ef_tokens.Segment.of_bytes(b"\0" * 96)


def test_one_document_is_read_from_its_place(spark, odd_docs):
    manifest = ef_tokens.write_segments(odd_docs, vocabulary(NAMES[0]), 2, segment_tokens=100)
    _, plain = _pair(NAMES[0])
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for doc_id in (1, 2, 6):
        want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts[doc_id]]
        assert [x.tolist() for x in ef_tokens.read_document(manifest, doc_id)] == want
    assert ef_tokens.read_document(manifest, 77) == []
    names = {r.path.rpartition("/")[2] for r in manifest.collect()}
    assert len(names) == manifest.count() > 1 and not any(n.startswith("_") for n in names)


@pytest.mark.parametrize("hot", ["NULL", "1700"])
def test_a_third_of_equal_rows_is_cut_between(spark, monkeypatch, hot):
    monkeypatch.setattr(ef_tokens, "PART_BYTES", 4000)
    docs = spark.range(3000).selectExpr("id", f"CAST({hot} AS BIGINT) AS hot").selectExpr("CASE WHEN id % 3 = 0 THEN hot ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one and the same' ELSE concat('text of its own ', id) END AS text")
    manifest = ef_tokens.write_segments(docs, vocabulary(NAMES[0]), 2)
    assert manifest.groupBy("part").sum("documents").agg({"sum(documents)": "max"}).first()[0] < 900
    rows = ef_tokens.read_segments(manifest).orderBy("start").collect()
    assert len(rows) == 3000 and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_round_trip_is_that_of_direct_encoding(spark, odd_docs):
    rows = ef_tokens.round_trip(odd_docs, vocabulary(NAMES[0]), 2, segment_tokens=5_000).collect()
    _, plain = _pair(NAMES[0])
    docs = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    want = []
    for r in docs:
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, rows), key=key) == want


def test_no_documents(no_docs):
    assert ef_tokens.round_trip(no_docs, vocabulary(NAMES[0])).collect() == []
