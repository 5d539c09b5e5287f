"""The stages of the pipeline alone, on odd tables, and all of them against plain Python."""

import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_jaccard import _brute
from tokenizers import Tokenizer

from strandloom.llm import _words
from strandloom.llm import decontaminate as D
from strandloom.llm import quality_gbt as Q
from strandloom.llm import secret_scan as S
from strandloom.llm._bpe import vocabulary

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "naïve café 東京"), (None, "x y z")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_and_empty_tables(spark, odd_docs, no_docs, odd_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got, none = stage(spark, odd_docs, odd_dir), stage(spark, no_docs, odd_dir)
    rows = got.collect()
    assert none.count() == 0 and none.columns == got.columns
    if name != "packing":
        assert got.columns == odd_docs.columns
    kept = {"quality": 8, "dedup": 7, "decontam": 7, "secrets": 8}
    assert len(rows) == kept[name] if name in kept else {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}


def test_pipeline_is_that_of_plain_steps(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trees = Q.fit(docs, spark.read.parquet(f"{TABLES}/labels.parquet"))
    scores = trees.scores(Q.statistics(pa.array([t or "" for _, t in rows], pa.large_string())))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= Q.ACCEPT]
    rows = [r for r, (i, c, _) in zip(sorted(rows), _brute(sorted(rows)), strict=True) if i == c]
    hashed = [_words.words(pa.array([r.text], pa.large_string()))[0] for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect() if r.text]
    clean = lambda t: all(D.align(own, _words.words(pa.array([t], pa.large_string()))[0][None, :])[0] < D.needed(len(own)) for own in hashed)
    rows = [r for r in rows if not r[1] or clean(r[1])]
    e, plain = S.TokenEfficiency(vocabulary("byte_bpe_50k.tiktoken")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        t = t and S.mask(t, S.base_spans(t) + S.random_spans(t, e))
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, TABLES).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and 20 < len(rows) < 200
