"""Every query with SQL gives the rows of its SQL in DuckDB, on the smallest tables."""

import os
import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from strandloom.plans import bindings

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(bindings.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    mine = contract.queries()[name](spark, TABLES)
    sql = duck.sql(contract.oracle_sql()[name])
    names = sorted(mine.columns)
    assert names == sorted(sql.columns)
    rows = Counter(tuple(r[c] for c in names) for r in mine.collect())
    assert rows == Counter(tuple(r) for r in sql.select(*[f'"{c}"' for c in names]).fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_whole_search_finds_planted_items(spark):
    found = contract.queries()["alignments"](spark, TABLES).collect()
    exact = {(str(r.read_id), r.ref_num) for r in contract.queries()["seed_exact_counts"](spark, TABLES).collect()}
    assert exact <= {(r.read_id, r.ref_num) for r in found}


def test_whole_search_takes_whole_documents(spark, tmp_path):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("ABCD", k=n))
    short, long = letters(40), letters(240)
    docs = [(1, "a", letters(80) + short + letters(80)), (2, "a", letters(130) + long + letters(130)), (3, "a", letters(300))]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, short), (1, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {(r.read_id, r.ref_num, r.score, r.read_begin, r.read_end, r.read_len) for r in contract.queries()["alignments"](spark, str(tmp_path)).collect()}
    assert {("1", 0, 80, 80, 119, 200), ("2", 1, 480, 130, 369, 500)} <= rows
