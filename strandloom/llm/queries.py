"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bestfit_pack, decontaminate, ef_tokens, hilbert_shard, html_layout, jaccard_join, lang_rank, quality_gbt, secret_scan, topk_search
from strandloom.llm._bpe import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_pages(_table(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_pack.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef_tokens.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.k <> q.k AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_rank.identify(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shard.shard_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_gbt": op1,
        "op2_html_layout": op2,
        "op3_benchmark_alignment": op3,
        "op4_bestfit_packing": op4,
        "op5_elias_fano_tokens": op5,
        "op6_bayes_jaccard": op6,
        "op7_norm_bucket_topk": op7,
        "op8_secret_token_efficiency": op8,
        "op9_rank_order_language": op9,
        "op10_hilbert_shards": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_norm_bucket_topk": OP7_SQL}
