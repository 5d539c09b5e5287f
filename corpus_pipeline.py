"""The corpus pipeline: five stages over documents, each written and read again by the next.

quality   documents that the quality trees reject go
dedup     one document of each near-duplicate group stays
decontam  documents that hold a benchmark item go
secrets   secrets in the texts are masked; all documents stay
packing   documents are packed into sequences; one row for each piece
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bestfit_pack, decontaminate, jaccard_join, quality_gbt, secret_scan
from strandloom.llm._bpe import vocabulary
from strandloom.llm._shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gbt.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers that earlier stages have used are large already: less memory here, for a little more time
    return bestfit_pack.pack_documents(docs, vocabulary("word_bpe_49k.json"), cache=150_000, batch_bytes=1 << 20)


STAGES = [("quality", quality), ("dedup", dedup), ("decontam", decontam), ("secrets", secrets), ("packing", packing)]

#: The stages read texts by a fitted model, tokenizers and alignments: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
