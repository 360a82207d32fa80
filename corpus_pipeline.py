"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``:

1. toxicity      documents whose expected severity reaches the threshold go
2. near_copies   of each group of near-duplicate documents the smallest doc_id stays
3. secrets       secrets in the text are masked; no document goes
4. mixing        documents are repeated or dropped so that sources meet their targets
5. packing       token pieces of what is left, placed in sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import jaccard, mixing, packing, secret_scan, toxicity
from tidewater.llm.shared import landed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(spark, docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, packing.pieces(spark, docs))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: A learned filter and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
