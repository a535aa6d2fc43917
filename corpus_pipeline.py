"""Corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a table written and read again, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from splatlake.llm import minhash, packing, quality_model, quality_rules, secret_scan
from splatlake.llm.common import scratch_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules reject go."""
    return quality_rules.keep_passing(docs, table(spark, sf_dir, "labels"))


def reject_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays."""
    return minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; every document stays."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", reject_by_rules), ("quality_model", reject_by_model), ("near_copies", drop_near_copies), ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the learned stages and the tokenizer are beyond SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
