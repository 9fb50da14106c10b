"""Corpus pipeline: toxicity, near-duplicates, secrets, packing.

Every stage works on the rows its predecessor kept; all but the last return the
columns of ``documents``. The packed pieces come last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylink.llm import minmax, packing, secrets, toxicity
from entitylink.session import materialize


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the grammar does not call toxic; it learns from labels not held out."""
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    return toxicity.clean(docs, model, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minmax.deduplicated(docs, percent=75)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    clean = secrets.redacted(docs, secrets.trained(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 1024."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", toxic_documents), ("minmax dedup", near_duplicates), ("secrets", secret_spans), ("packing", packed_windows)]
ORACLE_SQL = None  # trained models and token ids; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
