"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ["minmax", "brown", "secrets", "html", "toxicity", "tokens", "shards", "sketch", "balltree", "packing", "languages", "divergence", "importance"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load() -> None:
    for m in MODULES:
        import_module(f"entitylink.llm.q_{m}")


load()
