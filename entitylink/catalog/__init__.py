"""Registered queries: each reads the driver tables and has, where SQL can say it,
an equivalent SQL text.

A module registers with ``@query(name, sql)``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ["blocking", "joins", "prep", "links", "entities", "io", "space", "jobs"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    for m in MODULES:
        import_module(f"entitylink.catalog.{m}")
