"""The driver tables as entities, and the same views in SQL.

documents: two datasets by crawl source (src0-src9 against src10-src19).
pages: two datasets by protocol; the title is the short text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    number = F.substring("source", 4, 10).cast("int")
    return d.where(number < 10).drop("source"), d.where(number >= 10).drop("source")


def pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), title.alias("title"), "url")
    return (
        p.where(F.col("url").startswith("https:")).drop("url"),
        p.where(~F.col("url").startswith("https:")).drop("url"),
    )


SQL_DOCUMENTS = """
ds AS (SELECT doc_id AS id, text AS value FROM documents WHERE CAST(substr(source, 4) AS INT) < 10),
dt AS (SELECT doc_id AS id, text AS value FROM documents WHERE CAST(substr(source, 4) AS INT) >= 10)"""

SQL_PAGES = """
p AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS value, url FROM pages),
ds AS (SELECT id, value FROM p WHERE starts_with(url, 'https:')),
dt AS (SELECT id, value FROM p WHERE NOT starts_with(url, 'https:'))"""

# distinct values of both sides with the smallest id and the entity count
SQL_VALUES = """
vs AS (SELECT value, min(id) AS source, count(*) AS n_source FROM ds GROUP BY value),
vt AS (SELECT value, min(id) AS target, count(*) AS n_target FROM dt GROUP BY value)"""
