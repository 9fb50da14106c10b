"""Algebra over scored links: columns source, target, sim, unique on the pair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.session import materialize

PAIR = ["source", "target"]
# Links that one task groups, on average: bounds its memory whatever the input.
GROUPED = 1 << 20


def dealt(links: DataFrame) -> DataFrame:
    """Links by their pair, in more parts than shuffles have where those would pass GROUPED.

    The links are counted, so hand over something cheap to read again.
    """
    parts = math.ceil(links.count() / GROUPED)
    few = parts <= int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links if few else links.repartition(parts, *PAIR)


def unique_links(links: DataFrame) -> DataFrame:
    """Insert rule: a pair given twice keeps its larger similarity."""
    return dealt(links).groupBy(*PAIR).agg(F.max("sim").alias("sim"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR, F.col("sim").alias("_a")).join(b.select(*PAIR, F.col("sim").alias("_b")), PAIR)


def links_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).select(*PAIR, F.least("_a", "_b").alias("sim"))


def links_or(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = (materialize(x.select(*PAIR, "sim"), "links") for x in (a, b))
    return unique_links(a.unionByName(b))


def links_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*PAIR, "sim").join(b.select(*PAIR), PAIR, "left_anti")


def links_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in exactly one of the two: one shuffle, a pair seen once survives."""
    a, b = (materialize(x.select(*PAIR, "sim"), "links").withColumn("m", F.lit(m)) for x, m in ((a, 1), (b, 2)))
    both = dealt(a.unionByName(b)).groupBy(*PAIR).agg(F.max("sim").alias("sim"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    return both.where("lo = hi").select(*PAIR, "sim")


def links_add(a: DataFrame, b: DataFrame, c1: float, c2: float, theta: float) -> DataFrame:
    """c1*s1 + c2*s2 on common pairs. Each input is cut at what it must reach at least."""
    a = a.where(F.col("sim") >= (theta - c2) / c1 - 1e-12)
    b = b.where(F.col("sim") >= (theta - c1) / c2 - 1e-12)
    total = F.col("_a") * c1 + F.col("_b") * c2
    return _both(a, b).select(*PAIR, total.alias("sim")).where(F.col("sim") >= theta)


def links_mult(a: DataFrame, b: DataFrame, c1: float, c2: float, theta: float) -> DataFrame:
    total = F.col("_a") * F.col("_b") * (c1 * c2)
    return _both(a, b).select(*PAIR, total.alias("sim")).where(F.col("sim") >= theta)


def threshold(links: DataFrame, theta: float) -> DataFrame:
    return links if theta <= 0 else links.where(F.col("sim") >= theta)


def accept_review(links: DataFrame, accept: float, review: float) -> DataFrame:
    """Review file: all links over the review threshold. Accepted ones are flagged."""
    return threshold(links, review).withColumn("accepted", F.col("sim") >= accept)


def best_one_to_n(links: DataFrame, by: str = "source") -> DataFrame:
    """Per source the targets with the largest sim, ties kept.

    Maximum by partial aggregation, then a join: a hot source is reduced before the
    shuffle and never sorted in one task.
    """
    top = links.groupBy(by).agg(F.max("sim").alias("sim"))
    return links.join(top, [by, "sim"]).select(*links.columns)


def best_one_to_one(links: DataFrame) -> DataFrame:
    """Best targets per source, then best sources per remaining target."""
    return best_one_to_n(best_one_to_n(links), by="target")


def best_target(links: DataFrame) -> DataFrame:
    """One target per source: largest sim, then smallest target id."""
    order = F.struct(-F.col("sim"), F.col("target"))
    return links.groupBy("source").agg(F.min_by("target", order).alias("target"), F.max("sim").alias("sim"))


def reverse(links: DataFrame) -> DataFrame:
    return links.select(F.col("target").alias("source"), F.col("source").alias("target"), "sim")


def scale(links: DataFrame, d: float) -> DataFrame:
    return links if d == 0 else links.withColumn("sim", F.col("sim") / d)


def trim(links: DataFrame) -> DataFrame:
    return links.withColumn("sim", F.least("sim", F.lit(1.0)))


def confidence(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Similarity of each asked pair, 0 when it is not linked."""
    found = pairs.join(links.select(*PAIR, "sim"), PAIR, "left")
    return found.select(*PAIR, F.coalesce("sim", F.lit(0.0)).alias("sim"))


def count_links(links: DataFrame) -> DataFrame:
    return links.agg(F.count("*").alias("links"))


def by_similarity(links: DataFrame) -> DataFrame:
    return links.groupBy("sim").agg(F.count("*").alias("links"))


def filter_by_rule(links: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, rule: Column, theta: float, main_theta: float) -> DataFrame:
    """Keep links whose pair also satisfies ``rule``; sim is the smaller of both.

    ``rule`` reads the entity columns as ``<name>_s`` and ``<name>_t``.
    """
    s = src.select(*[F.col(c).alias("source" if c == id_col else f"{c}_s") for c in src.columns])
    t = tgt.select(*[F.col(c).alias("target" if c == id_col else f"{c}_t") for c in tgt.columns])
    rows = links.select(*PAIR, "sim").join(s, "source").join(t, "target").withColumn("_rule", rule)
    rows = rows.where(F.col("_rule") >= theta).select(*PAIR, F.least("sim", "_rule").alias("sim"))
    return threshold(rows, main_theta)
