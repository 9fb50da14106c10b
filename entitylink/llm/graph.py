"""Connected components of a link table, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.session import materialize


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Edges (u, v) with the least of u and its partners. The least ones are written
    first, so the join that follows can split a node with very many partners."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component): every node of ``links`` with the smallest node it reaches.

    Each round hangs the larger partners of a node on its smallest one (large star),
    then its smaller ones (small star); rounds needed grow with the logarithm of the
    longest path. Rounds are written to the shared folder. Rows with a null end and
    loops link nothing. An empty table gives an empty one.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct()
    edges = materialize(edges, name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, name).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), name)
        small = _with_least(large, name)
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = materialize(small.where("u != v").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), name)
