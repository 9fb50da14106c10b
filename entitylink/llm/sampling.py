"""Bounded samples that are the same each time and gather in no task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.session import materialize


def first_by_hash(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """One row for each of the first ``limit`` values of ``key`` by their md5.

    Only about four times ``limit`` values, those below a hash bound set by the row
    count, reach the sort; the bound is raised while they are too few. Rows with a
    null key are left out.
    """
    columns = rows.columns
    hashed = rows.withColumn("_order", F.md5(key.cast("string").cast("binary"))).where(F.col("_order").isNotNull())
    n = max(rows.count(), 1)
    share = min(1.0, 4.0 * limit / n)
    while True:
        below = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") < int(share * 2**32)
        near = hashed.where(below).groupBy("_order").agg(F.min(F.struct(*columns)).alias("row"))
        near = materialize(near, "sample")
        if share >= 1.0 or near.limit(limit).count() >= limit:
            return near.orderBy("_order").limit(limit).select("row.*")
        share = min(1.0, 8 * share)
