"""The global order of elements that prefix filters share.

Each value is a set of elements and a pair can only qualify when it shares at least
``alpha`` of them. With one global order of elements (fewest possible pairs first),
such a pair must meet inside the first ``n - alpha + 1`` elements of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.session import materialize

IDS = ["source", "target"]
EPS = 1e-9
# One shared element more is asked for in the prefixes per so many needed in all: the
# prefixes grow by as many elements, and far fewer pairs share enough of them.
EXTRA = 16


def up(x: Column) -> Column:
    """ceil with slack for rounding: never larger than the true ceiling."""
    return F.ceil(x - EPS).cast("int")


def extra(alpha: Column) -> Column:
    """Shared elements asked for in the prefixes of a pair that needs ``alpha`` in all."""
    return F.greatest(F.floor(alpha / EXTRA), F.lit(1)).cast("int")


def element_stats(values: DataFrame) -> DataFrame:
    """Per element: values holding it on each side, and entities behind them."""
    return (
        values.select(*IDS, "n_source", "n_target", F.explode("elems").alias("elem"))
        .groupBy("elem")
        .agg(
            F.count("source").alias("df_s"),
            F.count("target").alias("df_t"),
            F.count("*").alias("df"),
            F.sum(F.col("n_source") + F.col("n_target")).alias("entities"),
        )
    )


def numbered_elements(stats: DataFrame, by: str = "pairs") -> DataFrame:
    """Elements of both sides with their number in the global order, from 0 without gaps: a range
    sort, written out, then numbers that start in each of its partitions where the last one ended."""
    # decimal: a product of two counts can pass 64 bits
    product = F.col("df_s").cast("decimal(19,0)") * F.col("df_t").cast("decimal(19,0)")
    rank = product.cast("decimal(38,0)") if by == "pairs" else F.col("entities")
    shared = stats.where((F.col("df_s") > 0) & (F.col("df_t") > 0)).orderBy(rank, "elem")
    rows = materialize(shared.select("elem", "df_s", "df_t", "df", "entities", F.monotonically_increasing_id().alias("_no")), "numbered")
    part, at = F.shiftright("_no", 33), F.col("_no").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_own"))  # one row per partition
    sizes = sizes.select("_part", (F.sum("_own").over(Window.orderBy("_part")) - F.col("_own")).alias("_before"))
    rows = rows.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return rows.select("elem", "df_s", "df_t", "df", "entities", (F.col("_before") + at).alias("no"))


def with_sides(pairs: DataFrame, table: DataFrame, **columns: Column) -> DataFrame:
    """Attach expressions over ``table`` (one row per value) to both ends of a pair.

    Each keyword ``x=expr`` yields ``x_s`` and ``x_t``.
    """
    s = table.where(F.col("source").isNotNull()).select("source", *[c.alias(f"{k}_s") for k, c in columns.items()])
    t = table.where(F.col("target").isNotNull()).select("target", *[c.alias(f"{k}_t") for k, c in columns.items()])
    return pairs.join(s, "source").join(t, "target")
