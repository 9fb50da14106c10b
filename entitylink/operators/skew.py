"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.session import materialize

# A key is spread so that no part holds more than 1/PARTS of all rows. The sum of
# the shares is 1, so fewer than PARTS keys can need it: that is the proven bound
# of the broadcast below.
PARTS = 1000
# Rows per side of one block that are paired inside one task.
CHUNK = 2000


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, spread_by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key).

    ``weight`` is the table column that says how many rows hold the key. ``table``
    is read three times, so hand over something cheap to read again.
    """
    total = table.agg(F.sum(weight)).scalar()
    parts = F.ceil(F.col(weight) * PARTS / total).cast("int")
    table = table.withColumn("_parts", F.greatest(parts, F.lit(1)))
    hot = table.where(F.col("_parts") > 1).select(key, "_parts")
    salted = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.expr("pmod(xxhash64({}), coalesce(_parts, 1))".format(", ".join(spread_by))).cast("int")
    )
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return salted.drop("_parts").join(table.drop("_parts"), [key, "_salt"]).drop("_salt")


def pair_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_id: str,
    right_id: str,
    n_left: str,
    n_right: str,
    condition: Column | None = None,
) -> DataFrame:
    """Join on ``key``, cutting big groups into a grid of CHUNK x CHUNK tiles.

    Both inputs carry the group's row counts ``n_left`` and ``n_right``. Each row of
    one side is repeated once per tile row/column of the other side.
    """

    def parts(n: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / CHUNK), F.lit(1)).cast("int")

    def tile(df: DataFrame, own: str, own_id: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(own_id), parts(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), parts(other_n) - 1))
        )

    left = tile(left, "_lt", left_id, n_left, "_rt", n_right).drop(n_left, n_right)
    right = tile(right, "_rt", right_id, n_right, "_lt", n_left).drop(n_left, n_right)
    joined = left.join(right, [key, "_lt", "_rt"]).drop("_lt", "_rt")
    return joined if condition is None else joined.where(condition)


def sized(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the group sizes ``_n_left`` and ``_n_right`` that ``pair_join`` needs.

    Keys alone are counted, and only groups beyond CHUNK keep their sizes (1 elsewhere), so
    the rows themselves are not shuffled for it. Both inputs are read twice.
    """
    names = ["_n_left", "_n_right"]
    counts = [df.groupBy(key).agg(F.count("*").alias(n)) for df, n in zip((left, right), names)]
    big = materialize(counts[0].join(counts[1], key).where((F.col(names[0]) > CHUNK) | (F.col(names[1]) > CHUNK)), "big-keys")
    if big.isEmpty():
        return tuple(df.withColumns({n: F.lit(1) for n in names}) for df in (left, right))
    return tuple(df.join(big, key, "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in names}) for df in (left, right))


def meet(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, condition: Column | None = None) -> DataFrame:
    """``pair_join`` of rows that do not carry the sizes of their groups."""
    return pair_join(*sized(left, right, key), key, left_id, right_id, "_n_left", "_n_right", condition)
