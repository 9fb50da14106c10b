"""Distinct values of two datasets, and the way back to entities.

Similarity joins compare distinct values. ``value_table`` folds equal values of both
datasets into one row before any pair is formed, so a group of copies costs one row
however large it is. Links between values name the smallest id on each side and the
number of entities behind it; ``expand_links`` turns them into entity pairs.

An entity may have several values (several rows of the same id). A value's key is
therefore struct(id, h): the smallest id holding it and a hash of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.operators.skew import attach, pair_join
from entitylink.session import materialize

# Ids that stand together in one row of ``folded``.
FOLD = 1000


def _key(smallest: Column, value: Column) -> Column:
    return F.when(smallest.isNotNull(), F.struct(smallest.alias("id"), F.xxhash64(value).alias("h")))


def value_table(src: DataFrame, tgt: DataFrame, id_col: str, value: Column | str) -> DataFrame:
    """One row per distinct value: value, source, target (keys), n_source, n_target."""
    value = F.col(value) if isinstance(value, str) else value
    s = src.select(value.alias("value"), F.col(id_col).alias("sid"), F.lit(None).cast(tgt.schema[id_col].dataType).alias("tid"))
    t = tgt.select(value.alias("value"), F.lit(None).cast(src.schema[id_col].dataType).alias("sid"), F.col(id_col).alias("tid"))
    return (
        s.unionByName(t)
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(
            F.min("sid").alias("sid"),
            F.min("tid").alias("tid"),
            F.count("sid").alias("n_source"),
            F.count("tid").alias("n_target"),
        )
        .select(
            "value",
            _key(F.col("sid"), F.col("value")).alias("source"),
            _key(F.col("tid"), F.col("value")).alias("target"),
            "n_source",
            "n_target",
        )
    )


def with_counts(links: DataFrame, values: DataFrame) -> DataFrame:
    """Value links for output: source, target (smallest ids), sim, n_source, n_target, key_s, key_t."""
    s = values.where(F.col("source").isNotNull()).select("source", "n_source")
    t = values.where(F.col("target").isNotNull()).select("target", "n_target")
    return flat_links(links.join(s, "source").join(t, "target"))


def flat_links(links: DataFrame) -> DataFrame:
    return links.select(
        F.col("source.id").alias("source"),
        F.col("target.id").alias("target"),
        "sim",
        "n_source",
        "n_target",
        F.col("source.h").alias("key_s"),
        F.col("target.h").alias("key_t"),
    )


def value_members(df: DataFrame, id_col: str, value: Column | str) -> DataFrame:
    """(member, rep, n): every entity with the key of a value it holds."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(F.sha2(value.cast("string"), 256).alias("hash"), F.xxhash64(value).alias("h"), F.col(id_col).alias("member"))
    rows = materialize(rows.where(F.col("hash").isNotNull()), "hashes")  # ids and hashes: the values are read once
    reps = rows.groupBy("hash", "h").agg(F.min("member").alias("id"), F.count("*").alias("n"))
    reps = materialize(reps.select("hash", F.struct("id", "h").alias("rep"), "n"), "reps")
    return attach(rows, reps, "hash", "n", ["member"]).select("member", "rep", "n")


def folded(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """Equal values as one row: (``id_col``: array of the ids that hold it, ``value``). Missing values go.

    A value with more than FOLD ids has several rows, by a hash of the id, so no row grows with the
    number of copies.
    """
    rows = df.select(id_col, value, F.xxhash64(value).alias("_h")).where(F.col(value).isNotNull())
    many = materialize(rows.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > FOLD), "many-copies")
    part = F.lit(0)
    if not many.isEmpty():
        rows = rows.join(many, "_h", "left")
        part = F.coalesce(F.pmod(F.xxhash64(id_col), F.ceil(F.col("_n") / FOLD)), F.lit(0)).cast("int")
    return rows.groupBy(value, part.alias("_part")).agg(F.collect_list(id_col).alias(id_col)).select(id_col, value)


def unfolded(links: DataFrame) -> DataFrame:
    """Links of all ids behind links of ``folded`` rows."""
    return links.withColumn("source", F.explode("source")).withColumn("target", F.explode("target"))


def expand_links(links: DataFrame, src_members: DataFrame, tgt_members: DataFrame) -> DataFrame:
    """Entity pairs behind value links; a pair reached twice keeps the larger sim.

    Only an entity with several values can reach a pair twice: the pairs of all others are
    neither shuffled nor grouped once they are found.
    """
    links = materialize(links, "value-links")
    src, tgt, again = parted_links(links, src_members, tgt_members)
    pairs = _expanded(links, src, tgt)
    return pairs if again is None else pairs.unionByName(again)


def parted_links(links: DataFrame, src_members: DataFrame, tgt_members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Members of both sides with one value, and the entity pairs of those with more if there are any.

    ``links`` and members are read several times.
    """

    def parted(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Members with one value, and those with more if there are any."""
        more = members.groupBy("member").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("member").alias("_m"))
        more = materialize(more, "many-valued")
        if more.isEmpty():
            return members, None
        same = F.col("member").eqNullSafe(F.col("_m"))
        return members.join(more, same, "left_anti"), members.join(more, same, "left_semi")

    (src, src_more), (tgt, tgt_more) = parted(src_members), parted(tgt_members)
    again = None
    for s, t in ((src_more, tgt_members), (src, tgt_more)):
        if s is not None and t is not None:
            more = _expanded(links, s, t).groupBy("source", "target").agg(F.max("sim").alias("sim"))
            again = more if again is None else again.unionByName(more)
    return src, tgt, again


def _expanded(links: DataFrame, src_members: DataFrame, tgt_members: DataFrame) -> DataFrame:
    """Entity pairs behind value links, as often as they are reached.

    Both steps are tiled by the links of a value and the entities behind it, so neither
    a value with very many links nor one with very many entities meets in one task.
    """
    rows = links.select(
        F.struct(F.col("source").alias("id"), F.col("key_s").alias("h")).alias("source"),
        F.struct(F.col("target").alias("id"), F.col("key_t").alias("h")).alias("target"),
        "sim",
        "n_source",
        "n_target",
    )

    def weighed(rows: DataFrame, side: str, weight: Column, n: str) -> tuple[DataFrame, DataFrame]:
        """Rows and (value, rows that hold it) with the rows' number attached."""
        many = materialize(rows.groupBy(side).agg(F.sum(weight).alias("_rows"), F.count("*").alias("_links"), F.max(n).alias(n)), "weights")
        return attach(rows.drop(n), many, side, "_links", ["source", "target"]).drop("_links"), many.drop("_links")

    rows, many = weighed(rows, "source", F.lit(1), "n_source")
    src = src_members.select(F.col("rep").alias("source"), F.col("member").alias("_s"), "n")
    src = src.join(many, "source").drop("n")
    rows = pair_join(rows, src, "source", "target", "_s", "_rows", "n_source")
    sums = links.groupBy(F.struct(F.col("target").alias("id"), F.col("key_t").alias("h")).alias("target"))
    sums = materialize(sums.agg(F.sum("n_source").alias("_rows"), F.max("n_target").alias("n_target")), "weights")
    rows = attach(rows.select("target", "_s", "sim"), sums, "target", "_rows", ["_s"])
    tgt = tgt_members.select(F.col("rep").alias("target"), F.col("member").alias("_t")).join(sums, "target")
    rows = pair_join(rows, tgt, "target", "_s", "_t", "_rows", "n_target")
    return rows.select(F.col("_s").alias("source"), F.col("_t").alias("target"), "sim")
