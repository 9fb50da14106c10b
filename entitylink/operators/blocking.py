"""Token blocking, automatic purging, block filtering, meta-blocking, reports.

Blocks are never collected: a block is the set of rows sharing a token.
Token tables have columns token, dataset ('s' or 't'), id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylink.functions.tokens import block_tokens
from entitylink.operators.prefix import numbered_elements
from entitylink.operators.skew import attach, pair_join
from entitylink.operators.tilejoin import Test, tile_links
from entitylink.session import materialize


def tag(src: DataFrame, tgt: DataFrame, id_col: str, value: Column | str) -> DataFrame:
    """(dataset, id, value) of both datasets."""
    value = F.col(value) if isinstance(value, str) else value
    s = src.select(F.lit("s").alias("dataset"), F.col(id_col).alias("id"), value.alias("value"))
    return s.unionByName(tgt.select(F.lit("t").alias("dataset"), F.col(id_col).alias("id"), value.alias("value")))


def untag(df: DataFrame, dataset: str) -> DataFrame:
    return df.where(F.col("dataset") == dataset).drop("dataset")


def strip_literal(value: Column) -> Column:
    """Remove the ``^^datatype`` tail and the quotes of an RDF literal."""
    typed = F.when(F.contains(value, F.lit("^^")), F.regexp_replace(value, r"\^\^[^^]*$", "")).otherwise(value)
    return F.replace(typed, F.lit('"'), F.lit(""))


def token_blocking(tagged: DataFrame) -> DataFrame:
    """Distinct tokens per entity, whichever of its values they come from.

    The tokens of one value are distinct already, so only entities with several rows are
    made distinct; a count of the ids tells which these are.
    """

    def tokens(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(block_tokens(strip_literal(F.col("value")))).alias("token"), "dataset", "id")

    many = materialize(tagged.groupBy("dataset", "id").count().where("count > 1").select("dataset", "id"), "many-valued")
    if many.isEmpty():
        return tokens(tagged)
    key = [F.col("dataset") == F.col("_dataset"), F.col("id").eqNullSafe(F.col("_id"))]
    many = many.select(F.col("dataset").alias("_dataset"), F.col("id").alias("_id"))
    once, more = (tagged.join(many, key, how) for how in ("left_anti", "left_semi"))
    return tokens(once).unionByName(tokens(more).distinct())


def block_sizes(tokens: DataFrame) -> DataFrame:
    """(token, size, n_s, n_t)."""
    return tokens.groupBy("token").agg(
        F.count("*").alias("size"),
        F.count(F.when(F.col("dataset") == "s", 1)).alias("n_s"),
        F.count(F.when(F.col("dataset") == "t", 1)).alias("n_t"),
    )


def block_histogram(sizes: DataFrame) -> DataFrame:
    """(size, blocks): one row per distinct size."""
    return sizes.groupBy("size").agg(F.count("*").alias("blocks"))


def optimal_block_size(sizes: DataFrame) -> DataFrame:
    """One row ``optimal``: the size where average comparisons per entity settle.

    Works on the histogram. Its distinct sizes number at most sqrt(2 * token rows),
    because distinct sizes sum to at most the token rows, so the single ordered
    window below stays small.
    """
    w = Window.orderBy("size")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size, other = F.col("size").cast("decimal(19,0)"), (F.col("size") - 1).cast("decimal(19,0)")
    blocks = F.col("blocks").cast("decimal(19,0)")
    comparisons = ((size * other).cast("decimal(38,0)") * 2 * blocks).cast("decimal(38,0)")
    hist = block_histogram(sizes).select(
        "size",
        F.sum((size * blocks).cast("decimal(38,0)")).over(run).cast("double").alias("total"),
        F.sum(comparisons).over(run).cast("double").alias("comparisons"),
    )
    ratio = F.when(F.col("comparisons") == 0, F.lit(float("inf"))).otherwise(F.col("total") / F.col("comparisons"))
    hist = hist.select("size", ratio.alias("cc"))
    step = F.abs(F.col("cc") - F.lag("cc").over(w))
    hist = hist.select("size", F.when(step < 1, step).alias("step"))
    smallest_step = F.when(F.col("step").isNotNull(), F.struct(-F.col("step"), F.col("size")))
    return (
        hist.agg(F.max("size").alias("largest"), F.max_by("size", smallest_step).alias("best"))
        .select(F.coalesce("best", "largest").alias("optimal"))
        .where(F.col("optimal").isNotNull())
    )


def purge(tokens: DataFrame, sizes: DataFrame, purging: bool = True) -> DataFrame:
    """Token rows of the kept blocks (1 < size <= optimal), with the block counts."""
    sizes = materialize(sizes, "sizes")
    on = F.col("size") > 1
    if purging:
        on = on & (F.col("size") <= optimal_block_size(sizes).scalar())
    return attach(tokens, sizes.withColumn("_on", on), "token", "size", ["dataset", "id"]).where("_on").drop("_on")


def candidates(kept: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs that share a kept block.

    Entities travel to tiles with the numbers of their blocks, so each pair is found once, in
    the tile of its two parts, and no list of pairs is shuffled or made distinct.
    """
    cross = materialize(kept.where((F.col("n_s") > 0) & (F.col("n_t") > 0)), "kept-tokens")
    stats = cross.groupBy(F.col("token").alias("elem")).agg(
        F.first("n_s").alias("df_s"), F.first("n_t").alias("df_t"), F.first("size").alias("df"), F.first("size").alias("entities")
    )
    numbers = materialize(numbered_elements(stats).select(F.col("elem").alias("token"), F.col("no").cast("int").alias("no"), "df"), "blocks")
    rows = attach(cross.select("token", "dataset", "id"), numbers, "token", "df", ["dataset", "id"])
    # a struct: an entity without an id is one too
    rows = rows.groupBy("dataset", F.struct("id").alias("e")).agg(F.array_sort(F.collect_list("no")).alias("arr"))
    ids = [F.when(F.col("dataset") == x, F.col("e")).alias(side) for x, side in (("s", "source"), ("t", "target"))]
    size, one = F.size("arr"), F.lit(1)
    entities = rows.select(*ids, one.alias("n_source"), one.alias("n_target"), size.alias("n"), size.alias("kept"), "arr")
    any_shared = Test(1.0, lambda a, b, lead: np.ones(np.broadcast(a, b).shape, dtype=np.int64), lambda o, a, b: o)
    pairs = tile_links(materialize(entities, "entity-blocks"), any_shared)
    return pairs.select(F.col("source.id").alias("source"), F.col("target.id").alias("target"))


def block_filtering(kept: DataFrame, n: int) -> DataFrame:
    """Per entity its n blocks with the fewest comparisons n(n-1)/2, then by token."""
    size = F.col("size").cast("decimal(19,0)")
    comparisons = (size * (size - 1)).cast("decimal(38,0)")
    w = Window.partitionBy("dataset", "id").orderBy(comparisons, "token")  # twice the comparisons: the same order
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def meta_blocking(filtered: DataFrame) -> DataFrame:
    """Pairs whose block lists overlap at least as much as the average pair's.

    Weight = Jaccard of the two block lists; the mean counts a pair once per shared
    block. Pairs inside one dataset count too.
    """
    w = Window.partitionBy("dataset", "id")
    rows = materialize(
        filtered.select("token", F.struct("dataset", "id").alias("e"), F.count("*").over(w).alias("blocks")), "lists"
    )
    # sizes after filtering, for the tile grid
    n = materialize(rows.groupBy("token").agg(F.count("*").alias("n")), "list_sizes")
    rows = attach(rows, n, "token", "n", ["e"])
    left = rows.select("token", F.col("e").alias("a"), F.col("blocks").alias("k_a"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    right = rows.select("token", F.col("e").alias("b"), F.col("blocks").alias("k_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    pairs = (
        pair_join(left, right, "token", "a", "b", "n_a", "n_b", F.col("a") < F.col("b"))
        .groupBy("a", "b", "k_a", "k_b")
        .agg(F.count("*").alias("shared"))
        .withColumn("weight", F.col("shared") / (F.col("k_a") + F.col("k_b") - F.col("shared")))
    )
    pairs = materialize(pairs, "edges")
    # Group equal weights first: a short, order-independent sum.
    grouped = pairs.groupBy("weight").agg(F.sum("shared").alias("k"))
    mean = grouped.agg(F.sum(F.col("weight") * F.col("k")) / F.sum("k"))
    return pairs.where(F.col("weight") >= mean.scalar() - 1e-12).select(
        F.col("a.dataset").alias("dataset_a"),
        F.col("a.id").alias("id_a"),
        F.col("b.dataset").alias("dataset_b"),
        F.col("b.id").alias("id_b"),
        "shared",
        "weight",
    )


def comparison_pairs(pairs: DataFrame, tagged: DataFrame) -> DataFrame:
    """Entity data attached to both ends of each pair."""
    a = tagged.select(F.col("dataset").alias("dataset_a"), F.col("id").alias("id_a"), F.col("value").alias("value_a"))
    b = tagged.select(F.col("dataset").alias("dataset_b"), F.col("id").alias("id_b"), F.col("value").alias("value_b"))
    return pairs.join(a, ["dataset_a", "id_a"]).join(b, ["dataset_b", "id_b"])


def comparison_count(sizes: DataFrame) -> DataFrame:
    """Cross-dataset comparisons over all given blocks."""
    product = F.col("n_s").cast("decimal(19,0)") * F.col("n_t").cast("decimal(19,0)")
    return sizes.agg(F.coalesce(F.sum(product.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("comparisons"))


def blocking_report(tagged: DataFrame, links: DataFrame) -> DataFrame:
    """(metric, value): sizes, blocks, comparisons and links of one run."""
    sizes = materialize(block_sizes(token_blocking(tagged)), "sizes")
    best = optimal_block_size(sizes)
    on = (F.col("size") > 1) & (F.col("size") <= best.scalar())
    kept = sizes.where(on)
    sides = tagged.groupBy("dataset").agg(F.countDistinct("id").alias("n"))
    n_s = F.coalesce(F.max(F.when(F.col("dataset") == "s", F.col("n"))), F.lit(0))
    n_t = F.coalesce(F.max(F.when(F.col("dataset") == "t", F.col("n"))), F.lit(0))

    def row(df: DataFrame, metric: str, value: Column) -> DataFrame:
        return df.agg(value.cast("decimal(38,0)").alias("value")).select(F.lit(metric).alias("metric"), "value")

    rows = [
        row(best, "optimal_size", F.max("optimal")),
        row(sizes, "blocks_before", F.count("*")),
        row(kept, "blocks_after", F.count("*")),
        row(sides, "source_entities", n_s),
        row(sides, "target_entities", n_t),
        row(sides, "all_pairs", n_s.cast("decimal(19,0)") * n_t.cast("decimal(19,0)")),
        row(comparison_count(sizes), "comparisons_unpurged", F.max("comparisons")),
        row(comparison_count(kept), "comparisons_purged", F.max("comparisons")),
        row(links, "links", F.count("*")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
