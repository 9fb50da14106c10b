"""Evaluation of links against gold links, and without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.operators.links import best_one_to_n, reverse
from entitylink.session import materialize

PAIR = ["source", "target"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.when(p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(F.lit(0.0))


def _with_prf(counts: DataFrame, *keep: str) -> DataFrame:
    """precision, recall, f from tp, n_pred, n_gold."""
    df = counts.withColumn("precision", _ratio(F.col("tp"), F.col("n_pred"))).withColumn("recall", _ratio(F.col("tp"), F.col("n_gold")))
    return df.withColumn("f", _f(F.col("precision"), F.col("recall"))).select(*keep, "tp", "n_pred", "n_gold", "precision", "recall", "f")


def _seen(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how often it is predicted (p) and gold (g): one shuffle, no join."""
    rows = pred.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(
        gold.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("g"))
    )
    return rows.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))


def _hits(test: Column) -> Column:
    return F.count(F.when(test, 1))


def prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    seen = _seen(pred, gold, PAIR)
    p, g = F.col("p") > 0, F.col("g") > 0
    return _with_prf(seen.agg(_hits(p & g).alias("tp"), _hits(p).alias("n_pred"), _hits(g).alias("n_gold")))


def prf_undirected(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """A pair or its reverse counts."""

    def plain(df: DataFrame) -> DataFrame:
        return df.select(*PAIR).distinct().select(F.least(*PAIR).alias("source"), F.greatest(*PAIR).alias("target"))

    p, g = F.col("p"), F.col("g")
    total = _seen(plain(pred), plain(gold), PAIR).agg(
        F.sum(F.when(g > 0, p).otherwise(0)).alias("tp_pred"),
        F.sum(F.when(p > 0, g).otherwise(0)).alias("tp_gold"),
        F.sum(p).alias("n_pred"),
        F.sum(g).alias("n_gold"),
    )
    total = total.withColumn("precision", _ratio(F.col("tp_pred"), F.col("n_pred")))
    total = total.withColumn("recall", _ratio(F.col("tp_gold"), F.col("n_gold")))
    return total.select("precision", "recall", _f(F.col("precision"), F.col("recall")).alias("f"))


def pseudo_f(
    links: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str, beta: float = 1.0, one_to_n: bool = False, symmetric: bool = True
) -> DataFrame:
    """Quality without gold: how nearly one-to-one, and how much of both sides is linked.
    ``links`` is written once, so it is planned once."""
    links = materialize(links.select(*PAIR, "sim"), "links")
    best = best_one_to_n(links) if one_to_n else links
    back = best_one_to_n(reverse(best)) if one_to_n else reverse(links)
    if one_to_n:
        best, back = materialize(best, "best"), materialize(back, "back")
    sides = best.agg(F.struct(F.countDistinct("source").alias("s"), F.countDistinct("target").alias("t"))).scalar()
    sources, targets = sides.s, sides.t
    # the sources of the reversed links are the targets
    linked = sources + (back.agg(F.countDistinct("source")).scalar() if one_to_n else targets) if symmetric else sources
    entities = src.agg(F.countDistinct(id_col)).scalar() + tgt.agg(F.countDistinct(id_col)).scalar()
    q = F.count("*") * (2 if symmetric else 1)
    out = links.agg(q.alias("q")).select(_ratio(linked, F.col("q")).alias("precision"), _ratio(sources + targets, entities).alias("recall"))
    return out.withColumn("f", _f(F.col("precision"), F.col("recall"), beta))


def link_statistics(result: DataFrame, gold: DataFrame) -> DataFrame:
    """true / false / missed links and recall in percent, by source.

    Every (result, gold) pair of a source is true or false; their number is the
    product of the source's counts, so no source is ever paired out.
    """
    per_pair = _seen(result, gold, PAIR)
    per_source = per_pair.groupBy("source").agg(
        F.sum("p").alias("p"),
        F.sum("g").alias("g"),
        F.sum(F.col("p") * F.col("g")).alias("same"),
        F.sum(F.when(F.col("p") == 0, F.col("g")).otherwise(0)).alias("missed"),
    )
    total = per_source.agg(
        F.sum("p").alias("links"),
        F.sum("g").alias("gold"),
        F.sum("same").alias("true_links"),
        F.sum(F.col("p") * F.col("g") - F.col("same")).alias("false_links"),
        F.sum("missed").alias("missed_links"),
    )
    hit = F.col("true_links")
    return total.withColumn("recall_percent", _ratio(hit, hit + F.col("missed_links")) * 100)


def missed_links(result: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.select(*PAIR).join(result.select(*PAIR), PAIR, "left_anti")


def gold_from_sameas(triples: DataFrame, predicate: str) -> DataFrame:
    rows = triples.where(F.col("predicate") == predicate)
    return rows.select(F.col("subject").alias("source"), F.col("object").alias("target"))


def accuracy(pred: DataFrame, gold: DataFrame, src: DataFrame, tgt: DataFrame, id_col: str) -> DataFrame:
    """(TP + TN) over all possible pairs."""
    pairs = src.agg(F.countDistinct(id_col)).scalar().cast("double") * tgt.agg(F.countDistinct(id_col)).scalar()
    p, g = F.col("p") > 0, F.col("g") > 0
    wrong = _seen(pred, gold, PAIR).agg(_hits(p != g).alias("wrong"), _hits(p & g).alias("tp"))
    return wrong.select("tp", "wrong", ((pairs - F.col("wrong")) / pairs).alias("accuracy"))


def eval_table(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """P/R/F per (method, dataset). pred: method, dataset, pair; gold: dataset, pair."""
    keys = ["dataset", *PAIR]
    marked = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    per = pred.select("method", *keys).distinct().join(marked, keys, "left")
    per = per.groupBy("method", "dataset").agg(F.count("g").alias("tp"), F.count("*").alias("n_pred"))
    n_gold = marked.groupBy("dataset").agg(F.count("*").alias("n_gold"))
    return _with_prf(per.join(n_gold, "dataset"), "method", "dataset")


def fold(source: Column, k: int) -> Column:
    """Fold number of a source: the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(source.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def eval_folds(pred: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """P/R/F of every fold of the sources."""
    p = pred.select(F.lit("all").alias("method"), fold(F.col("source"), k).alias("dataset"), *PAIR)
    g = gold.select(fold(F.col("source"), k).alias("dataset"), *PAIR)
    return eval_table(p, g).drop("method").withColumnRenamed("dataset", "fold")


def mean_sd(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
