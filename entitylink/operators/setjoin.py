"""Exact and token-set joins: exact, jaccard, cosine, dice, overlap, q-gram, bigram dice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.functions import tokens as tok
from entitylink.operators.tilejoin import Test, numbered_values, tile_links, up
from entitylink.operators.values import flat_links, value_table
from entitylink.session import materialize


def exact_join(src: DataFrame, tgt: DataFrame, id_col: str, value: Column | str) -> DataFrame:
    """Equal values, sim 1.0."""
    v = value_table(src, tgt, id_col, value).where((F.col("n_source") > 0) & (F.col("n_target") > 0))
    return flat_links(v.withColumn("sim", F.lit(1.0)))


class Measure:
    """A set similarity and the least overlap that it needs, over NumPy arrays or columns."""

    def __init__(self, name: str, theta: float):
        self.name, self.theta = name, float(theta)
        if self.theta <= 0:
            raise ValueError("a set join needs a positive threshold")

    def alpha(self, a, b, lead=None):
        t = self.theta
        if self.name == "jaccard":
            return up((a + b) * (t / (1 + t)))
        if self.name == "cosine":
            return up(np.sqrt(np.asarray(a, dtype=np.float64) * b) * t)
        if self.name == "dice":
            return up((a + b) * (t / 2))
        return np.full(np.broadcast(a, b).shape, int(t))

    def sim(self, o, a, b):
        if self.name == "jaccard":
            return o / (a + b - o)
        if self.name == "cosine":
            product = a.cast("double") * b if isinstance(a, Column) else a.astype(np.float64) * b
            return o / (F.sqrt(product) if isinstance(a, Column) else np.sqrt(product))
        if self.name == "dice":
            return 2 * o / (a + b)
        return o

    def test(self) -> Test:
        return Test(self.theta, self.alpha, self.sim)


def set_values(src: DataFrame, tgt: DataFrame, id_col: str, value: Column | str, elems) -> DataFrame:
    """The value table with ``elems`` in place of the value and a number for each row, written out once."""
    values = value_table(src, tgt, id_col, value).withColumn("row", F.monotonically_increasing_id())
    return materialize(
        values.select("row", "source", "target", "n_source", "n_target", elems(F.col("value")).alias("elems")), "values"
    )


def set_links(
    values: DataFrame,
    measure: Measure,
    by: str = "pairs",
    limit: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Value links (source, target, sim, n_source, n_target) for ``set_values`` output."""
    return tile_links(numbered_values(values, by, limit, stats), measure.test())


def set_join(src: DataFrame, tgt: DataFrame, id_col: str, value: Column | str, elems, measure: Measure) -> DataFrame:
    return flat_links(set_links(set_values(src, tgt, id_col, value, elems), measure))


def jaccard_join(src, tgt, id_col, value, theta):
    return set_join(src, tgt, id_col, value, tok.bag, Measure("jaccard", theta))


def cosine_join(src, tgt, id_col, value, theta):
    return set_join(src, tgt, id_col, value, tok.bag, Measure("cosine", theta))


def dice_join(src, tgt, id_col, value, theta):
    return set_join(src, tgt, id_col, value, tok.bag, Measure("dice", theta))


def overlap_join(src, tgt, id_col, value, least: int):
    """At least ``least`` shared words (repeats counted); sim is that number."""
    return set_join(src, tgt, id_col, value, tok.bag, Measure("overlap", least))


def qgram_join(src, tgt, id_col, value, theta, q: int = 3):
    return set_join(src, tgt, id_col, value, lambda v: tok.qgrams(v, q), Measure("jaccard", theta))


def bigram_dice_join(src, tgt, id_col, value, theta):
    return set_join(src, tgt, id_col, value, tok.padded_bigrams, Measure("dice", theta))
