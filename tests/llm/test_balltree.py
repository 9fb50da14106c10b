import math
import random

import pytest
from pyspark.sql import functions as F

import entitylink.llm.balltree as balltree
from entitylink.llm.balltree import top_k

SHAPE = "vec_id long, embedding array<float>, label int, score int, query string"


def brute(rows, k=10):
    whole = {}
    for i, v in sorted(((r[0], r[1]) for r in rows if r[0] is not None and r[1]), key=lambda r: (r[0], str(r[1]))):
        if all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(1024 * float(x)) for x in v]
    out = []
    for q, v in whole.items():
        if q % 100 == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SHAPE)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shard_rows", [50, 2048])
def test_equals_brute_force(spark, monkeypatch, shard_rows):
    rng = random.Random(1)
    half = lambda: rng.randint(-8, 8) / 8  # noqa: E731  # exact in float, many ties
    rows = [(k, [half() for _ in range(6)]) for k in range(900)] + [(k, [0.5] * 6) for k in range(900, 1101)]
    rows += [(2000, None), (2100, []), (2200, [1.0, None] * 3), (2300, [math.nan] * 6), (2400, [math.inf] * 6), (2500, [1.0, 2.0]), (2501, [3.0, 1.0])]
    rows += [(None, [1.0] * 6), (100, rows[100][1])]
    monkeypatch.setattr(balltree, "LEAST_ROWS", shard_rows)
    monkeypatch.setattr(balltree, "QUERY_GROUP", 5)
    assert got(top_k(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 0.5])]
    assert got(top_k(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)
    assert top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3.0e5, -7.0e5]), (1, [1.1e6, 1.5e6]), (2, [2.0e6, -1.0]), (3, [2.0e6, -0.999]), (4, [-5.0e5, 8.0e5])]
    rows += [(100, [1.0e-3, 2.0e-3])]
    assert got(top_k(table(spark, rows), F.col("vec_id") % 100 == 0)) == brute(rows)


def test_branches_are_pruned():
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(0, 400, (40, 8))
    vectors = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 5, (8000, 8)))
    tree = balltree.BallTree(np.arange(8000), vectors)
    seen = []
    inner = np.lexsort
    balltree.np.lexsort = lambda *a, **b: (seen.append(1), inner(*a, **b))[1]
    try:
        tree.search(np.array([0]), vectors[:1], np.array([-math.inf]), 10)
    finally:
        balltree.np.lexsort = inner
    leaves = sum(n[3] is None for n in tree.nodes)
    assert len(seen) < leaves / 4
