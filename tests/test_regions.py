"""Exact relations of regions and lines against worked-out cases and sampled points, and the
levelled grid of boxes against all pairs."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylink.functions import geo, regions
from entitylink.operators import geojoin as gj
from entitylink.operators import values

POINT = "struct<lat:double,lon:double>"
REGION = f"id long, r array<array<{POINT}>>"


def square(y, x, h=2.0, w=2.0):
    return [(y, x), (y, x + w), (y + h, x + w), (y + h, x)]


A = [square(0.0, 0.0)]
HALF, NEXT, CORNER = [square(0.0, 0.0, 2.0, 1.0)], [square(0.0, 2.0)], [square(2.0, 2.0)]
DIAMOND = [[(1.0, -1.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 1.0)]]
RING = [square(-1.0, -1.0, 4.0, 4.0), square(0.0, 0.0)]
INNER = [square(0.5, 0.5, 1.0, 1.0)]
ISLANDS = [square(0.0, 0.0, 1.0, 1.0), square(1.0, 1.0, 1.0, 1.0)]
ELL = [[(0.0, 0.0), (0.0, 4.0), (1.0, 4.0), (1.0, 1.0), (4.0, 1.0), (4.0, 0.0)]]
NOTCH = [square(1.0, 1.0)]
THIN = [[(0.0, 0.0), (0.1, 0.3), (0.3, 0.1)]]
CASES = [
    (A, A, {"equals", "within", "contains"}),
    (A, [A[0][::-1]], {"equals", "within", "contains"}),
    (A, [A[0] + A[0][:1]], {"equals", "within", "contains"}),
    (HALF, A, {"within"}),
    (A, HALF, {"contains"}),
    (A, NEXT, {"touches"}),
    (A, CORNER, {"touches"}),
    (A, DIAMOND, {"within"}),
    (DIAMOND, A, {"contains"}),
    (A, RING, {"touches"}),
    (INNER, RING, set()),
    (INNER, A, {"within"}),
    (RING, [square(-1.0, -1.0, 4.0, 4.0)], {"within"}),
    (RING, DIAMOND, {"overlaps"}),
    (ISLANDS, A, {"within"}),
    (ISLANDS, [square(0.0, 1.0, 1.0, 1.0)], {"touches"}),
    (ELL, NOTCH, {"touches"}),
    (ELL, [square(0.5, 0.5)], {"overlaps"}),
    (ELL, [square(0.0, 0.0, 1.0, 1.0)], {"contains"}),
    (THIN, A, {"within"}),
    (A, [square(5.0, 5.0)], set()),
    (A, [square(1.0, 1.0)], {"overlaps"}),
    (A, [square(0.5, -1.0, 1.0, 4.0)], {"overlaps"}),
]
LINES = [
    ([(1.0, -1.0), (1.0, 3.0)], A, {"crosses"}),
    ([(0.0, -1.0), (0.0, 3.0)], A, {"touches"}),
    ([(0.0, 0.0), (2.0, 2.0)], A, {"within"}),
    ([(0.0, 0.0), (3.0, 3.0)], A, {"crosses"}),
    ([(-1.0, 1.0), (1.0, -1.0)], A, {"touches"}),
    ([(0.0, 0.0), (0.0, 2.0), (1.0, 2.0)], A, {"touches"}),
    ([(0.0, 0.0), (0.0, 2.0), (1.0, 1.0)], A, {"within"}),
    ([(1.0, 0.5), (1.0, 1.5)], RING, set()),
    ([(1.0, -2.0), (1.0, 4.0)], RING, {"crosses"}),
    ([(9.0, 9.0), (8.0, 8.0)], A, set()),
]


def test_worked_out_regions(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(CASES)], f"id long, a array<array<{POINT}>>, b array<array<{POINT}>>")
    masked = regions.with_relation(rows, "a", "b")
    got = {r["id"]: r for r in masked.select("id", *[t(F.col("mask")).alias(n) for n, t in regions.RELATIONS.items()]).collect()}
    for k, (_, _, want) in enumerate(CASES):
        meets = bool(want)
        assert {n for n in regions.RELATIONS if got[k][n]} == (want | {"intersects"} if meets else {"disjoint"}), k


def test_worked_out_lines(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(LINES)], f"id long, a array<{POINT}>, b array<array<{POINT}>>")
    masked = regions.with_relation(rows, "a", "b", line=True)
    got = {r["id"]: r for r in masked.select("id", *[t(F.col("mask")).alias(n) for n, t in regions.LINE_RELATIONS.items()]).collect()}
    for k, (_, _, want) in enumerate(LINES):
        assert {n for n in regions.LINE_RELATIONS if got[k][n]} == (want | {"intersects"} if want else {"disjoint"}), k


def test_missing_and_empty_shapes(spark):
    rows = spark.createDataFrame([(1, None, A), (2, [], A), (3, A, [[]]), (4, [[], A[0]], A)], f"id long, a array<array<{POINT}>>, b array<array<{POINT}>>")
    got = {r["id"]: r["mask"] for r in regions.with_relation(rows, "a", "b").collect()}
    meets = regions.INSIDES | regions.MEET
    assert got[1] is None and not got[2] & meets and not got[3] & meets and got[4] == meets
    one = spark.createDataFrame([(1, None), (2, []), (3, A)], REGION)
    assert [(r["source"], r["target"]) for r in gj.region_join(one, one, "id", "r", "equals").collect()] == [(3, 3)]
    assert gj.region_join(one.where("false"), one, "id", "r", "touches").count() == 0


def sampled(a, b):
    """Bits by the points of a fine grid; exact for corners on whole numbers and level,
    upright or diagonal edges, whose arrangement has a quarter point in every part."""

    def place(rings, y, x):
        odd = False
        for ring in rings:
            for (py, px), (qy, qx) in zip(ring, ring[1:] + ring[:1]):
                turn = (qx - px) * (y - py) - (qy - py) * (x - px)
                if turn == 0 and min(py, qy) <= y <= max(py, qy) and min(px, qx) <= x <= max(px, qx):
                    return "on"
                if (py > y) != (qy > y) and (turn > 0) == (qy > py):
                    odd = not odd
        return "in" if odd else "out"

    mask = 0
    for y in range(-4, 40):
        for x in range(-4, 40):
            s, t = (place(r, Fraction(y, 4), Fraction(x, 4)) for r in (a, b))
            mask |= regions.INSIDES | regions.MEET if s == t == "in" else 0
            mask |= regions.MEET if "out" not in (s, t) else 0
            mask |= regions.FIRST_OUT if (s, t) == ("in", "out") else 0
            mask |= regions.SECOND_OUT if (s, t) == ("out", "in") else 0
    return mask


def random_region(rng):
    y, x = rng.randint(0, 4), rng.randint(0, 4)
    shapes = [
        [[(0, 0), (0, 3), (3, 3), (3, 0)], [(1, 1), (1, 2), (2, 2), (2, 1)]],
        [[(0, 0), (0, 3), (1, 3), (1, 1), (3, 1), (3, 0)]],
        [[(2, 0), (4, 2), (2, 4), (0, 2)]],
        [[(0, 0), (0, 2), (2, 0)]],
        [[(0, 0), (0, 1), (1, 1), (1, 0)], [(1, 1), (1, 3), (2, 3), (2, 1)]],
        [[(0, 0), (0, 4), (2, 2)]],
    ]
    return [[(float(y + p), float(x + q)) for p, q in (ring if rng.random() < 0.5 else ring[::-1])] for ring in rng.choice(shapes)]


def test_random_regions_equal_sampled_points(spark):
    rng = random.Random(11)
    pairs = [(random_region(rng), random_region(rng)) for _ in range(120)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"id long, a array<array<{POINT}>>, b array<array<{POINT}>>")
    got = {r["id"]: r["mask"] for r in regions.with_relation(rows, "a", "b").collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == sampled(a, b), (a, b)
        flat = [[v for r in s for p, q in zip(r, r[1:] + r[:1]) for v in (*p, *q)] for s in (a, b)]
        assert regions.exact_relation(*flat) == got[k]
        # sheared and shrunk by whole and binary steps, the pair stands as it stood
        moved = [[v for y, x in zip(s[::2], s[1::2]) for v in ((3 * y + x) / 1024 + 50, (y + 2 * x) / 1024)] for s in flat]
        assert regions.exact_relation(*moved) == got[k]


def test_expressions_and_whole_numbers_agree(spark):
    """Shapes in general position take the expressions; the whole numbers give the same bits."""
    rng = random.Random(5)

    def blob():
        y, x, n = rng.uniform(0, 3), rng.uniform(0, 3), rng.randint(3, 7)
        angles = sorted(rng.uniform(0, 6.28) for _ in range(n))
        return [[(y + math.sin(t) * rng.uniform(0.3, 1.5), x + math.cos(t) * rng.uniform(0.3, 1.5)) for t in angles]]

    pairs = [(blob(), blob()) for _ in range(150)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], f"id long, a array<array<{POINT}>>, b array<array<{POINT}>>")
    got = {r["id"]: r["mask"] for r in regions.with_relation(rows, "a", "b").collect()}
    for k, (a, b) in enumerate(pairs):
        flat = [[v for r in s for p, q in zip(r, r[1:] + r[:1]) for v in (*p, *q)] for s in (a, b)]
        assert got[k] == regions.exact_relation(*flat)


def boxes(spark, rng, n):
    rows = []
    for i in range(n):
        size = 10 ** rng.uniform(-3.5, 2)
        y, x = rng.uniform(-60, 60), rng.uniform(-100, 100)
        if i % 10 == 0:
            y, x, size = float(round(y)), float(round(x)), rng.choice([0.0, 1.0, 2.0, 64.0])
        if i % 7 == 0 and rows:
            y, x = rows[-1][1][0], rows[-1][1][2]
        rows.append((i, (y, y + size * rng.uniform(0.1, 1), x, x + size)))
    rows.append((n, None))
    return spark.createDataFrame(rows, "id long, b struct<lat_lo:double,lat_hi:double,lon_lo:double,lon_hi:double>")


@pytest.mark.parametrize("finest", [gj.FINEST, 1.0])
def test_boxes_of_all_sizes_meet_once(spark, finest, monkeypatch):
    """Sizes over more than five orders of magnitude: all meeting pairs, each once, and
    few rows for each box whatever its size."""
    rng = random.Random(9)
    s, t = boxes(spark, rng, 300), boxes(spark, rng, 300)
    laid = []
    pairs = gj.pair_join

    def counting(left, right, *args):
        laid.extend([left.count(), right.count()])
        return pairs(left, right, *args)

    monkeypatch.setattr(gj, "pair_join", counting)
    got = [(r["source"], r["target"]) for r in gj.box_pairs(s, t, "id", "b", finest).select("source", "target").collect()]
    every = s.select(F.col("id").alias("source"), F.col("b").alias("x")).crossJoin(t.select(F.col("id").alias("target"), F.col("b").alias("y")))
    want = {(r["source"], r["target"]) for r in every.where(geo.box_intersects(F.col("x"), F.col("y"))).collect()}
    assert len(want) > 300 and set(got) == want and len(got) == len(want)
    assert max(laid) <= 300 * 4 * 20


def test_copies_of_a_region_are_tested_as_one(spark, monkeypatch):
    """Ten copies of either side: one pair is tested, all links come out, and no row grows with the copies."""
    s = spark.createDataFrame([(i, A) for i in range(10)] + [(90, None)], REGION)
    t = spark.createDataFrame([(i, HALF) for i in range(100, 110)] + [(190, NEXT)], REGION)
    tested = []
    relation = gj.regions.with_relation

    def counting(rows, *args):
        tested.append(rows.count())
        return relation(rows, *args)

    monkeypatch.setattr(gj.regions, "with_relation", counting)
    want = {(i, j) for i in range(10) for j in range(100, 110)}
    for fold in (1000, 3):
        monkeypatch.setattr(values, "FOLD", fold)
        got = [(r["source"], r["target"]) for r in gj.region_join(s, t, "id", "r", "contains").collect()]
        assert len(got) == len(want) and set(got) == want
    assert tested[0] == 2 and tested[1] <= 40
    assert max(len(r["id"]) for r in values.folded(s, "id", "r").collect()) < 10


def test_rings_worked_on_together_equal_the_exact_relation(spark, monkeypatch):
    """Single rings of several sizes take their pairs many at a time, packed or not; others, and rings that
    rounding could mislead, give the same bits as whole numbers do."""
    rng = random.Random(4)
    ring = lambda y, x, k: [(y + rng.randint(1, 4) * math.sin(2 * math.pi * i / k), x + rng.randint(1, 4) * math.cos(2 * math.pi * i / k)) for i in range(k)]
    shapes = [[ring(rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 6))] for _ in range(120)]
    shapes += [A, HALF, NEXT, CORNER, DIAMOND, RING, ISLANDS, ELL, [A[0] + A[0][:1]], [A[0][:1] + A[0]], INNER]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(shapes)], REGION).select(regions.flat_shape(F.col("r")).alias("f"))
    flat = df.toArrow()["f"].combine_chunks()
    edges, starts = (flat.field(c) for c in ("edges", "starts"))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(shapes)), np.arange(len(shapes))))
    plain, packed = regions.Shapes(edges, starts), regions.Shapes.unpacked(regions.packed_shapes(edges, starts))
    assert plain.ring.sum() == len(shapes) - 2 and (plain.ring == packed.ring).all()
    whole = [0]
    exact = regions.exact_relation
    monkeypatch.setattr(regions, "exact_relation", lambda *x: whole.append(1) or exact(*x))
    got = regions.row_relations(plain, plain, i, j, False)
    assert 100 < len(whole) < len(i) / 5
    assert (regions.row_relations(packed, plain, i, j, False) == got).all()
    for k in [*range(0, len(i), 11), *np.flatnonzero((i >= 120) & (j >= 120))]:
        assert regions._has(got[k], regions.MEET) == regions._has(exact(edges[i[k]].as_py(), edges[j[k]].as_py()), regions.MEET)
        assert got[k] == exact(edges[i[k]].as_py(), edges[j[k]].as_py())


def test_copies_of_a_box_are_tested_as_one(spark, monkeypatch):
    """Equal boxes go to their cells once; all links come out, those of ids that repeat or are missing too."""
    box = "id long, b struct<lat_lo:double,lat_hi:double,lon_lo:double,lon_hi:double>"
    one, beside = (0.0, 2.0, 0.0, 2.0), (0.0, 2.0, 2.0, 3.0)
    ids = [1, 2, 2, None, *range(10, 40)]
    s = spark.createDataFrame([(i, one) for i in ids] + [(9, None)], box)
    t = spark.createDataFrame([(i, beside) for i in ids], box)
    laid = []
    pairs = gj.pair_join
    monkeypatch.setattr(gj, "pair_join", lambda left, right, *args: laid.extend([left.count(), right.count()]) or pairs(left, right, *args))
    key = lambda pair: tuple((x is not None, x or 0) for x in pair)
    got = [(r["source"], r["target"]) for r in gj.topology_join(s, t, "id", "b", "touches").collect()]
    assert sorted(got, key=key) == sorted(((i, j) for i in ids for j in ids), key=key)
    assert gj.topology_join(s, t, "id", "b", "overlaps").count() == 0
    assert max(laid) <= 20


def test_regions_with_missing_coordinates_meet_nothing(spark):
    gone, half = [[(None, None)] * 4], [[(0.0, None), *A[0][1:]]]
    df = spark.createDataFrame([(1, A), (2, gone), (3, half), (4, None)], REGION)
    assert [(r["source"], r["target"]) for r in gj.region_join(df, df, "id", "r", "intersects").collect()] == [(1, 1)]
