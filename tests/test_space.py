"""Geo, range and topology joins against brute force, and worked-out distances."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entitylink.functions import geo, lines
from entitylink.operators import geojoin as gj
from entitylink.operators import rangejoin as rj

POINT = "struct<lat:double,lon:double>"
SHAPE = f"id long, pts array<{POINT}>"


def km(spark, p, q):
    df = spark.createDataFrame([(p, q)], f"p {POINT}, q {POINT}")
    return df.select(geo.haversine(F.col("p"), F.col("q")).alias("d")).collect()[0].d


@pytest.mark.parametrize("p,q", [((0.0, 0.0), (0.0, 1.0)), ((0.0, 179.5), (0.0, -179.5)), ((89.5, 0.0), (89.5, 180.0))])
def test_haversine(spark, p, q):
    assert km(spark, p, q) == pytest.approx(111.194927, abs=1e-6)


def test_ellipsoid(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 0.0, 180.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r.d for r in df.select(geo.ellipsoid("a", "b", "c", "d").alias("d")).collect()]
    assert got[0] == pytest.approx(111.319491, abs=1e-5) and got[1] == pytest.approx(110.574389, abs=1e-5)
    assert got[2] == 0 and got[3] > 19000  # antipodes fall back instead of giving 0


X, Y = [(0.0, 0.0), (0.0, 1.0)], [(0.0, 0.0), (0.0, 2.0), (1.0, 0.0)]
SETS = {
    "hausdorff": 111.194927,
    "sym_hausdorff": 111.194927,
    "min": 0,
    "max": 222.389853,
    "avg": 118.870669,
    "sum_of_min": 166.792390,
    "link": 333.584780,
    "fair_surjection": 333.584780,
    "mean": 41.439856,
}


@pytest.mark.parametrize("name", SETS)
def test_set_distances(spark, name):
    df = spark.createDataFrame([(X, Y)], f"x array<{POINT}>, y array<{POINT}>")
    assert df.select(geo.SET_DISTANCES[name](F.col("x"), F.col("y")).alias("d")).collect()[0].d == pytest.approx(SETS[name], abs=1e-5)


def test_surjection_and_frechet(spark):
    unit = 111.194927
    df = spark.createDataFrame([(X, Y)], f"x array<{POINT}>, y array<{POINT}>")
    r = df.select(geo.surjection(F.col("x"), F.col("y")).alias("s"), geo.frechet("x", "y").alias("f")).collect()[0]
    # (0,0) takes (0,0), (0,1) takes (0,2), the left-over (1,0) goes back to (0,0)
    assert r.s == pytest.approx(2 * unit, abs=1e-5)
    # the walk must end on the pair ((0,1), (1,0))
    assert r.f == pytest.approx(km(spark, (0.0, 1.0), (1.0, 0.0)), abs=1e-5)


@pytest.fixture(scope="module")
def shapes(spark):
    rng = random.Random(3)
    centres = [(0, 0), (89.9, 10), (-89.95, 170), (10, 179.99), (45, -180), (60, 30)]

    def df(n):
        out = []
        for i in range(n):
            lat, lon = rng.choice(centres)
            pts = []
            for _ in range(rng.randint(1, 4)):
                y, x = lat + rng.uniform(-0.4, 0.4), lon + rng.uniform(-0.4, 0.4) * (40 if abs(lat) > 80 else 1)
                pts.append((max(-90.0, min(90.0, y)), (x + 180) % 360 - 180))
            out.append((i, pts))
        return spark.createDataFrame(out, SHAPE).cache()

    return df(40), df(45)


@pytest.mark.parametrize("theta", [0.05, 0.02])
@pytest.mark.parametrize("name", ["hausdorff", "min", "mean", "surjection", "frechet"])
def test_shape_join_equals_brute_force(spark, shapes, name, theta):
    s, t = shapes
    every = s.select(F.col("id").alias("source"), F.col("pts").alias("x")).crossJoin(t.select(F.col("id").alias("target"), F.col("pts").alias("y")))
    far = every.select("source", "target", geo.SET_DISTANCES[name](F.col("x"), F.col("y")).alias("d")).where(F.col("d") <= gj.max_km(theta))
    want = {(r.source, r.target) for r in far.collect()}
    got = [(r.source, r.target) for r in gj.shape_join(s, t, "id", "pts", theta, name).collect()]
    assert want and set(got) == want and len(got) == len(want)


@pytest.fixture(scope="module")
def walks(spark):
    """Lines of 1 to 120 points, many of them noisy copies of others, also over a pole and the date line."""
    rng = random.Random(9)
    starts = [(0, 0), (89.7, 10), (-89.9, 170), (10, 179.9), (60, 30)]
    wrap = lambda y, x: (max(-90.0, min(90.0, y)), (x + 180) % 360 - 180)

    def walk(lat, lon):
        out = []
        for _ in range(rng.choice([1, 30, 120])):
            lat, lon = lat + rng.uniform(-0.05, 0.08), lon + rng.uniform(-0.05, 0.08)
            out.append(wrap(lat, lon))
        return out

    first = [walk(*rng.choice(starts)) for _ in range(30)]
    second = [[wrap(y + rng.uniform(-0.1, 0.1), x + rng.uniform(-0.1, 0.1)) for y, x in w] for w in first] + [walk(*rng.choice(starts)) for _ in range(10)]
    return tuple(spark.createDataFrame(list(enumerate(x)), SHAPE).cache() for x in (first, second))


@pytest.mark.parametrize("theta", [0.05, 0.01])
@pytest.mark.parametrize("name", ["hausdorff", "sym_hausdorff"])
def test_hausdorff_of_lines_equals_brute_force(spark, walks, name, theta):
    s, t = walks
    every = s.select(F.col("id").alias("source"), F.col("pts").alias("x")).crossJoin(t.select(F.col("id").alias("target"), F.col("pts").alias("y")))
    d = geo.SET_DISTANCES[name](F.col("x"), F.col("y"))
    want = {(r.source, r.target): r.d for r in every.select("source", "target", d.alias("d")).where(F.col("d") <= gj.max_km(theta)).collect()}
    got = {(r.source, r.target): 1 / r.sim - 1 for r in gj.shape_join(s, t, "id", "pts", theta, name).collect()}
    assert len(want) > 10 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def dense(w, step=15):
    """A line with ``step`` points on each of its pieces, as vectors."""
    v = lines._vectors([{"lat": y, "lon": x} for y, x in w])
    return np.concatenate([v[:1]] + [a + (b - a) * np.arange(1, step + 1)[:, None] / step for a, b in zip(v, v[1:])])


def discrete(p, q):
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
    for i in range(len(p)):
        for j in range(len(q)):
            before = [d[x, y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            d[i, j] = max(d[i, j], min(before)) if before else d[i, j]
    return d[-1, -1]


def test_continuous_frechet_equals_fine_resampling(spark):
    rng = random.Random(2)
    line = lambda: [(50 + rng.uniform(-0.5, 0.5), 179.8 + rng.uniform(-0.5, 0.5)) for _ in range(rng.randint(1, 5))]
    rows = [(k, line(), line()) for k in range(30)] + [(30, [(1.0, 1.0), (1.0, 2.0)], [(1.0, 1.0), (1.0, 1.5), (1.0, 1.5), (1.0, 2.0)])]
    # near one course, with points at places of their own
    course = lambda: [(x + rng.uniform(-0.05, 0.05), 2 * x) for x in (0.0, *sorted(rng.uniform(0, 2) for _ in range(rng.randint(0, 4))), 2.0)]
    rows += [(k, course(), course()) for k in range(31, 45)]
    df = spark.createDataFrame(rows, f"id long, x array<{POINT}>, y array<{POINT}>")
    got = df.select("id", lines.continuous_frechet(F.col("x"), F.col("y")).alias("c"), lines.continuous_frechet(F.col("y"), F.col("x")).alias("r"), geo.frechet("x", "y").alias("d")).collect()
    for r in got:
        p, q = dense(rows[r.id][1]), dense(rows[r.id][2])
        step = max([0.0, *(np.linalg.norm(w[1:] - w[:-1], axis=1).max() for w in (p, q) if len(w) > 1)])
        fine = lines._arc(discrete(p, q))
        assert fine - step - 1e-6 <= r.c <= fine + 1e-6 and r.c <= r.d + 1e-6 and r.c == pytest.approx(r.r, abs=1e-6)
    assert sum(r.c < r.d - 1 for r in got) > 5
    # the parallel leaves the great circle by 4 m, pieces by SAG each
    assert got[30].c <= 0.005 + 2 * lines.SAG and got[30].d > 50


def test_long_edges_follow_the_great_circle(spark):
    far = [(0.0, 0.0), (0.0, 90.0)]
    rows = [(1, far, [(0.0, x) for x in range(0, 91, 10)]), (2, far, [(0.0, 0.0), (45.0, 0.0), (0.0, 90.0)]), (3, [(0.0, 0.0)], far)]
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in x], [tuple(map(float, p)) for p in y]) for i, x, y in rows], f"id long, x array<{POINT}>, y array<{POINT}>")
    got = {r.id: r.c for r in df.select("id", lines.continuous_frechet(F.col("x"), F.col("y")).alias("c")).collect()}
    quarter = 6371 * np.pi / 2
    assert got[1] <= 2 * lines.SAG and got[2] == pytest.approx(quarter / 2, abs=2 * lines.SAG) and got[3] == pytest.approx(quarter, abs=1e-6)


def test_line_join_equals_brute_force(spark, shapes):
    s, t = shapes
    every = s.select(F.col("id").alias("source"), F.col("pts").alias("x")).crossJoin(t.select(F.col("id").alias("target"), F.col("pts").alias("y")))
    every = every.select("source", "target", lines.continuous_frechet(F.col("x"), F.col("y")).alias("d"))
    want = {(r.source, r.target): r.d for r in every.where(F.col("d") <= gj.max_km(0.02)).collect()}
    got = {(r.source, r.target): 1 / r.sim - 1 for r in gj.line_join(s, t, "id", "pts", 0.02).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    odd = spark.createDataFrame([(1, []), (2, None), (3, [(None, 2.0), (1.0, 2.0)]), (4, [(1.0, 2.0)])], SHAPE)
    assert {(r.source, r.target) for r in gj.line_join(odd, odd, "id", "pts", 0.5).collect()} == {(4, 4)}


@pytest.mark.parametrize("name", ["hausdorff", "sym_hausdorff"])
def test_sets_without_points(spark, name):
    df = spark.createDataFrame([(1, []), (2, None), (3, [(1.0, 2.0)]), (4, [(1.0, 2.0), (1.0, 2.01)])], SHAPE)
    got = {(r.source, r.target) for r in gj.shape_join(df, df, "id", "pts", 0.4, name).collect()}
    assert got == {(3, 3), (3, 4), (4, 3), (4, 4)}
    assert gj.shape_join(df.limit(0), df, "id", "pts", 0.4, name).collect() == []


def test_outlines_never_pass_the_distance(spark, walks, shapes):
    for s, t in (walks, shapes):
        every = s.select(F.col("pts").alias("x")).crossJoin(t.select(F.col("pts").alias("y")))
        rows = every.select(geo.hausdorff_above(geo.outline(F.col("x")), geo.outline(F.col("y"))).alias("above"), geo.hausdorff(F.col("x"), F.col("y")).alias("d"))
        assert all(r.above <= r.d + 1e-6 for r in rows.collect())


@pytest.mark.parametrize("dims,granularity", [(1, 1), (2, 1), (3, 1), (2, 3)])
def test_euclidean_equals_brute_force(spark, dims, granularity):
    rng = random.Random(5)

    def df(n):
        return spark.createDataFrame([(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(n)], "id long, v array<double>")

    s, t = df(60), df(60)
    theta = 0.5
    got = [(r.source, r.target) for r in rj.euclidean_join(s, t, "id", "v", theta, dims, granularity).collect()]
    a, b = s.collect(), t.collect()
    want = {(x.id, y.id) for x in a for y in b if sum((p - q) ** 2 for p, q in zip(x.v, y.v)) ** 0.5 <= 1}
    assert want and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("dims", [1, 2])
def test_euclidean_of_sets_equals_brute_force(spark, dims):
    rng = random.Random(6)
    draw = lambda: [[round(rng.uniform(-6, 6), 1) for _ in range(rng.choice([0, 1, 2, 3, 3]))] for _ in range(3)]
    a = [(i, draw()) for i in range(60)] + [(60, [[1.0, 1.0], [2.0], [3.0]]), (61, [[1.0], [2.0], [3.0, 3.0]]), (62, None), (63, [])]
    b = [(i, draw()) for i in range(60)] + [(60, [[None, 1.5], [2.0], [3.0]]), (61, [[None], [2.0], [3.0]])]
    s, t = (spark.createDataFrame(x, "id long, v array<array<double>>") for x in (a, b))

    def gap(x, y):
        per = [[abs(p - q) for p in u for q in v if p is not None and q is not None] for u, v in zip(x or [], y)]
        return sum(min(g) ** 2 for g in per) ** 0.5 if per and all(per) else 9

    want = {(i, j): gap(x, y) for i, x in a for j, y in b if gap(x, y) <= 1 and i != 61}
    got = {(r.source, r.target): (1 / r.sim - 1, r.n_source) for r in rj.euclidean_sets_join(s, t, "id", "v", 0.5, dims).collect()}
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k]), 2 if k[0] == 60 else 1) for k in want)
    same = {(r.source, r.target) for r in rj.euclidean_sets_join(s, t, "id", "v", 1.0, dims).collect()}
    assert same == {(i, j) for i, x in a for j, y in b if gap(x, y) == 0 and i != 61}
    assert (60, 60) in got and rj.euclidean_sets_join(s.limit(0), t, "id", "v", 0.5).collect() == []


@pytest.mark.parametrize("measure,theta", [("exp", 0.9), ("day", 0.99), ("year", 0.9999), ("exp", 1.0)])
def test_date_join(spark, measure, theta):
    import datetime as dt
    import math

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k * k % 60) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(days)), "id long, d date")
    sim = {"exp": lambda n: math.exp(-0.01 * n), "day": lambda n: (365 - n) / 365, "year": lambda n: (3650 - n) / 3650}[measure]
    got = rj.date_join(df, df, "id", "d", theta, measure).collect()
    want = {(x, y) for x in set(days) for y in set(days) if sim(abs((x - y).days)) >= theta}
    first = {d: days.index(d) for d in days}
    assert {(r.source, r.target) for r in got} == {(first[x], first[y]) for x, y in want}


def test_date_similarities():
    import math

    assert (round(math.exp(-0.1), 6), round(355 / 365, 6), round(3640 / 3650, 6)) == (0.904837, 0.972603, 0.99726)


def test_crossing_lines(spark):
    s = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 2.0)]), (2, [(5.0, 5.0), (6.0, 6.0)])], SHAPE)
    t = spark.createDataFrame([(1, [(0.0, 2.0), (2.0, 0.0)]), (2, [(0.0, 0.0), (0.0, 2.0)])], SHAPE)
    assert [(r.source, r.target) for r in gj.crossing_lines(s, t, "id", "pts").collect()] == [(1, 1)]


def test_disjoint_is_not_listed(spark, shapes):
    with pytest.raises(ValueError):
        gj.topology_join(*shapes, "id", "pts", "disjoint")


def joins(df):
    return [line.split(" Join ")[-1] for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if " Join " in f" {line.strip(' :+-')} " or "Aggregate" in line]


@pytest.mark.parametrize("name", ["min", "max", "hausdorff", "mean"])
def test_pairs_are_tested_where_they_are_found(spark, shapes, name):
    """One join, and neither a list of pairs made distinct nor points attached to it afterwards."""
    assert len(joins(gj.shape_join(*shapes, "id", "pts", 0.05, name))) == 1
    assert len(joins(gj.line_join(*shapes, "id", "pts", 0.05))) == 1


def test_regions_are_tested_where_their_boxes_meet(spark):
    ring = "id long, r array<struct<lat:double,lon:double>>"
    squares = [[(i, [(0.31 * i + d, 0.0), (0.31 * i + d, 1.0), (0.31 * i + 1.0 + d, 1.0), (0.31 * i + 1.0 + d, 0.0)]) for i in range(20)] for d in (0.0, 0.1)]
    found = gj.polygon_join(*[spark.createDataFrame(x, ring) for x in squares], "id", "r", "overlaps")
    assert len([x for x in joins(found) if "Aggregate" not in x]) == 1  # the levels are counted in subqueries
    want = {(i, j) for i in range(20) for j in range(20) if abs(0.31 * i - 0.31 * j - 0.1) < 1}
    got = [(r.source, r.target) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_large_and_incomplete_shapes_join_like_carried_ones(spark, shapes, monkeypatch):
    s, t = shapes
    carried = {(r.source, r.target): r.sim for r in gj.shape_join(s, t, "id", "pts", 0.05, "sum_of_min").collect()}
    monkeypatch.setattr(gj, "CARRIED", 2)
    mixed = [(r.source, r.target, r.sim) for r in gj.shape_join(s, t, "id", "pts", 0.05, "sum_of_min").collect()]
    assert carried and {x[:2] for x in mixed} == carried.keys() and len(mixed) == len(carried)
    assert all(carried[x[:2]] == pytest.approx(x[2], abs=1e-9) for x in mixed)
    hole = spark.createDataFrame([(1, [(0.0, 0.0), (None, 1.0)])], SHAPE)
    whole = spark.createDataFrame([(2, [(0.0, 0.1), (5.0, 5.0)])], SHAPE)
    assert [(r.source, r.target) for r in gj.shape_join(hole, whole, "id", "pts", 0.05, "min").collect()] == [(1, 2)]


def test_distances_of_few_points(spark):
    rng = random.Random(5)
    few = lambda: [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(rng.randint(1, 5))]
    df = spark.createDataFrame([(few(), few()) for _ in range(60)], f"x array<{POINT}>, y array<{POINT}>")
    names = [n for n in geo.SET_DISTANCES if n != "mean"]
    one = [geo.SET_DISTANCES[n](F.col("x"), F.col("y")).alias(n) for n in names]
    for r in df.select(*one, *[geo.few_points(n)(F.col("x"), F.col("y")).alias(f"{n}_few") for n in names]).collect():
        assert all(r[n] == pytest.approx(r[f"{n}_few"], abs=1e-9) for n in names)


def test_pairs_of_number_sets_are_measured_where_they_are_found(spark):
    """Whichever side is smaller: candidates are not grouped, and a pair that shares many cells comes once."""
    rng = random.Random(5)
    rows = lambda n, at: [(at + i, [[rng.uniform(0, 3)], [rng.uniform(0, 4) for _ in range(6)]]) for i in range(n)]
    few, many = rows(8, 0), rows(30, 100)
    for a, b in ((few, many), (many, few)):
        s, t = (spark.createDataFrame(x, "id long, v array<array<double>>") for x in (a, b))
        df = rj.euclidean_sets_join(s, t, "id", "v", 0.5)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan
        far = lambda x, y: sum(min(abs(p - q) for p in u for q in w) ** 2 for u, w in zip(x, y)) ** 0.5
        want = sorted((i, j) for i, x in a for j, y in b if far(x, y) <= 1)
        assert len(want) > 50 and sorted((r.source, r.target) for r in df.collect()) == want


def test_frechet_works_on_many_pairs_at_a_time():
    """Lines of all sizes in one batch, with missing ones between: values do not depend on what else is there,
    and a batch takes a few array steps for each pair of sizes, not some for each pair of lines."""
    rng = random.Random(3)
    kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
    line = lambda n: [{"lat": 10 + rng.uniform(0, 0.1), "lon": 179.95 + rng.uniform(0, 0.1)} for _ in range(n)]
    xs = [None, [], [{"lat": None, "lon": 1.0}], [None], [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 30.0}], *[line(rng.randint(1, 5)) for _ in range(600)]]
    ys = xs[:5] + [line(rng.randint(1, 5)) for _ in xs[5:]]
    steps = []
    within = lines._FreeSpace.within
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lines._FreeSpace, "within", lambda space, far: steps.append(len(far)) or within(space, far))
        got = lines._distances(pa.array(xs, kind), pa.array(ys, kind), 9.0)
    assert len(steps) < 1500 and max(steps) > 20
    assert np.isnan(got[:4]).all() and got[4] == 0 and 0 < np.isnan(got[5:]).sum() < 600
    for k in range(0, len(xs), 7):
        assert np.array_equal(lines._distances(pa.array([xs[k]], kind), pa.array([ys[k]], kind), 9.0), got[k : k + 1], equal_nan=True)
