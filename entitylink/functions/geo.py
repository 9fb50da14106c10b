"""Great-circle and ellipsoid distances, point-set distances, box relations.

Points are structs with lat and lon in degrees; distances are kilometres.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from entitylink.functions.common import once

# Mean earth radius (km) and the WGS84 ellipsoid (m).
EARTH_KM = 6371.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def haversine(p: Column, q: Column) -> Column:
    a, b = F.radians(p.lat), F.radians(q.lat)
    s, t = F.sin((b - a) / 2), F.sin(F.radians(q.lon - p.lon) / 2)
    h = s * s + F.cos(a) * F.cos(b) * t * t
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _haversine_np(lat1, lon1, lat2, lon2):
    s, t = np.sin((lat2 - lat1) / 2), np.sin((lon2 - lon1) / 2)
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(s * s + np.cos(lat1) * np.cos(lat2) * t * t, 1)))


@pandas_udf(DoubleType())
def ellipsoid(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """WGS84 distance by Vincenty's inverse formula, vectorised; haversine where it
    does not converge."""
    p1, l1, p2, l2 = (np.radians(x.to_numpy(dtype=float)) for x in (lat1, lon1, lat2, lon2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(p1)), np.arctan((1 - WGS84_F) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    diff = (l2 - l1 + np.pi) % (2 * np.pi) - np.pi
    lam, done = diff.copy(), np.zeros(len(diff), dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sig = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, c1 * c2 * sl / sin_s)
            cos2a = 1 - sin_a**2
            cos2m = np.where(cos2a == 0, 0, cos_s - 2 * s1 * s2 / cos2a)
            c = WGS84_F / 16 * cos2a * (4 + WGS84_F * (4 - 3 * cos2a))
            new = diff + (1 - c) * WGS84_F * sin_a * (sig + c * sin_s * (cos2m + c * cos_s * (2 * cos2m**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        u = cos2a * (WGS84_A**2 - b**2) / b**2
        k = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        m = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = m * sin_s * (cos2m + m / 4 * (cos_s * (2 * cos2m**2 - 1) - m / 6 * cos2m * (4 * sin_s**2 - 3) * (4 * cos2m**2 - 3)))
        far = b * k * (sig - ds) / 1000
    return pd.Series(np.where(done & np.isfinite(far), far, _haversine_np(p1, l1, p2, l2)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _nearest(xs: Column, ys: Column) -> Column:
    """For each x the distance to its nearest y."""
    return F.transform(xs, lambda x: F.array_min(F.transform(ys, lambda y: haversine(x, y))))


def _each(xs: Column, ys: Column, fold: Callable[[Column], Column]) -> Column:
    """For each x a fold of its distances to all y; one row of distances at a time."""
    return F.transform(xs, lambda x: fold(F.transform(ys, lambda y: haversine(x, y))))


def hausdorff(xs: Column, ys: Column) -> Column:
    return F.array_max(_nearest(xs, ys))


def symmetric_hausdorff(xs: Column, ys: Column) -> Column:
    return F.greatest(hausdorff(xs, ys), hausdorff(ys, xs))


# Hausdorff distances up to a limit. Rounding gets this much room, in shares and in degrees or km.
_ROOM, _LEAST = 1 + 1e-9, 1e-9


def outline(pts: Column) -> Column:
    """Bounds of a set for ``hausdorff_above``: the mean point, the distance ``km`` within which
    all points lie from it, and the points that stand out in the four directions (``far``)."""
    flip = F.transform(pts, lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat")))
    ends = [F.array_min(pts), F.array_max(pts), F.array_min(flip), F.array_max(flip)]
    far = F.array(*[F.struct(e.lat.alias("lat"), e.lon.alias("lon")) for e in ends])
    of = lambda c: F.struct(c.alias("centre"), F.array_max(F.transform(pts, lambda p: haversine(c, p))).alias("km"), far.alias("far"))
    return once(mean_point(pts), of)


def hausdorff_above(a: Column, b: Column) -> Column:
    """A bound that the Hausdorff distance from a set to another is never below, from their
    outlines: no point of the other is nearer to x than its circle is."""
    return F.array_max(F.transform(a.far, lambda x: haversine(x, b.centre))) - b.km


def _reach(xs: Column, km: float) -> Column:
    """Points with how many degrees of longitude a point within ``km`` can be away."""
    r = np.degrees(km / EARTH_KM) * _ROOM + _LEAST

    def one(x: Column) -> Column:
        steep = (F.abs(x.lat) + r >= 90) | F.lit(r >= 90)
        reach = F.degrees(F.asin(F.least(np.sin(np.radians(min(r, 90))) / F.cos(F.radians(x.lat)), F.lit(1.0)))) * _ROOM + _LEAST
        return F.struct(x.lat.alias("lat"), x.lon.alias("lon"), F.when(steep, F.lit(360.0)).otherwise(reach).alias("reach"))

    return F.transform(xs, one)


def _boxed(x: Column, y: Column, km: float) -> Column:
    """Whether y may lie within ``km`` of x, without a distance."""
    r = float(np.degrees(km / EARTH_KM) * _ROOM + _LEAST)
    turn = F.pmod(y.lon - x.lon + 180, F.lit(360.0)) - 180
    return (F.abs(y.lat - x.lat) <= r) & (F.abs(turn) <= x.reach)


def all_near(xs: Column, ys: Column, km: float) -> Column:
    """Whether every point of the first set has one of the second within ``km`` (and a rounding
    error). Ends at the first point that has none, and for a point at the first one near."""
    near = lambda x: F.exists(ys, lambda y: _boxed(x, y, km) & (haversine(x, y) <= km * _ROOM + _LEAST))
    return F.forall(_reach(xs, km), lambda x: x.lat.isNull() | x.lon.isNull() | F.coalesce(near(x), F.lit(False)))


def hausdorff_within(xs: Column, ys: Column, km: float) -> Column:
    """``hausdorff`` where that is at most ``km``: distances only to points in the box around each."""
    near = lambda x: F.filter(ys, lambda y: _boxed(x, y, km * _ROOM + _LEAST))
    return F.array_max(F.transform(_reach(xs, km * _ROOM + _LEAST), lambda x: F.array_min(F.transform(near(x), lambda y: haversine(x, y)))))


def set_min(xs: Column, ys: Column) -> Column:
    return F.array_min(_each(xs, ys, F.array_min))


def set_max(xs: Column, ys: Column) -> Column:
    return F.array_max(_each(xs, ys, F.array_max))


def set_avg(xs: Column, ys: Column) -> Column:
    return _sum(_each(xs, ys, _sum)) / (F.size(xs) * F.size(ys))


def mean_point(xs: Column) -> Column:
    n = F.size(xs)
    lat, lon = F.transform(xs, lambda p: p.lat), F.transform(xs, lambda p: p.lon)
    return F.struct((_sum(lat) / n).alias("lat"), (_sum(lon) / n).alias("lon"))


def ball(pts: Column) -> Column:
    """Bounds of a set in space, on the unit sphere: the mean (x, y, z) of its points, the radius
    ``r`` within which they lie from it, and their number ``n``."""

    def vector(p: Column) -> Column:
        a, b = F.radians(p.lat), F.radians(p.lon)
        return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))

    def of(v: Column) -> Column:
        mean = F.struct(*[(_sum(F.transform(v, lambda p: p[c])) / F.size(v)).alias(c) for c in "xyz"])
        return once(mean, lambda m: F.struct(*[m[c].alias(c) for c in "xyz"], F.array_max(F.transform(v, lambda p: apart(m, p))).alias("r"), F.size(v).alias("n")))

    return once(F.transform(pts, vector), of)


def apart(a: Column, b: Column) -> Column:
    """Straight distance of two places in space."""
    return F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))


def may_reach(distance, a: Column, b: Column, km: float) -> Column:
    """Whether two sets may be at most ``km`` apart by a set distance, from their balls.

    A straight distance is never above the great circle's, and a mean point is no farther
    from a place than the set's points are on average.
    """
    between, sum_ = apart(a, b), km / EARTH_KM
    far = 2 * float(np.sin(min(sum_ / 2, np.pi / 2)))
    larger = F.greatest(a.n, b.n)
    room = {
        "hausdorff": between - b.r - far,
        "sym_hausdorff": between - F.least(a.r, b.r) - far,
        "frechet": between - F.least(a.r, b.r) - far,
        "max": between - far,
        "avg": between - sum_,
        "sum_of_min": between * (a.n + b.n) - a.n * b.r - b.n * a.r - 2 * sum_,
        # every point of the larger set is paired at least once
        **dict.fromkeys(("link", "fair_surjection", "surjection"), larger * (between - F.greatest(a.r, b.r)) - sum_),
    }
    over = room[distance] if isinstance(distance, str) and distance in room else between - a.r - b.r - far
    # a set with missing coordinates has no ball
    return F.coalesce(over <= _LEAST, F.lit(True))


def mean_distance(xs: Column, ys: Column) -> Column:
    return once(mean_point(xs), lambda p: once(mean_point(ys), lambda q: haversine(p, q)))


def sum_of_min(xs: Column, ys: Column) -> Column:
    return (_sum(_nearest(xs, ys)) + _sum(_nearest(ys, xs))) / 2


def _small_large(xs: Column, ys: Column, use) -> Column:
    """``use(small, large)``; at equal sizes the second set is the small one."""
    return F.when(F.size(xs) < F.size(ys), use(xs, ys)).otherwise(use(ys, xs))


def link_distance(xs: Column, ys: Column) -> Column:
    """Each point of the small set takes its ceil(n/m) nearest of the large; sum."""

    def use(small: Column, large: Column) -> Column:
        share = F.ceil(F.size(large) / F.size(small)).cast("int")
        near = lambda s: F.slice(F.array_sort(F.transform(large, lambda l: haversine(s, l))), F.lit(1), share)
        return _sum(F.transform(small, lambda s: _sum(near(s))))

    return _small_large(xs, ys, use)


fair_surjection = link_distance  # the same pairing, so the same sum


def surjection(xs: Column, ys: Column) -> Column:
    """Small points in order take their nearest free large point; the large points
    left over go to their nearest small point; sum."""

    def use(small: Column, large: Column) -> Column:
        free = F.transform(large, lambda p, i: F.struct(i.alias("i"), p.lat.alias("lat"), p.lon.alias("lon")))
        start = F.struct(F.lit(0.0).alias("sum"), free.alias("free"))

        def take(state: Column, s: Column) -> Column:
            ranked = F.transform(state.free, lambda p: F.struct(haversine(s, p).alias("d"), p.i.alias("i")))
            return once(
                F.array_min(ranked),
                lambda best: F.struct(
                    (state.sum + best.d).alias("sum"), F.filter(state.free, lambda p: p.i != best.i).alias("free")
                ),
            )

        return F.aggregate(small, start, take, lambda st: st.sum + _sum(_nearest(st.free, small)))

    return _small_large(xs, ys, use)


def _walk(enter: np.ndarray, d: np.ndarray) -> np.ndarray:
    """best[j] = min(enter[j], max(best[j - 1], d[j])), by doubling steps: log2(n) passes."""
    best, cost, step = enter.copy(), d.copy(), 1
    while step < len(d):
        ahead = np.maximum(best[:-step], cost[step:])
        best[step:] = np.minimum(best[step:], ahead)
        cost[step:] = np.maximum(cost[step:], cost[:-step])
        step *= 2
    return best


@pandas_udf(DoubleType())
def frechet(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Discrete Frechet distance of two point sequences."""

    def one(a, b) -> float | None:
        if a is None or b is None:
            return None
        p, q = (np.radians([[t["lat"], t["lon"]] for t in s]) for s in (a, b))
        # One row of distances at a time. Along a row the reach is the running
        # "max of the distance, min of what came before": a scan of max and min.
        row = None
        for lat, lon in p:
            d = _haversine_np(lat, lon, q[:, 0], q[:, 1])
            if row is None:
                row = np.maximum.accumulate(d)
                continue
            enter = np.maximum(np.minimum(row, np.concatenate(([np.inf], row[:-1]))), d)
            row = _walk(enter, d)
        return float(row[-1])

    return pd.Series([one(a, b) for a, b in zip(xs, ys)], dtype=float)


SET_DISTANCES = {
    "hausdorff": hausdorff,
    "sym_hausdorff": symmetric_hausdorff,
    "min": set_min,
    "max": set_max,
    "avg": set_avg,
    "mean": mean_distance,
    "sum_of_min": sum_of_min,
    "link": link_distance,
    "surjection": surjection,
    "fair_surjection": fair_surjection,
    "frechet": frechet,
}


# The same over arrays of distances [pair, x, y], for sets of few points.


def _small_first(d: np.ndarray) -> np.ndarray:
    return d if d.shape[1] < d.shape[2] else d.transpose(0, 2, 1)


def _np_link(d: np.ndarray) -> np.ndarray:
    d = _small_first(d)
    return np.sort(d, axis=2)[:, :, : -(-d.shape[2] // d.shape[1])].sum(axis=(1, 2))


def _np_surjection(d: np.ndarray) -> np.ndarray:
    d = _small_first(d)
    rows, total, free = np.arange(len(d)), np.zeros(len(d)), np.ones((len(d), d.shape[2]), dtype=bool)
    for i in range(d.shape[1]):
        best = np.where(free, d[:, i], np.inf).argmin(axis=1)
        total += d[rows, i, best]
        free[rows, best] = False
    return total + np.where(free, d.min(axis=1), 0).sum(axis=1)


def _np_frechet(d: np.ndarray) -> np.ndarray:
    best = np.maximum.accumulate(d[:, 0], axis=1)
    for row in d.transpose(1, 0, 2)[1:]:
        last, best = best, np.empty_like(best)
        best[:, 0] = np.maximum(last[:, 0], row[:, 0])
        for j in range(1, row.shape[1]):
            best[:, j] = np.maximum(row[:, j], np.minimum(np.minimum(last[:, j], last[:, j - 1]), best[:, j - 1]))
    return best[:, -1]


_FOLDS = {
    "hausdorff": lambda d: d.min(axis=2).max(axis=1),
    "sym_hausdorff": lambda d: np.maximum(d.min(axis=2).max(axis=1), d.min(axis=1).max(axis=1)),
    "min": lambda d: d.min(axis=(1, 2)),
    "max": lambda d: d.max(axis=(1, 2)),
    "avg": lambda d: d.mean(axis=(1, 2)),
    "sum_of_min": lambda d: (d.min(axis=2).sum(axis=1) + d.min(axis=1).sum(axis=1)) / 2,
    "link": _np_link,
    "fair_surjection": _np_link,
    "surjection": _np_surjection,
    "frechet": _np_frechet,
}


def few_points(distance: str) -> Callable[[Column, Column], Column]:
    """``SET_DISTANCES[distance]`` of sets of few points without missing coordinates, worked out
    for all pairs of a batch that have sets of the same sizes."""

    def flat(sets: pa.ListArray) -> tuple[np.ndarray, ...]:
        starts = sets.offsets.to_numpy()
        return starts[:-1], np.diff(starts), *(c.to_numpy(zero_copy_only=False) for c in sets.values.flatten())

    @F.arrow_udf(DoubleType())
    def measured(xs: pa.Array, ys: pa.Array) -> pa.Array:
        (at_x, n_x, lat_x, lon_x), (at_y, n_y, lat_y, lon_y) = flat(xs), flat(ys)
        out = np.full(len(n_x), np.nan)
        for n, m in np.unique(np.stack((n_x, n_y)), axis=1).T:
            rows = np.flatnonzero((n_x == n) & (n_y == m))
            if n and m:
                x, y = (at_x[rows, None] + np.arange(n))[:, :, None], (at_y[rows, None] + np.arange(m))[:, None, :]
                out[rows] = _FOLDS[distance](_haversine_np(np.radians(lat_x)[x], np.radians(lon_x)[x], np.radians(lat_y)[y], np.radians(lon_y)[y]))
        return pa.array(out, mask=np.isnan(out))

    return measured


# boxes: structs with lat_lo, lat_hi, lon_lo, lon_hi


def _axes(test, a: Column, b: Column) -> Column:
    return test(a.lat_lo, a.lat_hi, b.lat_lo, b.lat_hi) & test(a.lon_lo, a.lon_hi, b.lon_lo, b.lon_hi)


def box_intersects(a: Column, b: Column) -> Column:
    return _axes(lambda lo, hi, lo2, hi2: (lo <= hi2) & (lo2 <= hi), a, b)


def _inside_meet(a: Column, b: Column) -> Column:
    return _axes(lambda lo, hi, lo2, hi2: (lo < hi2) & (lo2 < hi), a, b)


def box_equals(a: Column, b: Column) -> Column:
    return _axes(lambda lo, hi, lo2, hi2: (lo == lo2) & (hi == hi2), a, b)


def box_within(a: Column, b: Column) -> Column:
    return _axes(lambda lo, hi, lo2, hi2: (lo >= lo2) & (hi <= hi2), a, b)


BOX_RELATIONS = {
    "equals": box_equals,
    "disjoint": lambda a, b: ~box_intersects(a, b),
    "intersects": box_intersects,
    "touches": lambda a, b: box_intersects(a, b) & ~_inside_meet(a, b),
    "within": box_within,
    "contains": lambda a, b: box_within(b, a),
    "overlaps": lambda a, b: _inside_meet(a, b) & ~box_within(a, b) & ~box_within(b, a),
}


def bounding_box(pts: Column) -> Column:
    lat, lon = F.transform(pts, lambda p: p.lat), F.transform(pts, lambda p: p.lon)
    return F.struct(
        F.array_min(lat).alias("lat_lo"), F.array_max(lat).alias("lat_hi"), F.array_min(lon).alias("lon_lo"), F.array_max(lon).alias("lon_hi")
    )


def lines_cross(xs: Column, ys: Column) -> Column:
    """Whether any segment of one line properly crosses one of the other."""

    def segments(pts: Column) -> Column:
        ends = F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0)))
        return F.filter(F.arrays_zip(pts.alias("p"), ends.alias("q")), lambda s: s.q.isNotNull())

    def side(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon))

    def cross(s: Column, t: Column) -> Column:
        return (side(s.p, s.q, t.p) * side(s.p, s.q, t.q) < 0) & (side(t.p, t.q, s.p) * side(t.p, t.q, s.q) < 0)

    return once(
        F.struct(segments(xs).alias("x"), segments(ys).alias("y")),
        lambda b: F.exists(b.x, lambda s: F.exists(b.y, lambda t: cross(s, t))),
    )
