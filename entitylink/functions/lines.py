"""Frechet distance of lines that run on between their points.

Points become vectors in space. Edges follow the great circle: long ones get points in
between, and each piece is straight, so what lies within a distance of a point is one
interval of it. Distances are those of the great circle over a chord, in km.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import DoubleType

from entitylink.functions.geo import EARTH_KM

# The distance found is feasible and at most this much (km) above the smallest one.
TOLERANCE = 1e-7
# A piece of an edge leaves the great circle by no more than this (km).
SAG = 0.01
# Distances between points that are worked on together; bounds the memory of a task.
AT_ONCE = 1 << 15


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of vectors along the last axis."""
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]


def _angle(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Angles between unit vectors."""
    return 2 * np.arcsin(np.minimum(np.sqrt(_dot(q - p, q - p)) / 2, 1.0))


def _parts(angle: np.ndarray) -> np.ndarray:
    """Number of pieces of an edge over an angle. Opposite ends of the earth have no great circle
    of their own: that edge goes through the middle."""
    n = np.maximum(1, np.ceil(angle * EARTH_KM / np.sqrt(8 * EARTH_KM * SAG))).astype(int)
    return np.where(np.sin(angle) < 1e-9, 1, n)


def _pieces(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Ends of the pieces of an edge between two unit vectors."""
    angle = _angle(p, q)
    n = int(_parts(angle))
    if n == 1:
        return q[None]
    t = np.arange(1, n + 1)[:, None] / n
    return (np.sin((1 - t) * angle) * p + np.sin(t * angle) * q) / np.sin(angle)


def _chord(km: float) -> float:
    return 2 * EARTH_KM * float(np.sin(min(km / (2 * EARTH_KM), np.pi / 2)))


def _arc(chord):
    return 2 * EARTH_KM * np.arcsin(np.minimum(chord / (2 * EARTH_KM), 1.0))


class _Sides:
    """Every point of the lines of one side against every edge of the others, for many pairs:
    [pair, point, edge]."""

    def __init__(self, points: np.ndarray, line: np.ndarray):
        edge = line[:, 1:] - line[:, :-1]
        off = points[:, :, None, :] - line[:, None, :-1, :]
        self.along = _dot(off, edge[:, None])
        self.size = np.broadcast_to(_dot(edge, edge)[:, None], self.along.shape)
        self.apart = _dot(off, off)
        self.flat = self.size == 0

    def take(self, rows: np.ndarray) -> _Sides:
        part = copy.copy(self)
        part.along, part.size, part.apart, part.flat = (x[rows] for x in (self.along, self.size, self.apart, self.flat))
        return part

    def nearest(self) -> np.ndarray:
        """Distance of each point to each edge."""
        t = np.clip(self.along / np.where(self.flat, 1, self.size), 0, 1)
        return np.sqrt(np.maximum(self.apart - 2 * t * self.along + t * t * self.size, 0))

    def free(self, far: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (0 to 1) of each edge within ``far`` of each point; (2, -1) where
        there is none. ``ends``: which points of the line are that near."""
        root = self.along**2 - self.size * (self.apart - (far * far)[:, None, None])
        width = np.sqrt(np.maximum(root, 0))
        size = np.where(self.flat, 1, self.size)
        lo, hi = np.maximum((self.along - width) / size, 0), np.minimum((self.along + width) / size, 1)
        none = (root < 0) | (lo > hi) | self.flat
        first, last = ends[:, :, :-1], ends[:, :, 1:]
        lo, hi = np.where(none, 2.0, lo), np.where(none, -1.0, hi)
        lo, hi = np.where(first, 0.0, np.where(last, np.minimum(lo, 1), lo)), np.where(last, 1.0, np.where(first, np.maximum(hi, 0), hi))
        return lo, hi


class _FreeSpace:
    """Many pairs of lines, all of the same two numbers of points: p[pair, point], q[pair, point]."""

    def __init__(self, p: np.ndarray, q: np.ndarray):
        off = p[:, :, None, :] - q[:, None, :, :]
        self.corner = np.sqrt(_dot(off, off))
        self.left, self.below = _Sides(p, q), _Sides(q, p)

    def take(self, rows: np.ndarray) -> _FreeSpace:
        part = copy.copy(self)
        part.corner, part.left, part.below = self.corner[rows], self.left.take(rows), self.below.take(rows)
        return part

    def within(self, far: np.ndarray) -> np.ndarray:
        """Whether both lines can be walked to the end, never back, at most ``far`` apart.

        Cells (edge of p, edge of q) on one diagonal do not depend on each other. What is
        reached on a side is the free interval from some place on, kept as that place."""
        near = self.corner <= far[:, None, None]
        n, m = near.shape[1] - 1, near.shape[2] - 1
        lo_l, hi_l = self.left.free(far, near)  # [point of p, edge of q]
        lo_b, hi_b = (x.swapaxes(1, 2) for x in self.below.free(far, near.swapaxes(1, 2)))  # [edge of p, point of q]
        got_l, got_b = np.full((len(near), n + 1, m), 2.0), np.full((len(near), n, m + 1), 2.0)
        got_l[:, 0] = np.where(np.logical_and.accumulate(near[:, 0, :-1], axis=1), 0.0, 2.0)
        got_b[:, :, 0] = np.where(np.logical_and.accumulate(near[:, :-1, 0], axis=1), 0.0, 2.0)
        for d in range(n + m - 1):
            i = np.arange(max(0, d - m + 1), min(n, d + 1))
            j = d - i
            from_l, from_b = got_l[:, i, j], got_b[:, i, j]
            at_l, at_b = from_l <= hi_l[:, i, j], from_b <= hi_b[:, i, j]
            lo, hi = lo_l[:, i + 1, j], hi_l[:, i + 1, j]
            right = np.where(at_b, lo, np.where(at_l, np.maximum(lo, from_l), 2.0))
            got_l[:, i + 1, j] = np.where(right <= hi, right, 2.0)
            lo, hi = lo_b[:, i, j + 1], hi_b[:, i, j + 1]
            top = np.where(at_l, lo, np.where(at_b, np.maximum(lo, from_b), 2.0))
            got_b[:, i, j + 1] = np.where(top <= hi, top, 2.0)
        end = (got_l[:, n, m - 1] <= 1) | (got_b[:, n - 1, m] <= 1)
        return near[:, 0, 0] & near[:, -1, -1] & end

    def smallest(self, most: np.ndarray) -> np.ndarray:
        """Smallest feasible distances, given feasible ones: first among the distances at which
        a side of a cell opens, then between two of those."""
        low = np.maximum(self.corner[:, 0, 0], self.corner[:, -1, -1])
        out = low.copy()
        more = np.flatnonzero(~self.within(low))
        if len(more):
            out[more] = self.take(more)._above(low[more], most[more])
        return out

    def _above(self, low: np.ndarray, most: np.ndarray) -> np.ndarray:
        """``smallest`` where ``low`` is a bound that is not feasible."""
        each = np.arange(len(low))
        values = np.concatenate([x.nearest().reshape(len(low), -1) for x in (self.left, self.below)], axis=1)
        values = np.where((values > low[:, None]) & (values < most[:, None]), values, most[:, None])
        values = np.sort(np.concatenate((values, most[:, None]), axis=1), axis=1)
        lo, hi = np.full(len(low), -1), (values < most[:, None]).sum(axis=1)  # values[hi] is feasible, values[lo] is not

        def halved(lo: np.ndarray, hi: np.ndarray, wide: Callable, middle: Callable, value: Callable) -> None:
            """Halve, until no longer ``wide``, what lies between ``lo`` (not feasible) and ``hi``."""
            space, rows = self, each
            while True:
                go = wide(lo[rows], hi[rows])
                if not go.any():
                    return
                if not go.all():
                    rows, space = rows[go], space.take(go)
                mid = middle(lo[rows], hi[rows])
                yes = space.within(value(rows, mid))
                hi[rows[yes]], lo[rows[~yes]] = mid[yes], mid[~yes]

        halved(lo, hi, lambda a, b: b - a > 1, lambda a, b: (a + b) // 2, lambda rows, mid: values[rows, mid])
        low, high = np.where(lo < 0, low, values[each, np.maximum(lo, 0)]), values[each, hi]
        open_ = np.flatnonzero(high - low > TOLERANCE)
        if len(open_):
            space = self.take(open_)
            low[open_[~space.within(high[open_] - TOLERANCE)]] = np.inf
            halved(low, high, lambda a, b: b - a > TOLERANCE, lambda a, b: (a + b) / 2, lambda rows, mid: mid)
        return high


class _Lines:
    """Lines of a column as vectors; ``size`` 0 for one without points or with a missing coordinate."""

    def __init__(self, column: pa.Array):
        size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        start = np.cumsum(size) - size
        fields = dict(zip((f.name for f in column.type.value_type), column.flatten().flatten()))
        lat, lon = (np.radians(np.asarray(fields[c].cast(pa.float64()).fill_null(np.nan))) for c in ("lat", "lon"))
        v = np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=1)
        row = np.repeat(np.arange(len(size)), size)
        size[row[~np.isfinite(v).all(axis=1)]] = 0
        inner = np.flatnonzero((row[1:] == row[:-1]) & (size[row[1:]] > 0)) if len(row) else []
        long = np.unique(row[inner][_parts(_angle(v[inner], v[np.add(inner, 1)])) > 1]) if len(inner) else np.zeros(0, int)
        made = [np.concatenate([v[a : a + 1], *[_pieces(p, q) for p, q in zip(v[a : a + n], v[a + 1 : a + n])]]) for a, n in zip(start[long], size[long])]
        one = np.flatnonzero(size == 1)  # a single point is a line that stays there
        for rows, sizes, points in ((long, [len(x) for x in made], made), (one, [2] * len(one), [np.repeat(v[start[one]], 2, axis=0)])):
            size[rows] = sizes
            start[rows] = len(v) + np.cumsum(size[rows]) - size[rows]
            v = np.concatenate([v, *points])
        self.at, self.start, self.size = EARTH_KM * v, start, size

    def points(self, rows: np.ndarray) -> np.ndarray:
        """[row, point] of rows of one size."""
        return self.at[self.start[rows, None] + np.arange(self.size[rows[0]])]


def _vectors(points) -> np.ndarray | None:
    """One line in km from the middle of the earth."""
    line = _Lines(pa.array([points], pa.list_(pa.struct([(c, pa.float64()) for c in ("lat", "lon")]))))
    return line.points(np.array([0]))[0] if line.size[0] else None


def _distances(xs: pa.Array, ys: pa.Array, km: float | None) -> np.ndarray:
    """Frechet distances of pairs; nan where there is none, or none within ``km``."""
    p, q = _Lines(xs), _Lines(ys)
    out = np.full(len(xs), np.nan)
    given = np.flatnonzero((p.size > 0) & (q.size > 0))
    _, kind, size = np.unique(np.stack((p.size[given], q.size[given]), axis=1), axis=0, return_inverse=True, return_counts=True)
    for rows in np.split(given[np.argsort(kind.ravel(), kind="stable")], np.cumsum(size)[:-1]):
        step = max(1, AT_ONCE // int(p.size[rows[0]] * q.size[rows[0]])) if len(rows) else 1
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            space = _FreeSpace(p.points(part), q.points(part))
            if km is None:
                most = space.corner.max(axis=(1, 2))
            else:
                most = np.full(len(part), _chord(km))
                fits = space.within(most)
                part, most, space = part[fits], most[fits], space.take(fits)
            if len(part):
                out[part] = _arc(space.smallest(most))
    return out


def continuous_frechet(xs: Column, ys: Column, km: float | None = None) -> Column:
    """Frechet distance in km of two lines; null for a line without points or with a missing
    coordinate, and for a pair farther apart than ``km``, where that is given."""

    @arrow_udf(DoubleType())
    def distance(xs: pa.Array, ys: pa.Array) -> pa.Array:
        found = _distances(xs, ys, km)
        return pa.array(found, mask=np.isnan(found))

    return distance(xs, ys)
