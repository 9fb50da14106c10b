"""Exact relations of regions, and of lines and regions.

A region is an array of rings, a ring an array of points (structs with lat and lon)
that closes itself; a repeated last point is allowed. A point belongs to a region if an
odd number of rings go round it, so inner rings are holes and outer ones islands. Rings
enclose an area and do not cut or retrace each other or themselves.

Every edge is cut where it meets the other border, so each piece is inside, outside or
shared. A shared piece tells whether both regions lie on its same side. That settles four
bits: whether the insides meet, whether the shapes meet at all, and whether each reaches
outside of the other. Where rounding cannot change the side of any corner, borders that
cross and a point of each ring settle them; other pairs are worked out in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a relation: insides meet, shapes meet, the first reaches outside the second,
# the second outside the first.
INSIDES, MEET, FIRST_OUT, SECOND_OUT = 1, 2, 4, 8
# Of the sum of its two products, what a turn must exceed for its sign to be certain
# (rounding is below 4 units of 2**-53).
CERTAIN = 1e-15
# Pairs of edges looked at together; bounds the memory of a task.
AT_ONCE = 1 << 18
# The same for pairs of single rings: their numbers stay in the cache.
LANE = 1 << 15


def _has(mask, bit: int):
    return (mask.bitwiseAND(F.lit(bit)) if isinstance(mask, Column) else mask & bit) != 0


RELATIONS = {
    "intersects": lambda m: _has(m, MEET),
    "disjoint": lambda m: ~_has(m, MEET),
    "touches": lambda m: _has(m, MEET) & ~_has(m, INSIDES),
    "within": lambda m: _has(m, INSIDES) & ~_has(m, FIRST_OUT),
    "contains": lambda m: _has(m, INSIDES) & ~_has(m, SECOND_OUT),
    "equals": lambda m: _has(m, INSIDES) & ~_has(m, FIRST_OUT) & ~_has(m, SECOND_OUT),
    "overlaps": lambda m: _has(m, INSIDES) & _has(m, FIRST_OUT) & _has(m, SECOND_OUT),
}
# A line crosses a region that it runs both inside and outside of.
LINE_RELATIONS = {
    "crosses": lambda m: _has(m, INSIDES) & _has(m, FIRST_OUT),
    "within": lambda m: _has(m, INSIDES) & ~_has(m, FIRST_OUT),
    "touches": lambda m: _has(m, MEET) & ~_has(m, INSIDES),
    "intersects": lambda m: _has(m, MEET),
    "disjoint": lambda m: ~_has(m, MEET),
}


def line_edges(pts: Column) -> Column:
    """Edges (p, q) of a line, without those of no length."""
    ends = F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0)))
    return F.filter(F.arrays_zip(pts.alias("p"), ends.alias("q")), lambda e: e.q.isNotNull() & (e.p != e.q))


def region_edges(rings: Column) -> Column:
    """Edges (p, q) of all rings, without those of no length."""
    closed = F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: line_edges(F.concat(r, F.slice(r, 1, 1))))
    return F.flatten(closed)


def _starts(shape: Column, line: bool) -> Column:
    """A point of each ring, or of the line."""
    return F.slice(shape, 1, 1) if line else F.transform(F.filter(shape, lambda r: F.size(r) > 0), lambda r: F.get(r, F.lit(0)))


def flat_shape(shape: Column, line: bool = False) -> Column:
    """What ``with_relation`` needs of a region, or with ``line`` of a line, as flat numbers: coordinates
    of its edges, and of a point of each ring."""
    edges = line_edges(shape) if line else region_edges(shape)
    numbers = F.flatten(F.transform(edges, lambda e: F.array(e.p.lat, e.p.lon, e.q.lat, e.q.lon)))
    starts = F.flatten(F.transform(_starts(shape, line), lambda p: F.array(p.lat, p.lon)))
    return F.struct(numbers.alias("edges"), starts.alias("starts"))


def with_relation(rows: DataFrame, a: str, b: str, line: bool = False, flat: bool = False, wanted: Callable | None = None) -> DataFrame:
    """``rows`` with ``mask``, the relation bits of ``a`` (a region, or with ``line`` a line) and
    region ``b``, in place of the two shapes; with ``flat`` they are ``packed_shapes`` already.
    Missing shapes give null, empty ones meet nothing. ``wanted``: the relation that rows must stand
    in to be kept. Arrow batches carry flat coordinates; pairs are worked on many at a time."""
    others = [c for c in rows.columns if c not in (a, b)]
    if not flat:
        rows = rows.withColumns({a: flat_shape(F.col(a), line), b: flat_shape(F.col(b))})
    shapes = [F.col(x) if flat else F.col(f"{x}.{part}") for x in (a, b) for part in (("edges", "starts")[: 1 if flat else 2])]
    schema = rows.select(*others, F.lit(None).cast("int").alias("mask")).schema
    rows = rows.select(*others, *[c.alias(f"_{k}") for k, c in enumerate(shapes)])

    def run(batches):
        for batch in batches:
            columns = batch.columns[len(others) :]
            given = np.asarray(pc.and_(columns[0].is_valid(), columns[-1].is_valid()))
            columns = columns if given.all() else [c.filter(pa.array(given)) for c in columns]
            mask, each = np.zeros(len(batch), np.int32), np.arange(int(given.sum()))
            pair = map(Shapes.unpacked, columns) if flat else (Shapes(*columns[:2]), Shapes(*columns[2:]))
            mask[given] = row_relations(*pair, each, each, line)
            found = pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(mask, mask=~given)], names=[*others, "mask"])
            yield found if wanted is None else found.filter(pa.array(given & wanted(mask)))

    return rows.mapInArrow(run, schema)


def _flat(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` numbers of all lists, and the bounds of each list in them."""
    bounds = np.asarray(col.offsets).astype(np.int64)
    return col.flatten().to_numpy().reshape(-1, width), (bounds - bounds[0]) // width


def _combined(left: np.ndarray, right: np.ndarray):
    """(pair, row of the left, row of the right): every row of a pair's left list with every one
    of its right list, some ``AT_ONCE`` at a time."""
    pair = np.repeat(np.arange(len(left) - 1), np.diff(left))
    size = np.diff(right)[pair]
    ends = np.cumsum(size)
    i = 0
    while i < len(pair):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
        n = size[i:j]
        yield np.repeat(pair[i:j], n), np.repeat(np.arange(i, j), n), np.repeat(right[pair[i:j]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        i = j


def _turns(ay, ax, by, bx, cy, cx) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the turns from a over b to c, and whether rounding could change them."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    return np.sign(left - right), ~(np.abs(left - right) > CERTAIN * (np.abs(left) + np.abs(right)))


def relations(a: pa.Array, b: pa.Array, a_starts: pa.Array, b_starts: pa.Array, line: bool) -> np.ndarray:
    """Relation bits of many pairs, given as lists of edge coordinates and of a point of each ring."""
    (x, of_x), (y, of_y) = _flat(a, 4), _flat(b, 4)
    pairs = len(of_x) - 1
    cross, unsure = np.zeros(pairs, bool), np.zeros(pairs, bool)
    for pair, i, j in _combined(of_x, of_y):
        e, f = x[i], y[j]
        near = np.ones(len(pair), bool)
        for k in (0, 1):
            near &= (np.maximum(f[:, k], f[:, k + 2]) >= np.minimum(e[:, k], e[:, k + 2])) & (np.minimum(f[:, k], f[:, k + 2]) <= np.maximum(e[:, k], e[:, k + 2]))
        pair, e, f = pair[near], e[near], f[near]
        turns = [_turns(*g[:, :4].T, *h[:, k : k + 2].T) for g, h in ((e, f), (f, e)) for k in (0, 2)]
        unsure[pair[np.logical_or.reduce([u for _, u in turns])]] = True
        (s, _), (t, _), (u, _), (v, _) = turns
        cross[pair[(s * t < 0) & (u * v < 0)]] = True
    mask = np.where(cross, INSIDES | MEET | FIRST_OUT | (0 if line else SECOND_OUT), 0).astype(np.int32)
    sides = [(a_starts, y, of_y, INSIDES | MEET | (0 if line else SECOND_OUT), FIRST_OUT)]
    if not line:
        sides.append((b_starts, x, of_x, INSIDES | MEET | FIRST_OUT, SECOND_OUT))
    for starts, edges, bounds, inside, out in sides:
        points, of = _flat(starts, 2)
        odd = np.zeros(len(points), np.int64)
        for _, i, j in _combined(of, bounds):
            p, e = points[i], edges[j]
            spans = (e[:, 0] > p[:, 0]) != (e[:, 2] > p[:, 0])
            turn, _ = _turns(*e.T, *p.T)
            np.add.at(odd, i[spans & ((turn > 0) == (e[:, 2] > e[:, 0]))], 1)
        pair = np.repeat(np.arange(pairs), np.diff(of))
        np.bitwise_or.at(mask, pair, np.where(cross[pair], 0, np.where(odd % 2 == 1, inside, out)).astype(np.int32))
    for k in np.flatnonzero(unsure):
        mask[k] = exact_relation(x[of_x[k] : of_x[k + 1]].ravel(), y[of_y[k] : of_y[k + 1]].ravel(), line)
    return mask


class Shapes:
    """Shapes of a column, as ``flat_shape`` or ``packed_shapes`` lay them out."""

    def __init__(self, edges: pa.Array, starts: pa.Array):
        flat, bounds = _flat(edges, 4)
        points, of = _flat(starts, 2)
        self.numbers, self.first, self.size, self.wide = flat.ravel(), bounds[:-1] * 4, np.diff(bounds), 4
        self.points, self.of = points.ravel(), of
        # one ring: each edge begins where the one before ended, the first one at the only point given
        after = np.arange(1, len(flat) + 1)
        some = self.size > 0
        after[bounds[1:][some] - 1] = bounds[:-1][some]
        gaps = np.append(0, np.cumsum((flat[:, 2:] != flat[after, :2]).any(axis=1)))
        self.ring = some & (np.diff(of) == 1) & (gaps[bounds[1:]] == gaps[bounds[:-1]])
        rows = np.flatnonzero(self.ring)
        self.ring[rows] = (points[of[rows]] == flat[bounds[rows], :2]).all(axis=1)

    @classmethod
    def unpacked(cls, packed: pa.Array) -> Shapes:
        """From ``packed_shapes``."""
        shapes = cls.__new__(cls)
        bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :][: len(packed) + 1].astype(np.int64) // 8
        data = packed.buffers()[2]
        shapes.numbers = np.frombuffer(data, np.float64, len(data) // 8) if data is not None else np.zeros(0)
        head = shapes.numbers[bounds[:-1]].astype(np.int64)
        shapes.ring, shapes.size, shapes.first, shapes.wide, shapes.end = head > 0, np.abs(head), bounds[:-1] + 1, 2, bounds[1:]
        return shapes

    def corners(self, rows: np.ndarray) -> np.ndarray:
        """[lat or lon, corner, row] of rings of one size, the first corner again at the end."""
        at = self.first[rows] + self.wide * np.append(np.arange(self.size[rows[0]]), 0)[:, None]
        return np.stack((self.numbers[at], self.numbers[at + 1]))

    def parts(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of a shape's edges and of a point of each ring."""
        n, at = self.size[row], self.first[row]
        if self.wide == 4:
            return self.numbers[at : at + 4 * n], self.points[2 * self.of[row] : 2 * self.of[row + 1]]
        if not self.ring[row]:
            return self.numbers[at : at + 4 * n], self.numbers[at + 4 * n : self.end[row]]
        ring = self.numbers[at : at + 2 * n].reshape(n, 2)
        return np.hstack((ring, np.roll(ring, -1, axis=0))).ravel(), ring[0]


def packed_shapes(edges: pa.Array, starts: pa.Array) -> pa.Array:
    """``flat_shape`` as bytes, so that pairs carry no more than they need: the number of edges and the
    corners of a single ring; else that number below zero, coordinates of all edges and of a point of each ring."""
    shapes = Shapes(edges, starts)
    width = np.where(shapes.ring, 2 * shapes.size, 4 * shapes.size + 2 * np.diff(shapes.of)) + 1
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0)
    out[ends - width] = np.where(shapes.ring, shapes.size, -shapes.size)
    for n in np.unique(shapes.size[shapes.ring]):
        rows = np.flatnonzero(shapes.ring & (shapes.size == n))
        at = (ends - width)[rows] + 1 + 2 * np.arange(n)[:, None]
        out[at], out[at + 1] = shapes.corners(rows)[:, :-1]
    for k in np.flatnonzero(~shapes.ring):
        out[ends[k] - width[k] + 1 : ends[k]] = np.concatenate(shapes.parts(k))
    offsets = np.append(0, ends * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def with_packed(rows: DataFrame, flat: str) -> DataFrame:
    """``rows`` with the bytes of ``packed_shapes`` in place of the ``flat_shape`` in column ``flat``."""
    others = [c for c in rows.columns if c != flat]
    schema = rows.select(*others, F.lit(None).cast("binary").alias(flat)).schema
    rows = rows.select(*others, f"{flat}.edges", f"{flat}.starts")

    def run(batches):
        for batch in batches:
            packed = packed_shapes(*(batch.column(len(others) + k) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], packed], names=[*others, flat])

    return rows.mapInArrow(run, schema)


def _lists(shapes: tuple) -> pa.Array:
    ends = np.cumsum([0, *map(len, shapes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(shapes)))


def row_relations(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, line: bool) -> np.ndarray:
    """Relation bits of rows ``i`` of ``a`` and ``j`` of ``b``. Pairs of single rings of the same two
    sizes are worked on together; corners that two edges share are looked at once."""
    mask = np.zeros(len(i), np.int32)
    n, m = a.size[i], b.size[j]
    quick = a.ring[i] & b.ring[j] & (n * m <= LANE) & (not line)
    rest = np.flatnonzero(~quick)
    if len(rest):
        (a_edges, a_starts), (b_edges, b_starts) = (zip(*(x.parts(r) for r in k[rest])) for x, k in ((a, i), (b, j)))
        mask[rest] = relations(_lists(a_edges), _lists(b_edges), _lists(a_starts), _lists(b_starts), line)
    quick = np.flatnonzero(quick)
    kind = n[quick] * (LANE + 1) + m[quick]
    order = np.argsort(kind, kind="stable")
    for rows in np.split(quick[order], np.flatnonzero(np.diff(kind[order])) + 1):
        step = max(1, LANE // int(n[rows[0]] * m[rows[0]])) if len(rows) else 1
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            mask[part] = _ring_relations(a, b, i[part], j[part])
    return mask


def _ring_relations(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    (py, px), (qy, qx) = p, q = a.corners(i), b.corners(j)

    def turns(e, f):
        """Of every edge of a ring and corner of the other: [edge, corner, pair]."""
        y, x, far_y, far_x = e[0, :-1, None], e[1, :-1, None], e[0, 1:, None], e[1, 1:, None]
        left, right = (far_x - x) * (f[0] - y), (far_y - y) * (f[1] - x)
        turn = left - right
        return turn, ~(np.abs(turn) > CERTAIN * (np.abs(left) + np.abs(right)))

    (s, s_unsure), (t, t_unsure) = turns(p, q), turns(q, p)
    near = None
    for e, f in ((py, qy), (px, qx)):
        lo, hi = np.minimum(e[:-1], e[1:])[:, None], np.maximum(e[:-1], e[1:])[:, None]
        both = (np.maximum(f[:-1], f[1:]) >= lo) & (np.minimum(f[:-1], f[1:]) <= hi)
        near = both if near is None else near & both
    unsure = (s_unsure[:, :-1] | s_unsure[:, 1:] | (t_unsure[:, :-1] | t_unsure[:, 1:]).swapaxes(0, 1)) & near
    s_up, t_up = s > 0, t > 0
    cross = (((s_up[:, :-1] != s_up[:, 1:]) & (t_up[:, :-1] != t_up[:, 1:]).swapaxes(0, 1)) & near & ~unsure).any(axis=(0, 1))
    mask = np.where(cross, INSIDES | MEET | FIRST_OUT | SECOND_OUT, 0).astype(np.int32)
    apart = np.flatnonzero(~cross)
    if len(apart):
        for own, edges, up, inside, out in ((py, qy, t_up, INSIDES | MEET | SECOND_OUT, FIRST_OUT), (qy, py, s_up, INSIDES | MEET | FIRST_OUT, SECOND_OUT)):
            y, ends = own[0, apart], edges[:, apart]
            above = ends > y
            odd = ((above[:-1] != above[1:]) & (up[:, 0, apart] == (ends[1:] > ends[:-1]))).sum(axis=0) % 2 == 1
            mask[apart] |= np.where(odd, inside, out).astype(np.int32)
        for k in apart[unsure[:, :, apart].any(axis=(0, 1))]:
            mask[k] = exact_relation(a.parts(i[k])[0], b.parts(j[k])[0])
    return mask


# The same in whole numbers: coordinates are binary fractions, so one power of two makes
# them whole.


def _whole(*shapes) -> list[list[tuple]]:
    ratios = [[float(v).as_integer_ratio() for v in s] for s in shapes]
    unit = max((d for s in ratios for _, d in s), default=1)
    flat = [[n * (unit // d) for n, d in s] for s in ratios]
    return [[((v[k], v[k + 1]), (v[k + 2], v[k + 3])) for k in range(0, len(v), 4)] for v in flat]


def _side(a, b, c) -> int:
    return (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])


def _odd(edges, y: int, x: int, unit: int, swap: bool) -> bool:
    """Whether a ray from (y, x) / unit eastward, with ``swap`` northward, meets an odd number
    of edges that do not hold the point."""
    count = 0
    for p, q in edges:
        (py, px), (qy, qx) = (p[::-1], q[::-1]) if swap else (p, q)
        if (py * unit > y) != (qy * unit > y):
            turn = (qx - px) * (y - py * unit) - (qy - py) * (x - px * unit)
            count += turn != 0 and (turn > 0) == (qy > py)
    return count % 2 == 1


def _pieces(edges, other):
    """(middle as (y, x, unit), edge, shared, met) of every piece of ``edges`` that ``other`` cuts;
    ``met`` says whether the whole edge has a point of ``other``."""
    boxes = [(f, g, min(f[0], g[0]), max(f[0], g[0]), min(f[1], g[1]), max(f[1], g[1])) for f, g in other]
    for p, q in edges:
        (py, px), (qy, qx) = p, q
        y0, y1, x0, x1 = min(py, qy), max(py, qy), min(px, qx), max(px, qx)
        cuts, shared, met = set(), [], False  # cuts inside the edge, as its share
        for f, g, v0, v1, h0, h1 in boxes:
            if v1 < y0 or v0 > y1 or h1 < x0 or h0 > x1:
                continue
            s, t = _side(p, q, f), _side(p, q, g)
            if s == 0 and t == 0:
                axis = 0 if py != qy else 1
                long = q[axis] - p[axis]
                ends = sorted((f[axis] - p[axis], g[axis] - p[axis]), reverse=long < 0)
                first, last = (abs(v) if v * long > 0 else 0 for v in ends)
                last = min(last, abs(long))
                met = True  # collinear, and the boxes meet
                if first < last:
                    shared.append((Fraction(first, abs(long)), Fraction(last, abs(long))))
                    cuts.update(c for c in shared[-1] if 0 < c < 1)
            elif not (s > 0 and t > 0 or s < 0 and t < 0):
                u, v = _side(f, g, p), _side(f, g, q)
                if not (u > 0 and v > 0 or u < 0 and v < 0):
                    met = True
                    if u and v:
                        cuts.add(Fraction(u, u - v))
        if not cuts:
            yield (py + qy, px + qx, 2), (p, q), bool(shared), met
            continue
        cuts = [Fraction(0), *sorted(cuts), Fraction(1)]
        for first, last in zip(cuts, cuts[1:]):
            at = (first + last) / 2
            unit, step = at.denominator, at.numerator
            yield (py * unit + step * (qy - py), px * unit + step * (qx - px), unit), (p, q), any(a <= at <= b for a, b in shared), met


def exact_relation(first, second, line: bool = False) -> int:
    """Relation bits of two shapes given as flat edge coordinates lat, lon, lat, lon."""
    a, b = _whole(first, second)
    mask, full = 0, INSIDES | MEET | FIRST_OUT | (0 if line else SECOND_OUT)
    for at, (p, q), shared, met in _pieces(a, b):
        if mask == full:
            return mask
        mask |= MEET if met else 0
        if shared:
            if not line:
                swap = p[0] == q[0]  # a level edge has its sides above and below
                where = (at[1], at[0], at[2]) if swap else at
                mask |= MEET | (INSIDES if _odd(a, *where, swap) == _odd(b, *where, swap) else FIRST_OUT | SECOND_OUT)
        elif _odd(b, *at, False):
            mask |= INSIDES | MEET | (0 if line else SECOND_OUT)
        else:
            mask |= FIRST_OUT
    if not line:
        for at, _, shared, _ in _pieces(b, a):
            if mask == full:
                return mask
            if not shared:
                mask |= INSIDES | MEET | FIRST_OUT if _odd(a, *at, False) else SECOND_OUT
    return mask
