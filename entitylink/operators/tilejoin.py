"""Similarity joins in tiles: pairs are found, counted and scored where they meet.

Each side is cut into parts by size, so a tile is one part against another and only parts
whose sizes can qualify meet. Values travel once per tile as sorted numbers of their
elements; no list of pairs is shuffled, grouped or joined with its values again. Inside a
tile the prefix filter holds: with one global order of elements (fewest possible pairs
first), a pair that shares ``alpha`` elements shares some among the first
``n - alpha + k`` of both, and what the shorter prefix leaves bounds the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from entitylink.operators.prefix import IDS, element_stats, numbered_elements
from entitylink.operators.skew import attach
from entitylink.session import materialize

# Elements of one side of a tile: bounds a task's memory (some 30 bytes for each).
TILE = 1 << 25
# Smaller inputs are cut too, into parts of at least so many elements and at most SPREAD parts.
PART, SPREAD = 1 << 14, 8
# What a value costs besides its elements.
ROW = 64
# One shared element more is asked for in the prefixes per so many needed in all.
EXTRA = 16
# Pairs scored and handed on at once.
BATCH = 1 << 16
# Steps to look at one element of a candidate's array, against one step for a row of an index.
LOOK = 8


@dataclass(frozen=True)
class Test:
    """What makes two values a link.

    ``alpha(a, b, lead)``: least overlap of values of sizes a and b (arrays); ``sim(o, a, b)``
    scores an overlap, or ``score(x, y, theta)`` two lists of texts
    (any value below theta where theirs is). ``pairs(x, y, theta)`` holds the texts of both sides of a
    tile: where it ``fits``, called with rows of x and of y, it scores as ``score`` does.
    ``leads(texts, side)``: rows of codes whose common beginning is ``lead``, which never raises ``alpha``; ``most`` its largest.
    """

    theta: float
    alpha: Callable
    sim: Callable | None = None
    score: Callable | None = None
    pairs: Callable | None = None
    leads: Callable | None = None
    most: int = 0

    def least(self, a, b, lead=None):
        return np.maximum(self.alpha(a, b, self.most if lead is None else lead), 1)


def up(x):
    """ceil with slack for rounding: never larger than the true ceiling."""
    return np.ceil(x - 1e-9).astype(np.int64)


def numbered_values(values: DataFrame, by: str = "pairs", limit: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Per value its shareable elements as sorted numbers of the global order, written out.

    ``values`` are written and carry ``row``, a number of their own, and ``elems``. Columns:
    theirs without those, n (all elements), arr, kept (leading elements that may find
    partners). ``by='entities'`` orders by block size and then ``limit`` (one row: optimal)
    turns larger blocks off.
    """
    shared = numbered_elements(materialize(element_stats(values), "elements") if stats is None else stats, by)
    rows = attach(values.select("row", F.explode("elems").alias("elem")), shared.select("elem", "no", "df"), "elem", "df", ["row"])
    arrays = rows.select("row", F.col("no").cast("int").alias("no")).repartition("row").groupBy("row").agg(F.array_sort(F.collect_list("no")).alias("arr"))
    kept = F.size("arr")
    if limit is not None:
        # by block size: what the limit turns off comes last, but for blocks of one entity, which nothing shares
        off = shared.where(F.col("entities") > limit.scalar()).agg(F.min("no").cast("int")).scalar()
        arrays = arrays.withColumn("_off", off)
        kept = F.size(F.filter("arr", lambda e: F.col("_off").isNull() | (e < F.col("_off"))))
    arrays = arrays.select("row", "arr", kept.alias("kept"))
    rest = values.withColumn("n", F.size("elems")).drop("elems")
    return materialize(rest.join(arrays, "row").drop("row").where(F.col("kept") > 0), "numbered-values")


def _in_parts(rows: DataFrame, side: str) -> tuple[DataFrame, list]:
    """One side's rows with their part, by size and then at random; (part, lo, hi) of all parts.

    Distinct sizes number at most sqrt(2 * elements), which bounds the window and the broadcast.
    """
    rows = rows.where(F.col(side).isNotNull()).withColumn("_w", F.size("arr") + ROW)
    w = Window.orderBy("n")
    sizes = rows.groupBy("n").agg(F.sum("_w").cast("double").alias("own"))
    upto, total = F.sum("own").over(w), F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = F.greatest(F.ceil(total / TILE), F.least(F.ceil(F.sqrt(total / PART)), F.lit(SPREAD)))
    sizes = materialize(sizes.select("n", (upto - F.col("own")).alias("before"), "own", total.alias("total"), parts.alias("parts")), "part-sizes")
    at = F.col("before") + F.col("own") * F.pmod(F.xxhash64(side), F.lit(1 << 20)) / (1 << 20)
    part = F.least(F.floor(at * F.col("parts") / F.col("total")), F.col("parts") - 1).cast("int")
    rows = rows.join(F.broadcast(sizes), "n").withColumn("part", part).drop("_w", "before", "own", "total", "parts")
    return rows, rows.groupBy("part").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()


def _can_meet(test: Test, x, y) -> bool:
    """Sizes of two parts that can qualify: the nearest two are the best."""
    small, large = sorted((x, y), key=lambda p: p.hi)
    b = max(small.hi, large.lo)
    a = min(small.hi, b)
    return bool(a >= test.least(np.array([a]), np.array([b]))[0]) or large.lo <= small.hi


def tile_links(numbered: DataFrame, test: Test, text: str | None = None) -> DataFrame:
    """Value links (source, target, sim, n_source, n_target) of ``numbered_values``.

    ``text``: the column that ``test`` scores.
    """
    left, ls = _in_parts(numbered, "source")
    right, rs = _in_parts(numbered, "target")
    width = max([r.part for r in rs], default=0) + 1
    met = [(x.part, y.part) for x in ls for y in rs if _can_meet(test, x, y)]

    def dealt(rows: DataFrame, side: str, other: str, at: int) -> DataFrame:
        tiles = {}
        for pair in met:
            tiles.setdefault(pair[at], []).append(pair[0] * width + pair[1])
        most = max(tiles, default=-1) + 1
        lists = F.array(*[F.array(*[F.lit(t) for t in tiles.get(p, [])]).cast("array<int>") for p in range(most)]).cast("array<array<int>>")
        value = F.col(text) if text else F.lit(None).cast("string")
        own = F.lit(None).cast(numbered.schema[other].dataType).alias(other)
        ids = [side, own] if side == "source" else [own, side]
        return rows.select(F.explode(F.get(lists, F.col("part"))).alias("tile"), *ids, F.col(f"n_{side}").alias("copies"), "n", "kept", "arr", value.alias("text"))

    both = dealt(left, "source", "target", 0).unionByName(dealt(right, "target", "source", 1))
    ids = [StructField(c, numbered.schema[c].dataType) for c in IDS]
    counts = [StructField(f"n_{c}", numbered.schema[f"n_{c}"].dataType) for c in IDS]
    names = [*IDS, "sim", "n_source", "n_target"]
    schema = StructType([*ids, StructField("sim", DoubleType()), *counts])

    def of_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        one = rows["source"].is_valid().to_numpy()
        if one.all() or not one.any():
            return
        s, t = (_Part(rows, np.flatnonzero(m), test, k) for k, m in enumerate((one, ~one)))
        ids, copies = [rows[c].combine_chunks() for c in IDS], rows["copies"].combine_chunks()
        held = test.pairs(s.texts.to_pylist(), t.texts.to_pylist(), test.theta) if test.pairs else None
        for i, j, o in _batches(s.meets(t, test)):
            if held and held.fits:
                sim = held(i, j)
            elif test.score:
                sim = test.score(s.texts.take(pa.array(i)).to_pylist(), t.texts.take(pa.array(j)).to_pylist(), test.theta)
            else:
                sim = test.sim(o.astype(np.float64), s.n[i], t.n[j])
            good = np.flatnonzero(sim >= test.theta)
            i, j = s.order[i[good]], t.order[j[good]]
            i, j = pa.array(i), pa.array(j)
            found = [ids[0].take(i), ids[1].take(j), pa.array(sim[good], pa.float64()), copies.take(i), copies.take(j)]
            yield pa.RecordBatch.from_arrays(found, names=names)

    # a number of partitions that is given is kept: small tiles may hold much work
    return both.repartition(max(len(met), 1), "tile").groupBy("tile").applyInArrow(of_tile, schema)


def _batches(found):
    held, size = [], 0
    for i, j, o in found:
        held.append((np.full(len(j), i), j, o))
        size += len(j)
        if size >= BATCH:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _index(elems: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by element, and where each element's begin."""
    starts = np.zeros(width + 1, dtype=np.int64)
    np.cumsum(np.bincount(elems, minlength=width), out=starts[1:])
    return starts, rows[np.argsort(elems, kind="stable")]


class _Part:
    """One side of a tile, by size: the rows' arrays stay where they came."""

    def __init__(self, rows: pa.Table, own: np.ndarray, test: Test, side: int):
        n = rows["n"].to_numpy()[own]
        self.order = own[np.argsort(n, kind="stable")]
        self.n = np.sort(n).astype(np.int64)
        arr = rows["arr"].combine_chunks()
        offsets = arr.offsets.to_numpy().astype(np.int64)
        self.flat = arr.values.to_numpy(zero_copy_only=False)
        self.start, self.size = offsets[self.order], offsets[self.order + 1] - offsets[self.order]
        self.kept = rows["kept"].to_numpy()[self.order].astype(np.int64)
        self.texts = rows["text"].combine_chunks().take(pa.array(self.order)) if test.score else None
        self.leads = test.leads(self.texts.to_pylist(), side) if test.leads else None

    def elements(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All elements of rows ``at``, the place of each in its row, and where rows begin."""
        size = self.size[at]
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        return self.flat[np.repeat(self.start[at], size) + place], place, begin

    def cut(self, other: _Part, test: Test) -> None:
        """Partners by size (lo, hi), prefix lengths and the last number of each prefix."""
        sizes, first = np.unique(other.n, return_index=True)
        after = np.append(first[1:], len(other.n))
        self.lo, self.hi, need = (np.zeros(len(self.n), dtype=np.int64) for _ in range(3))
        own, begin = np.unique(self.n, return_index=True)
        for n, b, e in zip(own, begin, np.append(begin[1:], len(self.n))):
            least = test.least(n, sizes)
            fits = np.flatnonzero(np.minimum(n, sizes) >= least)
            if len(fits):
                self.lo[b:e], self.hi[b:e], need[b:e] = first[fits[0]], after[fits[-1]], least[fits].min()
        self.prefix = np.clip(self.size - need + np.maximum(need // EXTRA, 1), 0, self.kept) * (self.hi > 0) * (self.size >= need)
        self.rest = self.size - self.prefix
        self.last = np.where(self.prefix > 0, self.flat[self.start + np.maximum(self.prefix, 1) - 1], -1)

    def meets(self, other: _Part, test: Test):
        """(row, rows of ``other``, overlaps) of pairs that share ``alpha`` elements."""
        self.cut(other, test)
        other.cut(self, test)
        elems, place, _ = other.elements(np.arange(len(other.n)))
        rows = np.repeat(np.arange(len(other.n), dtype=np.int32), other.size)
        width = int(max(self.flat.max(), other.flat.max())) + 1
        front = place < np.repeat(other.prefix, other.size)
        at, post = _index(elems[front], rows[front], width)
        at_rest, post_rest = _index(elems[~front], rows[~front], width)
        del elems, place, rows, front
        mark = np.zeros(width, dtype=np.uint8)

        def count(index, starts, elements):
            held = [index[b:e] for b, e in zip(starts[elements], starts[elements + 1]) if e > b]
            return np.bincount(np.concatenate(held), minlength=len(other.n)) if held else np.zeros(len(other.n), dtype=np.int64)

        for i in np.flatnonzero(self.prefix):
            own = self.flat[self.start[i] : self.start[i] + self.size[i]].astype(np.int64)
            head, tail, lo = own[: self.prefix[i]], own[self.prefix[i] :], self.lo[i]
            shared = count(post, at, head)
            j = np.flatnonzero(shared[lo : self.hi[i]]) + lo
            # whichever prefix ends first, all that is shared up to there is counted
            more = np.where(other.last[j] < self.last[i], other.rest[j], self.rest[i])
            least = test.least(self.n[i], other.n[j])
            near = shared[j] + more >= least
            j, least = j[near], least[near]
            if test.leads:
                lead = np.cumprod(other.leads[j] == self.leads[i], axis=1).sum(axis=1)
                least = test.least(self.n[i], other.n[j], lead)
                near = shared[j] + np.where(other.last[j] < self.last[i], other.rest[j], self.rest[i]) >= least
                j, least = j[near], least[near]
            if not len(j):
                continue
            steps = (at_rest[own + 1] - at_rest[own]).sum() + (at[tail + 1] - at[tail]).sum() + len(other.n)
            if LOOK * other.size[j].sum() < steps:
                mark[own] = 1
                found, _, begin = other.elements(j)
                o = np.add.reduceat(mark[found], begin, dtype=np.int64)
                mark[own] = 0
            else:
                o = (shared + count(post_rest, at_rest, own) + count(post, at, tail))[j]
            good = o >= least
            if good.any():
                yield i, j[good], o[good]
