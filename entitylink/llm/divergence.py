"""Audit of how sources of one language differ in their terms.

The matrix of counts by group (language and source) and term is cut into blocks of
terms. In each block a quadtree with two-by-two children (a K-squared tree: one bit
for each quadrant, children found by rank) holds the counts. All pairs of groups walk
it together: where both have an empty quadrant nothing is looked at, for all terms
under it cost the same and are priced by their number; the leaves where at least one
has a count are priced one by one. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entitylink.llm.text import NOT_LETTER, slices, text_column
from entitylink.llm.vocab import word_codes
from entitylink.session import materialize

# Bytes of text whose counts are folded together in a task.
PART = 8 << 20
# Terms in a block, about, and groups in a tile (a power of two).
BLOCK, TILE = 2048, 256
# Entries of a frontier walked at once; larger ones are split.
FRONT = 1 << 19
# Groups up to this many are broadcast (some 60 bytes each); beyond that the join shuffles.
BROADCAST_GROUPS = 200_000
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents
    that hold it. ``docs``: lang, source, text; nulls are empty."""

    def run(batches):
        for batch in batches:
            names = [batch.column(k).cast(pa.string()).dictionary_encode() for k in (0, 1)]
            lang, source = (n.indices.to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
            group = lang * len(names[1].dictionary) + source
            for i, j, data, offsets in slices(text_column(batch), PART):
                codes, words, first = word_codes(data, offsets, NOT_LETTER)
                if not len(codes):
                    continue
                row = np.repeat(np.arange(j - i), np.diff(first))
                once, n = np.unique(row * len(words) + codes, return_counts=True)
                row, code = np.divmod(once, len(words))
                cells, at = np.unique(group[i:j][row] * len(words) + code, return_inverse=True)
                total = np.zeros(len(cells), np.int64)
                np.add.at(total, at, n)
                of, code = np.divmod(cells, len(words))
                of = np.divmod(of, len(names[1].dictionary))
                columns = [names[k].dictionary.take(pa.array(of[k])) for k in (0, 1)]
                columns += [words.take(pa.array(code)), pa.array(total), pa.array(np.bincount(at, minlength=len(cells)))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    rows = docs.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "text")
    rows = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 1) / total), in decimals."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * ({n} + 1)) div {total}")


def distance(p: str, q: str) -> str:
    """floor((p - q)**2 / q) of shares, SQL."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As ``share``, three digits at a time: exact for totals up to 9e15."""
    out, left = np.divmod(n + 1, total)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        out = out * 1000 + digits
    return out + 1


class Quadtree:
    """K-squared tree of the cells (row, column) of a square matrix of side 2**levels.

    ``bits[l]`` has four bits for each node of level l, one for each quadrant (row half,
    column half); the set bits of a level, in order, are the nodes of the next, and those
    of the last level the cells in ``order``.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, levels: int):
        code = np.zeros(len(rows), np.int64)
        for b in range(levels):
            code |= ((columns >> b) & 1) << (2 * b) | ((rows >> b) & 1) << (2 * b + 1)
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        self.levels, self.child = levels, []
        for level in range(levels):
            below = np.unique(code >> 2 * (levels - level - 1))
            nodes, at = np.unique(below >> 2, return_inverse=True)
            bits = np.zeros((len(nodes), 4), bool)
            bits[at, below & 3] = True
            rank = np.cumsum(bits.ravel()) - 1
            # the last entry stands for an empty quadrant, whose quadrants are empty
            self.child.append(np.concatenate((np.where(bits.ravel(), rank, -1), np.full(4, -1))).reshape(-1, 4))


def joint_leaves(tree: Quadtree, needed):
    """Pairs of rows a < b with the leaves (cell number or -1) they have in a column, where
    at least one has a leaf: arrays a, b, cell of a, cell of b, in parts.

    ``needed(a, b, side)`` says which pairs of row blocks of ``side`` rows are wanted. Pairs of
    empty quadrants are left where they are found.
    """
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero, zero)]
    while stack:
        level, a, b, na, nb = stack.pop()
        if len(a) > FRONT:
            half = len(a) // 2
            stack += [(level, *(x[k] for x in (a, b, na, nb))) for k in (slice(half, None), slice(0, half))]
            continue
        if level == tree.levels:
            yield a, b, na, nb
            continue
        child, side, parts = tree.child[level], 1 << (tree.levels - level - 1), []
        for i in (0, 1):
            for j in (0, 1):
                wanted = needed(2 * a + i, 2 * b + j, side)
                x, y, nx, ny = (v[wanted] for v in (a, b, na, nb))
                for column in (0, 1):
                    cx, cy = child[nx, 2 * i + column], child[ny, 2 * j + column]
                    some = (cx >= 0) | (cy >= 0)
                    parts.append((2 * x[some] + i, 2 * y[some] + j, cx[some], cy[some]))
        stack.append((level + 1, *(np.concatenate(p) for p in zip(*parts))))


def tile_sums(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, totals: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each ordered pair of rows: the sum of distances over the columns where at least
    one has a count, and the number of these columns.

    ``totals``: N + V of each row. With ``split``, only pairs of a row below it and one from
    it on; it is a power of two.
    """
    size = len(totals)
    sums, seen = np.zeros((size, size), np.int64), np.zeros((size, size), np.int64)
    if not len(rows):
        return sums, seen
    levels = max(int(max(size, columns.max() + 1) - 1).bit_length(), 1)
    tree = Quadtree(rows, columns, levels)
    p = _shares(n, totals[rows])[tree.order]
    none = _shares(np.zeros(size, np.int64), totals)

    def needed(a, b, side):
        keep = (a <= b if side > 1 else a < b) & (b * side < size)
        if split is not None and side <= split:
            keep &= (a * side < split) & (b * side >= split)
        return keep

    for a, b, na, nb in joint_leaves(tree, needed):
        x, y = np.where(na >= 0, p[na], none[a]), np.where(nb >= 0, p[nb], none[b])
        square = (x - y) * (x - y)
        np.add.at(sums, (a, b), square // y)
        np.add.at(sums, (b, a), square // x)
        np.add.at(seen, (a, b), 1)
    return sums, seen + seen.T


def _tile(key: tuple, rows: pa.Table, tile: int) -> pa.Table:
    """Sums of the pairs of one pair of tiles in one block of terms. Rows without a term name
    the groups of the tiles."""
    ta, tb = key[2].as_py(), key[3].as_py()
    head = rows.filter(pc.is_null(rows["term"])).sort_by("g")
    cells = rows.filter(pc.is_valid(rows["term"]))
    own = head["g"].to_numpy()
    # the second tile starts at ``tile``, so that no quadrant holds rows of both
    place = own - ta * tile if ta == tb else np.where(own // tile == ta, own - ta * tile, own - tb * tile + tile)
    totals = np.ones(place[-1] + 1, np.int64)
    totals[place] = head["total"].to_numpy()
    at = place[np.searchsorted(own, cells["g"].to_numpy())]
    # columns by the number of their cells, so that full ones lie together and empty quadrants are large
    term = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    often = np.bincount(term) if len(term) else term
    column = np.empty(len(often), np.int64)
    column[np.argsort(-often, kind="stable")] = np.arange(len(often))
    sums, seen = tile_sums(at, column[term] if len(term) else term, cells["n"].to_numpy(), totals, None if ta == tb else tile)
    # ordered pairs: all of one tile, or across the two
    i, j = np.meshgrid(np.arange(len(own)), np.arange(len(own)), indexing="ij")
    wanted = (i != j) if ta == tb else (own[i] // tile != own[j] // tile)
    i, j = i[wanted], j[wanted]
    names = head["source"].combine_chunks()
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(i), pa.string()),
            "source": names.take(pa.array(i)),
            "item": names.take(pa.array(j)),
            "total": totals[place[i]],
            "other": totals[place[j]],
            "value": sums[place[i], place[j]],
            "seen": seen[place[i], place[j]],
        }
    )


class Counted:
    """Kept terms of every language and the totals of every group, written.

    ``cells``: lang, source, term, n and n_lang of every kept term that occurs there.
    ``groups``: lang, source, g (0, 1, ... by source in each lang), total (N + V), of_lang
    (the same of the lang) and terms (V) of every (lang, source) that stands in ``docs``.
    """

    def __init__(self, docs: DataFrame, min_docs: int):
        of_term = Window.partitionBy("lang", "term")
        every = term_counts(docs).withColumns({"df": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "lead": F.min("source").over(of_term)})
        every = every.where(F.col("df") >= min_docs)
        self.cells = materialize(every.select("lang", "source", "term", "n", "n_lang", (F.col("lead") == F.col("source")).cast("long").alias("lead")), "cells")
        totals = materialize(self.cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("lead")), "totals")
        langs = totals.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("lead").alias("terms"))
        groups = docs.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source").distinct()
        groups = groups.join(totals.select("lang", "source", "n"), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
        g = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        total, of_lang = (F.col("n") + F.col("terms")), (F.col("n_lang") + F.col("terms"))
        self.groups = materialize(groups.select("lang", "source", g.alias("g"), total.alias("total"), of_lang.alias("of_lang"), "terms"), "groups")

    def placed(self) -> DataFrame:
        """``cells`` with the columns of their group."""
        small = self.groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        return self.cells.join(F.broadcast(self.groups) if small else self.groups, ["lang", "source"])


def _term_part(counted: Counted, ranks: int) -> DataFrame:
    rows = counted.placed().select("lang", "source", "term", share("n", "total").alias("p"), share("n_lang", "of_lang").alias("q"))
    rows = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= ranks)


def _pair_part(counted: Counted, block: int, tile: int) -> DataFrame:
    blocks = F.greatest(F.ceil(F.col("terms") / block), F.lit(1)).cast("int")
    tiles = F.max(F.expr(f"g div {tile}")).over(Window.partitionBy("lang")).cast("int")
    groups = materialize(counted.groups.withColumns({"blocks": blocks, "tiles": tiles}), "tiles")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    shape = ["lang", "block", "ta", "tb", "source", "g", "total", "term", "n"]

    def tiled(rows: DataFrame) -> DataFrame:
        own = F.expr(f"cast(g div {tile} as int)")
        rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("tiles"))))
        return rows.select(*[c for c in rows.columns if c != "_t"], F.least(own, "_t").alias("ta"), F.greatest(own, "_t").alias("tb"))

    cells = counted.cells.select("lang", "source", "term", "n").join(F.broadcast(groups) if small else groups, ["lang", "source"])
    cells = tiled(cells.withColumn("block", F.expr("cast(pmod(xxhash64(term), blocks) as int)"))).withColumn("source", F.lit(None).cast("string"))
    heads = tiled(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(None).cast("long")})
    rows = cells.select(shape).unionByName(heads.select(shape))
    sums = rows.groupBy("lang", "block", "ta", "tb").applyInArrow(lambda key, rows: _tile(key, rows, tile), "lang string, source string, item string, total long, other long, value long, seen long")
    pairs = sums.groupBy("lang", "source", "item", "total", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    pairs = pairs.join(groups.groupBy("lang").agg(F.first("terms").alias("terms")), "lang")
    pairs = pairs.where("source != item").withColumns({"p": share("0", "greatest(total, 1)"), "q": share("0", "greatest(other, 1)")})
    # what was empty on both sides: one price, times the number of terms
    value = F.col("value") + (F.col("terms") - F.col("seen")) * F.expr(distance("p", "q"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audited(docs: DataFrame, min_docs: int = 3, ranks: int = 200, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (lang, source, text).

    A term is a run of letters (A-Z as a-z; bytes of other scripts count as letters); a lang
    keeps those in at least ``min_docs`` of its documents. A group's share of a kept term is
    1 + floor(10**9 * (count + 1) / (N + V)), its distance from another floor((p - q)**2 / q).
    Part ``pair``: the distance of each source from each other source of its lang over all kept
    terms. Part ``term``: the terms that a source has more of than its lang, the ``ranks``
    farthest. Values fit 64 bits; ties go to the smaller item by its UTF-8.

    Null lang, source and text are empty strings; repeated rows are documents each; very long
    texts are worked on alone. A group without terms has its pairs; an empty table gives no
    rows. Other columns are ignored. No step holds more than one block of about ``block`` terms
    by two tiles of ``tile`` groups (a power of two).
    """
    counted = Counted(docs, min_docs)
    pairs = _pair_part(counted, block, tile)
    return pairs.unionByName(_term_part(counted, ranks)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
