"""Near-duplicate groups by min-max hashing.

Every permutation of the shingle hashes yields two signature values, the smallest
and the largest, so a signature of 128 values takes 64 hash evaluations. A band is
both values of two permutations. Long texts of similarity 0.75 share one of 32 bands
but for about 5 in a million, and more surely above that; of texts that share 6 of 8
shingles 20 in a million share none, of those that share 3 of 4 100 in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entitylink.llm.graph import components
from entitylink.llm.text import mix, row_shingles, text_column
from entitylink.session import materialize

BANDS = 32
PER_BAND = 2
# Ids up to this many are broadcast (40 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 1_000_000
# Shingles whose sets are compared inside one task (8 bytes each).
TILE = 1 << 19
# What makes two texts one class: two sums over the distinct shingle hashes, and their number.
CONTENT = ["h1", "h2", "n_shingles"]

_U = np.uint64
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**63, BANDS * PER_BAND, dtype=np.uint64) * _U(2)
_MULTIPLY = _rng.integers(0, 2**63, BANDS * PER_BAND, dtype=np.uint64) * _U(2) + _U(1)

SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    rows = [np.unique(values[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
    return np.concatenate(rows) if rows else values, np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def _content(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h1 and h2 of each row of distinct values; 0 for an empty one."""
    full = np.flatnonzero(np.diff(bounds))
    h1, h2 = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    if len(full):
        h1[full] = np.add.reduceat(values, bounds[full])
        h2[full] = np.add.reduceat(mix(values + _U(1)), bounds[full])
    return h1, h2


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of band keys for each (non-empty) run of shingle hashes."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * PER_BAND, (band + 1) * PER_BAND):
            permuted = (values ^ _XOR[k]) * _MULTIPLY[k]
            key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(permuted, starts))
            key = mix(key * _U(0x9E3779B97F4A7C15) + np.maximum.reduceat(permuted, starts))
        keys[:, band] = key
    return keys


def _sign(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        ids = batch.column(0)
        for i, values, bounds in row_shingles(text_column(batch)):
            values, bounds = _distinct(values, bounds)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            h1, h2 = _content(values, bounds)
            keys = band_keys(values, bounds[full]) if len(full) else np.zeros((0, BANDS), np.uint64)
            at = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))
            columns = [ids.slice(i, len(n)), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _sets(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        ids = batch.column(0)
        for i, values, bounds in row_shingles(text_column(batch)):
            values, bounds = _distinct(values, bounds)
            h1, h2 = _content(values, bounds)
            rows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            columns = [ids.slice(i, len(rows)), pa.array(np.diff(bounds)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), rows]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, shingles): the full set of each class in ``ids`` (node, doc_id, h1, h2,
    n_shingles), one row each however often its text stands in ``docs``, written.

    ``ids`` is broadcast only if it has at most ``BROADCAST_IDS`` rows, else joined.
    """
    hint = F.broadcast if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else lambda ids: ids
    wanted = docs.join(hint(ids.select("doc_id")), "doc_id", "left_semi")
    sets = wanted.mapInArrow(_sets, "doc_id long, n_shingles long, h1 long, h2 long, shingles array<long>")
    sets = sets.dropDuplicates(["doc_id", *CONTENT])
    return materialize(sets.join(hint(ids), ["doc_id", *CONTENT]).select("node", "shingles"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    o = F.size(F.array_intersect("sa", "sb"))
    linked = 100 * o >= percent * (F.size("sa") + F.size("sb") - o)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def _placed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component) of the rows of buckets that hold several components."""
    placed = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed.select("key", "node", "component"), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return materialize(placed.join(materialize(split.select("key"), "split"), "key", "left_semi"), "open")


def linked_forest(component: np.ndarray, n: np.ndarray, shingles: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of these sets as all their links would: a spanning
    forest, so fewer than there are sets.

    ``shingles`` holds the sets one after the other, ``n`` their sizes. With ``side``, only
    sets of different sides are compared. Shingles are ordered by how many sets hold them;
    linked sets share at least ``least`` of them, so the first one they share has ranks of at
    most n - least in either. Sets that are already joined are not compared.
    """
    bounds = np.concatenate(([0], np.cumsum(n)))
    _, ids, df = np.unique(shingles, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((ids, df[ids], owner))
    ids, rank = ids[order], np.arange(len(ids)) - bounds[owner]
    near = np.flatnonzero((rank <= (n - (percent * n + 99) // 100)[owner]) & (df[ids] > 1))
    # of each shingle, the sets that hold it near their front, in order
    near = near[np.argsort(ids[near], kind="stable")]
    holder, place = owner[near], rank[near]
    start = np.searchsorted(ids[near], ids[near])
    by_set = np.argsort(holder, kind="stable")
    entries = np.searchsorted(holder[by_set], np.arange(len(n) + 1))
    root = np.unique(component, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    held = np.zeros(len(df), bool)

    def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        size = last - first
        return np.repeat(last - np.cumsum(size), size) + np.arange(int(size.sum()))

    for b in range(len(n)):
        own = by_set[entries[b] : entries[b + 1]]
        hits = spans(start[own], own)
        if not len(hits):
            continue
        other = holder[hits]
        least = (percent * (n[other] + n[b]) + 99 + percent) // (100 + percent)
        fits = (place[hits] <= n[other] - least) & (np.repeat(place[own], own - start[own]) <= n[b] - least) & (root[other] != root[b])
        if side is not None:
            fits &= side[other] != side[b]
        other = np.unique(other[fits])
        if not len(other):
            continue
        mine = ids[bounds[b] : bounds[b + 1]]
        held[mine] = True
        step = 16
        while len(other):
            now, other, step = other[:step], other[step:], 2 * step
            shared = np.add.reduceat(held[ids[spans(bounds[now], bounds[now + 1])]], np.cumsum(n[now]) - n[now], dtype=np.int64)
            for a in now[100 * shared >= percent * (n[now] + n[b] - shared)]:
                if root[a] != root[b]:
                    links.append((int(a), b))
                    root[root == root[a]] = root[b]
            other = other[root[other] != root[b]]
        held[mine] = False
    return links


def _tile_links(rows: pa.Table, percent: int) -> pa.Table:
    rows = rows.combine_chunks()
    node, sets = rows["node"].to_numpy(), rows["shingles"].combine_chunks()
    n = np.diff(np.asarray(sets.offsets)).astype(np.int64)
    own = rows["own"].to_numpy()
    side = own if rows["ta"][0].as_py() != rows["tb"][0].as_py() else None
    links = linked_forest(rows["component"].to_numpy(), n, sets.flatten().to_numpy().view(np.uint64), percent, side)
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": node[at[:, 0]], "b": node[at[:, 1]]})


def _families(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, family) of those ``rows`` (node, component, n) that may be linked to one of another
    component: classes that share a shingle near their front are of one family.

    Shingles are ordered by how many of these classes hold them. Linked sets share at least
    ``percent`` * n of them, so the first one they share is among the n - percent * n + 1
    rarest of either. A shingle hangs its classes on the smallest one: no pair is made.
    """
    each = rows.join(sets, "node").select("node", "component", "n", F.explode("shingles").alias("s"))
    spread = materialize(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "spread")
    counted = each.join(spread, "s", "left")
    order = Window.partitionBy("node").orderBy("df", "s")  # those of one class alone (null) come first
    counted = counted.withColumn("rank", F.row_number().over(order))
    need = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    near = materialize(counted.where((F.col("rank") <= need) & F.col("df").isNotNull()).select("node", "component", "s"), "rare")
    lead = near.groupBy("s").agg(F.min("node").alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    lead = materialize(lead.where("lo < hi").select("s", "lead"), "lead")
    hooks = materialize(near.join(lead, "s").where("node != lead").select("lead", "node").distinct(), "hooks")
    return components(hooks, "lead", "node", "families").select("node", F.col("component").alias("family"))


def _open_links(rows: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links (a, b) between different components among ``rows`` (node, component, n), as many
    as it takes to join all that are linked, and fewer than there are rows in the tiles.

    Families of up to ``tile`` shingles are dealt to tasks by hash, many together. A larger
    one is cut into parts of about ``tile`` shingles; each pair of parts is a task.
    """
    families = materialize(rows.join(_families(rows, sets, percent), "node"), "family-rows")
    sizes = materialize(families.groupBy("family").agg(F.sum("n").alias("size")), "family-sizes")
    total = sizes.where(F.col("size") <= tile).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("size") / tile).cast("int")
    keyed = families.join(sizes, "family").withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")})
    bin_ = F.when(F.col("parts") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(2 * total // tile + 1)))
    keyed = keyed.select(bin_.alias("bin"), "own", "node", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("t"))
    keyed = keyed.select("bin", F.least("own", "t").alias("ta"), F.greatest("own", "t").alias("tb"), "own", "node", "component")
    tiles = keyed.join(sets, "node").groupBy("bin", "ta", "tb")
    return tiles.applyInArrow(lambda rows: _tile_links(rows, percent), "a long, b long")


def near_groups(docs: DataFrame, percent: int = 75, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their 5-word
    shingle sets; ``component_id`` is the smallest doc_id reachable.

    Equal sets fold into one class first, so copies cost a row each and no pair, be
    they rows of one doc_id or of many. A class has a number of its own: a doc_id that
    stands with several texts is in several classes. In
    every band bucket all classes are compared on full sets with the one that has most
    companions over all its buckets. Classes of buckets that then still hold several
    components fall into families by their rarest shingles; inside families the sets are
    compared in tiles of about ``tile`` shingles, and a tile hands on a spanning forest of
    its links. No bucket is capped and no step lists the pairs of a group.

    Null or blank text has an empty set and is linked with nothing. A row without
    doc_id is linked with nothing: component_id null, kept. Repeated rows are equal
    copies, each returned. Other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_sign, SIGNED), "signed")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*CONTENT).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = classes.select("node", F.explode("bands").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    buckets = materialize(rows.join(shared, "key"), "buckets")
    weight = materialize(buckets.groupBy("node").agg(F.sum("members").alias("weight")), "weight")
    lead = F.max(F.struct("weight", F.negative("node").alias("node")))
    leaders = buckets.join(weight, "node").groupBy("key").agg(lead.alias("lead"))
    leaders = materialize(leaders.select("key", F.negative("lead.node").alias("leader")), "leaders")
    buckets = buckets.select("key", "node")
    pairs = buckets.join(leaders, "key").where("node != leader")
    pairs = pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(docs, materialize(classes.drop("bands").join(nodes, "node", "left_semi"), "ids"))
    links = materialize(confirmed(pairs, sets, percent), "links")
    found = components(links)

    open_ = _placed(buckets, found).select("node", "component").distinct()
    open_ = materialize(open_.join(classes.select("node", F.col("n_shingles").alias("n")), "node"), "rest")
    if not open_.isEmpty():
        extra = materialize(_open_links(open_, sets, percent, tile), "extra")
        found = components(links.unionByName(extra))

    of_class = classes.drop("bands").join(found, "node", "left")
    of_class = materialize(of_class.select(*CONTENT, "doc_id", F.coalesce("component", "node").alias("root")), "placed-classes")
    least = materialize(of_class.groupBy("root").agg(F.min("doc_id").alias("component")), "least")
    of_class = materialize(of_class.join(least, "root").select(*CONTENT, "component"), "of-class")
    out = signed.drop("bands").join(of_class, CONTENT, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the smallest doc_id, all
    columns kept.

    Of rows that repeat a doc_id one stays; rows without doc_id all stay.
    """
    groups = near_groups(docs, percent).where("doc_id is not null").groupBy("doc_id")
    groups = materialize(groups.agg(F.max("kept").alias("kept"), (F.count("*") > 1).alias("repeated")), "groups")
    gone = groups.where("not kept or repeated").select("doc_id")
    again = groups.where("kept and repeated").select("doc_id")
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hint = F.broadcast if small else lambda ids: ids
    out = docs.join(hint(gone), "doc_id", "left_anti").select(docs.columns)
    if not again.isEmpty():
        out = out.unionByName(docs.join(hint(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
    return out
