"""Exact top-k by inner product: one ball tree per shard, searched branch and bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entitylink.session import materialize

LEAF = 96
# Rows of a full shard and queries of a full group: what a task holds.
SHARD_ROWS = 65_536
QUERY_GROUP = 65_536
LEAST_ROWS = 2_048
EXACT = 2.0**53
_LAST = 2**63 - 1
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Integer vectors (rows of ``vectors``, float64) in balls split at the median of
    the widest axis."""

    def __init__(self, vec_ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = vec_ids, vectors
        self.largest = float(np.abs(vectors).max(initial=0.0))
        self.nodes: list[tuple] = []  # rows, centre, radius, children
        self._build(np.arange(len(vec_ids)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.vectors[rows]
        centre = own.mean(axis=0)
        radius = math.sqrt(((own - centre) ** 2).sum(axis=1).max())
        at = len(self.nodes)
        self.nodes.append((rows, centre, radius, None))
        if len(rows) > LEAF:
            spread = own.max(axis=0) - own.min(axis=0)
            order = np.argsort(own[:, int(np.argmax(spread))], kind="stable")
            half = len(rows) // 2
            children = self._build(rows[order[:half]]), self._build(rows[order[half:]])
            self.nodes[at] = (rows, centre, radius, children)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """Best (scores, ids) of each query, ids -1 where there are fewer than ``k``.

        ``floor``: a score the query's k-th best is known to reach, or -inf.
        """
        n = len(query_ids)
        exact = self.largest * float(np.abs(queries).max(initial=0.0)) * queries.shape[1] < EXACT
        norms = np.sqrt((queries**2).sum(axis=1))
        best = np.full((n, k), -math.inf, float if exact else object)  # whole numbers of any size
        ids = np.full((n, k), -1, np.int64)
        kth = floor.astype(float).copy()

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            _, centre, radius, _ = self.nodes[node]
            if not exact:
                return np.full(len(rows), math.inf)
            reach = queries[rows] @ centre + norms[rows] * radius
            return reach + 1.0 + 1e-9 * np.abs(reach)  # above any rounding

        def scores(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
            if exact:
                return queries[rows] @ self.vectors[members].T
            whole = np.frompyfunc(int, 1, 1)
            return whole(queries[rows]) @ whole(self.vectors[members]).T

        def visit(node: int, rows: np.ndarray, reach: np.ndarray) -> None:
            live = (reach >= kth[rows]) | (not exact)
            rows = rows[live]
            if not len(rows):
                return
            members, _, _, children = self.nodes[node]
            if children is None:
                found = scores(rows, members)
                own = query_ids[rows, None] == self.ids[None, members]
                found = np.where(own, -math.inf, found)
                some = (found >= kth[rows, None]).any(axis=1) | (not exact)
                rows, found = rows[some], found[some]
                if not len(rows):
                    return
                all_scores = np.concatenate((best[rows], found), axis=1)
                all_ids = np.concatenate((ids[rows], np.broadcast_to(self.ids[members], found.shape)), axis=1)
                all_ids[all_scores == -math.inf] = -1
                order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
                best[rows] = np.take_along_axis(all_scores, order, 1)
                ids[rows] = np.take_along_axis(all_ids, order, 1)
                kth[rows] = np.maximum(kth[rows], best[rows, k - 1].astype(float))
                return
            left, right = bound(children[0], rows), bound(children[1], rows)
            first = left >= right
            visit(children[0], rows[first], left[first])
            visit(children[1], rows[first], right[first])
            visit(children[1], rows[~first], right[~first])
            visit(children[0], rows[~first], left[~first])

        everyone = np.arange(n)
        if n and len(self.ids):
            visit(0, everyone, bound(0, everyone))
        return best, ids


def _quantised(scale: int):
    schema = pa.schema([("vec_id", pa.int64()), ("query", pa.bool_()), ("vector", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, lists, query = batch.column(0), batch.column(1), batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = pc.cast(lists.flatten(), pa.float64())
            values = pc.fill_null(values, math.nan).to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(values * scale)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values) | ~np.isfinite(whole))))
            sound = (lengths > 0) & (bad[bounds[1:]] == bad[bounds[:-1]]) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(sound)
            vectors = [whole[bounds[i] : bounds[i + 1]].tobytes() for i in keep]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([ids.take(at), pc.fill_null(query, False).take(at), pa.array(vectors, pa.binary())], schema=schema)

    return run


def _trees(vec_ids: list[int], vectors: list[bytes]) -> dict[int, BallTree]:
    """A tree for each vector length; repeated ids count once."""
    trees = {}
    for size in sorted({len(v) for v in vectors}):
        own = sorted({i: v for i, v in sorted(zip(vec_ids, vectors), reverse=True) if len(v) == size}.items())
        trees[size] = BallTree(np.array([i for i, _ in own], np.int64), np.frombuffer(b"".join(v for _, v in own), np.float64).reshape(len(own), -1))
    return trees


def _answers(trees: dict[int, BallTree], rows: list[tuple[int, bytes, float]], k: int):
    """(query_id, best scores, best ids) of each query row, by vector length."""
    for size in sorted({len(v) for _, v, _ in rows}):
        if size in trees:
            own = [r for r in rows if len(r[1]) == size]
            queries = np.frombuffer(b"".join(v for _, v, _ in own), np.float64).reshape(len(own), -1)
            query_ids = np.array([i for i, _, _ in own], np.int64)
            yield query_ids, *trees[size].search(query_ids, queries, np.array([f for _, _, f in own]), k)


def _search_units(k: int, seeds: bool):
    """Tasks' work over rows (unit, kind, vec_id, vector, floor), vectors (kind 0) before
    queries (kind 1) of a unit: the scores found, or with ``seeds`` each query's k-th."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], schema=schema)

    def run(batches):
        unit, trees, vec_ids, vectors = None, None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            queries, out = [], []

            def answer():
                for query_ids, best, ids in _answers(trees, queries, k):
                    for q, scores, found in zip(query_ids.tolist(), best, ids):
                        if seeds:
                            out.extend([(q, None, int(scores[k - 1]))] if -EXACT < scores[k - 1] < EXACT else [])
                        else:
                            out.extend((q, int(i), max(min(int(s), _LAST), -_LAST - 1)) for s, i in zip(scores, found) if s > -math.inf)
                queries.clear()

            for u, kind, i, v, floor in zip(*columns):
                if u != unit:
                    answer()
                    unit, trees, vec_ids, vectors = u, None, [], []
                if kind == 0:
                    vec_ids.append(i)
                    vectors.append(v)
                else:
                    if trees is None:
                        trees = _trees(vec_ids, vectors)
                        vec_ids, vectors = [], []
                    queries.append((i, v, -math.inf if floor is None else floor))
            answer()
            yield table(out)

    return run


def top_k(vectors: DataFrame, query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row of
    ``vectors`` (vec_id, embedding) where ``query`` holds.

    A score is the inner product of floor(scale * component); ties go to the smaller
    vec_id. Vectors that are null, empty or hold a null or non-finite component, and
    rows without id, take no part; vectors of other lengths are no candidates; rows
    that repeat a vec_id count once. Scores beyond a long stop at its ends. Other
    columns are ignored; an empty table gives no rows.

    Rows are dealt into shards by id. Each query is first searched in its own shard;
    the k-th score found there is the floor below which every other shard prunes.
    Shards meet the queries in units of at most one full shard and one full group.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", query.alias("query"))
    rows = materialize(source.mapInArrow(_quantised(scale), "vec_id long, query boolean, vector binary"), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("query")).first()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // SHARD_ROWS), min(partitions, -(-n // LEAST_ROWS)), 1)
    groups = max(-(-asked // QUERY_GROUP), 1)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    no_floor = F.lit(None).cast("double").alias("floor")
    body = rows.select(shard.alias("shard"), "vec_id", "vector")

    def searched(data: DataFrame, questions: DataFrame, units: int, seeds: bool) -> DataFrame:
        both = data.unionByName(questions).repartitionById(units, "unit").sortWithinPartitions("unit", "kind", "vec_id")
        return both.mapInArrow(_search_units(k, seeds), FOUND)

    data = body.select(F.col("shard").alias("unit"), F.lit(0).alias("kind"), "vec_id", "vector", no_floor)
    own = rows.where("query").select(shard.alias("unit"), F.lit(1).alias("kind"), "vec_id", "vector", no_floor)
    floors = searched(data, own, shards, True).groupBy("query_id").agg(F.max("score").cast("double").alias("floor"))
    floors = materialize(floors, "floors")

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    unit = (F.col("shard") * groups + F.col("group")).cast("int").alias("unit")
    data = body.withColumn("group", every_group).select(unit, F.lit(0).alias("kind"), "vec_id", "vector", no_floor)
    asked_rows = rows.where("query").dropDuplicates(["vec_id"]).join(floors, F.col("vec_id") == F.col("query_id"), "left")
    asked_rows = asked_rows.withColumn("group", group).withColumn("shard", every_shard)
    questions = asked_rows.select(unit, F.lit(1).alias("kind"), "vec_id", "vector", "floor")
    found = searched(data, questions, shards * groups, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
