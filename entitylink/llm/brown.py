"""Class-based bigram language model: words fall into classes by exchange clustering.

P(word | before) = P(class | class before) * P(word | class). What is clustered are
units: every word that makes up ``UNIT_SHARE`` of the training tokens is one, all
rarer words share ``GROUPS`` units by their last two bytes. Shares are relative, so
there are at most 1 / UNIT_SHARE + GROUPS + 1 units at any size of the corpus, while
counts of words cover all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.llm.text import slices, text_column, word_bounds, word_hashes
from entitylink.session import materialize

CLASSES = 32
ROUNDS = 6
UNIT_SHARE = 2e-5
GROUPS = 1024
# Words above this share have their counts sent to every task (at most 1 / share
# words of 16 bytes); the counts of all others are joined.
SENT_SHARE = 1e-6
# Weight of the class frequencies in a transition, in tokens.
BACKING = 1.0
# Tokens a task gathers before it hands on its counts.
GATHER = 1 << 22

END = np.uint64(0)
_U = np.uint64
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Hashes and groups of all tokens, each row ended by END, and the bounds of rows."""
    starts, ends, first = word_bounds(data, offsets)
    rows = len(first) - 1
    bounds = first + np.arange(rows + 1)
    hashes = np.full(len(starts) + rows, END, np.uint64)
    groups = np.zeros(len(hashes), np.int64)
    at = np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(first))
    hashes[at] = word_hashes(data, starts, ends)
    if len(starts):
        last, before = _LOWER[data[ends - 1]], np.where(ends - starts > 1, _LOWER[data[ends - 2]], 0)
        groups[at] = (last * 37 + before) % GROUPS
    return hashes, groups, bounds


def _count_words(batches):
    schema = pa.schema([("word", pa.int64()), ("grp", pa.int32()), ("n", pa.int64())])

    def flush(parts):
        words, first, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
        groups = np.concatenate([p[1] for p in parts])[first].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(groups), pa.array(n)], schema=schema)

    parts, size = [], 0
    for batch in batches:
        for _, _, data, offsets in slices(text_column(batch)):
            hashes, groups, _ = _tokens(data, offsets)
            parts.append((hashes, groups.astype(np.int16)))
            size += len(hashes)
            if size >= GATHER:
                yield flush(parts)
                parts, size = [], 0
    if parts:
        yield flush(parts)


@dataclass
class Vocabulary:
    """What every task holds of the word counts."""

    words: np.ndarray  # sorted hashes of the words above SENT_SHARE
    counts: np.ndarray
    unit: np.ndarray  # their unit, or -1 for that of their group
    units: int
    tokens: int
    distinct: int
    of_group: np.ndarray  # distinct words in each group unit


def _vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sent = counts.where(F.col("n") >= max(1, tokens * SENT_SHARE)).select("word", "n").toArrow()
    words, n = sent["word"].to_numpy().view(np.uint64), sent["n"].to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    own = (n >= max(1, tokens * UNIT_SHARE)) & (words != END)
    unit = np.where(own, GROUPS + np.cumsum(own), -1)  # units: groups, END, frequent words
    unit[words == END] = GROUPS
    alone = (F.col("n") < max(1, tokens * UNIT_SHARE)) & (F.col("word") != 0)
    of_group = np.zeros(GROUPS, np.int64)
    for r in counts.where(alone).groupBy("grp").count().collect():  # at most GROUPS rows
        of_group[r["grp"]] = r["count"]
    return Vocabulary(words, n, unit, GROUPS + 1 + int(own.sum()), tokens, distinct, of_group)


def _encode(vocabulary: Vocabulary):
    """Rows of units (16-bit), the known part of the log counts, and the words whose
    counts no task holds."""
    v = vocabulary
    fields = [("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    fields += [("log_counts", pa.float64()), ("units", pa.binary()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, held = batch.column(0), batch.column(2)
            for i, j, data, offsets in slices(text_column(batch)):
                hashes, groups, bounds = _tokens(data, offsets)
                at = np.minimum(np.searchsorted(v.words, hashes), max(len(v.words) - 1, 0))
                known = v.words[at] == hashes if len(v.words) else np.zeros(len(hashes), bool)
                n = np.where(known, v.counts[at], 0) if len(v.words) else np.zeros(len(hashes), np.int64)
                unit = np.where(known, v.unit[at], -1) if len(v.words) else np.full(len(hashes), -1)
                unit = np.where(unit >= 0, unit, np.where(hashes == END, GROUPS, groups)).astype(np.uint16)
                logs = np.add.reduceat(np.log10(n + 1.0), bounds[:-1])
                own = np.add.reduceat(known.astype(np.int64), bounds[:-1])
                rare = ~known & (hashes != END)
                words, times, sizes = [], [], [0]
                for a, b in zip(bounds[:-1], bounds[1:]):
                    w, t = np.unique(hashes[a:b][rare[a:b]], return_counts=True)
                    words.append(w)
                    times.append(t)
                    sizes.append(len(w))
                edge = pa.array(np.cumsum(sizes).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(edge, pa.array(np.concatenate(words).view(np.int64))),
                    pa.ListArray.from_arrays(edge, pa.array(np.concatenate(times).astype(np.int32))),
                ]
                raw = unit.tobytes()
                units = pa.array([raw[2 * a : 2 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                keys = pa.array(np.arange(key, key + j - i))
                key += j - i
                columns = [keys, ids.slice(i, j - i), held.slice(i, j - i), pa.array(np.diff(bounds)), pa.array(own), pa.array(logs), units]
                yield pa.RecordBatch.from_arrays(columns + lists, schema=schema)

    shape = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, units binary, rare array<long>, times array<int>"
    return run, shape


def _contexts(rows: DataFrame, classes: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every unit how often each class stands before and after it, and how often it
    follows itself. Tasks sum their rows, Spark sums the tasks; the driver gets one
    row per unit."""
    k = CLASSES
    schema = pa.schema([("unit", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        left, right, self_ = np.zeros(units * k, np.int64), np.zeros(units * k, np.int64), np.zeros(units, np.int64)
        for batch in batches:
            for piece in range(0, len(batch), 512):
                raw = b"".join(batch.column(0).slice(piece, 512).to_pylist())
                after = np.frombuffer(raw, np.uint16).astype(np.int64)
                before = np.append(GROUPS, after[:-1])  # every row ends with END
                left += np.bincount(after * k + classes[before], minlength=units * k)
                right += np.bincount(before * k + classes[after], minlength=units * k)
                self_ += np.bincount(after[after == before], minlength=units)
        sums = np.concatenate((left.reshape(units, k), right.reshape(units, k), self_[:, None]), axis=1)
        seen = np.flatnonzero(sums.any(axis=1))
        edge = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * (2 * k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.ListArray.from_arrays(edge, pa.array(sums[seen].ravel()))], schema=schema)

    parts = rows.select("units").mapInArrow(run, "unit int, sums array<long>")

    def add(table: pa.Table) -> pa.Table:
        sums = np.array(table["sums"].combine_chunks().flatten()).reshape(-1, 2 * k + 1)
        own, inverse = np.unique(np.array(table["unit"]), return_inverse=True)
        total = np.zeros((len(own), 2 * k + 1), np.int64)
        np.add.at(total, inverse, sums)
        edge = pa.array(np.arange(len(own) + 1, dtype=np.int32) * (2 * k + 1))
        return pa.Table.from_arrays([pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(edge, pa.array(total.ravel()))], schema=schema)

    summed = parts.groupBy(F.expr("unit div 16")).applyInArrow(add, "unit int, sums array<long>").toArrow()
    out = np.zeros((units, 2 * k + 1), np.int64)
    if summed.num_rows:
        out[summed["unit"].to_numpy()] = np.array(summed["sums"].combine_chunks().flatten()).reshape(-1, 2 * k + 1)
    return out[:, :k], out[:, k : 2 * k], out[:, 2 * k]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(classes: np.ndarray, left: np.ndarray, right: np.ndarray, self_: np.ndarray) -> tuple[np.ndarray, int]:
    """One round over all units, most frequent first: each goes to the class that makes
    the training text most likely, given the others. END keeps class 0 to itself."""
    k = CLASSES
    classes = classes.copy()
    pairs = np.zeros((k, k))
    np.add.at(pairs.T, classes, left.astype(float))  # pairs[class before, class]
    moved = 0
    for u in np.argsort(-left.sum(axis=1), kind="stable"):
        own, s = classes[u], float(self_[u])
        before, after = left[u].astype(float), right[u].astype(float)
        if u == GROUPS or not before.any():
            continue
        # counts seen when the round began may have moved: never below zero
        before[own] = max(before[own] - s, 0.0)
        after[own] = max(after[own] - s, 0.0)
        rest = pairs.copy()
        rest[:, own] -= before
        rest[own, :] -= after
        rest[own, own] -= s
        np.maximum(rest, 0.0, out=rest)
        rows, columns = rest.sum(axis=1) + before, rest.sum(axis=0) + after
        whole_before, whole_after = before.sum() + s, after.sum() + s
        gain = (_xlogx(rest + before[:, None]) - _xlogx(rest)).sum(axis=0)
        gain += (_xlogx(rest + after[None, :]) - _xlogx(rest)).sum(axis=1)
        d = np.diag(rest)
        gain += _xlogx(d + before + after + s) - _xlogx(d + before) - _xlogx(d + after) + _xlogx(d)
        gain -= _xlogx(rows + whole_after) - _xlogx(rows) + _xlogx(columns + whole_before) - _xlogx(columns)
        gain[0] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= gain[own] + 1e-9:
            best = own
        rest[:, best] += before
        rest[best, :] += after
        rest[best, best] += s
        pairs = rest
        moved += best != own
        classes[u] = best
    return classes, moved


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    ``docs`` (doc_id, text); the model learns from the rows not held out.

    Tokens are the words and one end. ``base_score`` is the log10 likelihood under
    add-one unigrams, ``score`` under the class model, whose words are add-one within
    their class (an unseen one included) and whose transitions lean on the class
    frequencies. Null text is empty: its end alone. With nothing to learn from every
    score rests on the priors. Repeated rows are each scored and counted; a null doc_id
    is not held out. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    parts = docs.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "word long, grp int, n long")
    counts = materialize(parts.groupBy("word").agg(F.max("grp").alias("grp"), F.sum("n").alias("n")), "words")
    v = _vocabulary(counts)
    rows = materialize(docs.mapInArrow(*_encode(v)), "encoded")

    train = rows.where(~F.col("held_out"))
    classes = np.zeros(v.units, np.int64)
    others = np.flatnonzero(np.arange(v.units) != GROUPS)
    classes[others] = 1 + np.arange(len(others)) % (CLASSES - 1)
    left, right, self_ = _contexts(train, classes, v.units)
    for _ in range(ROUNDS):
        classes, moved = exchange(classes, left, right, self_)
        left, right, self_ = _contexts(train, classes, v.units)
        if moved * 1000 <= v.units:
            break

    pairs, of_class = np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES)
    np.add.at(pairs.T, classes, left.astype(float))
    distinct = np.zeros(CLASSES)
    np.add.at(distinct, classes[:GROUPS], v.of_group)
    np.add.at(distinct, classes[GROUPS:], 1)
    np.add.at(of_class, classes, left.sum(axis=1))
    share = (of_class + 1.0) / (of_class.sum() + CLASSES)
    moves = np.log10((pairs + BACKING * share) / (pairs.sum(axis=1, keepdims=True) + BACKING))
    below = np.log10(of_class + distinct + 1.0)
    fields = ["key", "doc_id", "held_out", "n_tokens", "n_known", "log_counts"]

    def of_classes(batches):
        for batch in batches:
            out = np.zeros(len(batch))
            for k, raw in enumerate(batch.column(6).to_pylist()):
                c = classes[np.frombuffer(raw, np.uint16)]
                out[k] = moves[np.append(0, c[:-1]), c].sum() - below[c].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out)], names=[*fields, "class_score"])

    shape = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, class_score double"
    each = rows.select(*fields, "units").mapInArrow(of_classes, shape)
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rare = rare.join(counts.select("word", "n"), "word")
    rare = rare.groupBy("key").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    out = each.join(rare, "key", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))).alias("base_score"),
        (logs + F.col("class_score")).alias("score"),
    )
