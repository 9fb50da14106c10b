"""Languages of a text as a mixture, by expectation-maximisation over letter n-grams.

Each n-gram of a text is drawn from one of its languages; the proportions are those
that make all of them likeliest. Which languages a text has is chosen by penalised
likelihood: the likeliest single one, then the next by proportion for as long as each
gains more than its price.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.llm.text import NOT_LETTER, slices, text_column, word_bounds

# Bytes in an n-gram, and the hash buckets they fall into.
GRAM, BUCKETS = 4, 1 << 15
# Languages a model tells apart, at most: those with the most training rows. It holds
# BUCKETS numbers for each.
LANGUAGES = 256
# What every bucket of a language counts besides its n-grams.
SMOOTHING = 0.5
# Rounds of expectation-maximisation, and the change of proportions that ends them.
ROUNDS, STILL = 40, 1e-3
# Price of a further language, in logarithms of the number of n-grams. Neighbouring
# n-grams overlap in GRAM - 1 bytes, so their likelihoods count 1 / GRAM each.
PRICE = 1.0


def grams(col: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bucket of every n-gram, its row) for each slice of texts.

    Letters are in lower case; whatever else stands between words is one space, as are both
    ends of a text.
    """
    col = pc.utf8_lower(col)
    for i, j, data, offsets in slices(col, limit):
        starts, ends, first = word_bounds(data, offsets, NOT_LETTER)
        n, words = ends - starts, np.diff(first)
        row = np.repeat(np.arange(j - i), words)
        line = np.full(int(n.sum()) + len(n) + (j - i), 32, np.uint32)
        line[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)) + row + 1, n)] = data[~NOT_LETTER[data]]
        size = np.bincount(row, weights=n, minlength=j - i).astype(np.int64) + words + 1
        count = np.where(words > 0, np.maximum(size - GRAM + 1, 0), 0)
        at = np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        code = np.zeros(len(at), np.uint32)
        for k in range(GRAM):
            code = code << np.uint32(8) | line[at + k]
        bucket = (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)
        yield i, j, bucket, np.repeat(np.arange(j - i), count)


@dataclass
class Model:
    """``logs``[bucket, language]: log likelihoods, 0 in buckets no language has; the commonest
    language comes first among equals."""

    names: list[str]
    logs: np.ndarray
    known: np.ndarray
    usual: int


def trained(docs: DataFrame, learn: Column) -> Model:
    """Model of the rows of ``docs`` (text, lang) where ``learn`` holds and lang is not null.

    Counts cover all of these rows. At most ``LANGUAGES`` languages are told apart, those
    with the most rows, ties to the smaller name. An empty table gives a model of none.
    """
    rows = docs.where(learn & F.col("lang").isNotNull()).select("text", "lang")
    names = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    place = pa.array(names, pa.string())

    def run(batches):
        totals = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            lang = pc.fill_null(pc.index_in(batch.column(1).cast(pa.string()), place), -1).to_numpy(zero_copy_only=False)
            for i, j, bucket, row in grams(text_column(batch), 1 << 20):
                of = lang[i:j][row].astype(np.int64)
                keys, n = np.unique((of * BUCKETS + bucket)[of >= 0], return_counts=True)
                totals.ravel()[keys] += n
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (lang, bucket)] + [pa.array(totals[lang, bucket])], names=["l", "bucket", "n"])

    # at most LANGUAGES * BUCKETS rows
    counts = rows.mapInArrow(run, "l int, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((BUCKETS, len(names)))
    n[counts["bucket"].to_numpy(), counts["l"].to_numpy()] = counts["n"].to_numpy()
    known = n.sum(axis=1) > 0
    logs = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * BUCKETS)) if names else n
    return Model(names, np.where(known[:, None], logs, 0.0), known, int(n.sum(axis=0).argmax()) if names else 0)


def _proportions(like: np.ndarray, n: np.ndarray, row: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each row, from ``share`` on. Languages with share 0
    stay out. ``like``: likelihood of each n-gram in each language; ``n``: how often it
    stands in its ``row``; every row has one, and they are in order."""
    share = share.copy()
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    total = np.add.reduceat(n, first)
    open_, where, at = np.arange(len(first)), first, np.arange(len(n))
    for _ in range(ROUNDS):
        of = row[at]
        mixed = like[at] * share[of]
        mixed *= (n[at] / mixed.sum(axis=1))[:, None]
        new = np.add.reduceat(mixed, where, axis=0) / total[open_][:, None]
        moved = np.abs(new - share[open_]).max(axis=1) >= STILL
        share[open_] = new
        if not moved.any():
            break
        if moved.sum() < 0.7 * len(open_):  # go on with those that still move
            left = np.zeros(len(first), bool)
            left[open_[moved]] = True
            open_, at = open_[moved], at[left[of]]
            where = np.flatnonzero(np.concatenate(([True], row[at][1:] != row[at][:-1])))
    return share, np.add.reduceat(n * np.log((like * share[row]).sum(axis=1)), first)


def mixtures(bucket: np.ndarray, row: np.ndarray, rows: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of the chosen languages, proportions among all) of each of ``rows`` rows;
    those without a known n-gram get 0 everywhere."""
    size = len(model.names)
    chosen, every = np.zeros((rows, size)), np.zeros((rows, size))
    keep = model.known[bucket]
    keys, n = np.unique(row[keep] * BUCKETS + bucket[keep], return_counts=True)
    if not len(keys):
        return chosen, every
    of, bucket = np.divmod(keys, BUCKETS)
    full, of = np.unique(of, return_inverse=True)
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    total = np.add.reduceat(n, first)
    logs = model.logs[bucket]
    alone = np.add.reduceat(logs * n[:, None], first, axis=0)
    like = np.exp(logs - logs.max(axis=1, keepdims=True))  # scaled by n-gram, which changes no proportion
    scale = np.add.reduceat(n * logs.max(axis=1), first)
    share, _ = _proportions(like, n, of, np.full((len(full), size), 1 / size))
    every[full] = share
    best = alone.argmax(axis=1)
    order = np.argsort(-share, axis=1, kind="stable")
    # the likeliest single language in front, then by proportion
    order = np.concatenate((best[:, None], order), axis=1)
    taken = np.zeros((len(full), size))
    taken[np.arange(len(full)), best] = 1.0
    worth = alone[np.arange(len(full)), best] / GRAM
    chosen[full] = taken
    going = np.arange(len(full))
    for k in range(1, size):
        if not len(going):
            break
        # the next one by proportion that is not in the set
        out = taken[going] == 0
        rank = np.where(out[np.arange(len(going))[:, None], order[going, 1:]], np.arange(size), size).argmin(axis=1)
        added = order[going, 1 + rank]
        left = np.full(len(full), -1)
        left[going] = np.arange(len(going))
        at = np.flatnonzero(left[of] >= 0)
        start = (taken[going] > 0).astype(float)
        start[np.arange(len(going)), added] = 1.0
        share, likely = _proportions(like[at], n[at], left[of[at]], start / (k + 1))
        value = (likely + scale[going]) / GRAM - PRICE * k * np.log(total[going] + 1)
        better = value > worth[going]
        going, share = going[better], share[better]
        taken[going], worth[going] = np.maximum(share, 1e-12 * (start[better] > 0)), value[better]
        chosen[full[going]] = share
    return chosen, every


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and languages of every row of ``docs`` (doc_id, text).

    ``languages``: (lang, share) of the chosen languages, largest share first; ``lang_pred`` is
    the first, ``score`` its share when all languages of the model compete. Text that is null
    or has no letter, and any text if the model has no language, is ``und`` with score 0 and
    no languages. Text with letters but no n-gram that the model knows is the usual language
    with an even score. Whole texts are read; repeated rows and null ids are returned as they
    are; an empty table gives no rows. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", kind)])
    size = len(model.names)
    names = np.array([*model.names, "und"], object)

    def run(batches):
        for batch in batches:
            col = text_column(batch)
            letters = np.asarray(pc.match_substring_regex(col, r"\p{L}"))
            for i, j, bucket, row in grams(col, max((1 << 22) // max(size, 4), 1 << 14)):
                chosen, every = mixtures(bucket, row, j - i, model)
                listed, best, score = [], np.full(j - i, size), np.zeros(j - i)
                for k in range(j - i):
                    if not (size and letters[i + k]):
                        listed.append([])
                        continue
                    if not chosen[k].any():
                        chosen[k, model.usual], every[k] = 1.0, 1 / size
                    order = sorted(np.flatnonzero(chosen[k]), key=lambda x: (-chosen[k, x], x))  # noqa: B023
                    best[k], score[k] = order[0], min(every[k, order[0]], 1.0)
                    listed.append([{"lang": model.names[x], "share": chosen[k, x]} for x in order])
                columns = [batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score), pa.array(listed, kind)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    shape = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, shape)
