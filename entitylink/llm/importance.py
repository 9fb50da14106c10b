"""Importance resampling towards a target distribution, over hashed word features.

A feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. The CRC states of
frequent words and the buckets of frequent pairs are sent to every task; a feature
outside them gets its CRC from its bytes. Both ways give the same bucket, so the head
vocabulary decides how fast a bucket is found, never which. Bucket totals cover all
documents and all target texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entitylink.llm.sampling import first_by_hash
from entitylink.llm.text import slices, text_column
from entitylink.llm.vocab import joined_crc, word_codes, word_crcs
from entitylink.session import materialize

BUCKETS = 10_000
# Documents the head vocabulary is read off, at most, and its words and pairs at most.
HEAD_SAMPLE, HEAD_WORDS, HEAD_PAIRS = 2000, 4096, 65_536
# Bytes of text that are worked on together.
PART = 4 << 20

# Words are runs of digits, letters and bytes of other scripts.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Head:
    """Frequent words with their CRC states, and the buckets of frequent pairs in a table of
    one slot for each key's remainder (the first key keeps the slot)."""

    words: pa.Array
    crc: np.ndarray  # of the word
    open: np.ndarray  # of the word and one space
    length: np.ndarray
    pair: np.ndarray  # first * len(words) + second, or -1
    bucket: np.ndarray


def head_of(words: list[str], pairs: list[tuple[str, str]]) -> Head:
    """Head vocabulary of given words and of those pairs whose words are in it."""
    listed = pa.array(words, pa.string())
    crc, length = word_crcs(listed)
    opened = _opened(crc)
    place = {w: i for i, w in enumerate(words)}
    both = np.array([(place[a], place[b]) for a, b in pairs if a in place and b in place], np.int64).reshape(-1, 2)
    slots = 1 << max(1, (4 * len(both)).bit_length())
    pair, bucket = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
    keys = both[:, 0] * max(len(words), 1) + both[:, 1]
    slot, first = np.unique(keys % slots, return_index=True)
    a, b = both[first, 0], both[first, 1]
    pair[slot] = keys[first]
    bucket[slot] = joined_crc(opened[a], crc[b], length[b]) % BUCKETS
    return Head(listed, crc, opened, length, pair, bucket)


def _opened(crc: np.ndarray) -> np.ndarray:
    """CRCs of words followed by one space."""
    space, one = word_crcs(pa.array([" "]))
    return joined_crc(crc, np.broadcast_to(space, crc.shape), np.broadcast_to(one, crc.shape))


def _frequent(docs: DataFrame) -> Head:
    """Head vocabulary: the commonest words and pairs of a bounded sample of ``docs``."""
    sample = first_by_hash(docs.select("doc_id", "text"), F.col("doc_id"), HEAD_SAMPLE)

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in slices(text_column(batch), PART):
                codes, words, first = word_codes(data, offsets, APART)
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.string()), pa.array(n)], names=["a", "b", "n"])
                keys, n = np.unique(codes[:-1].astype(np.int64) * len(words) + codes[1:], return_counts=True) if len(codes) > 1 else (codes[:0], codes[:0])
                a, b = (words.take(pa.array(c)) for c in np.divmod(keys, max(len(words), 1)))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    counts = materialize(sample.select("text").mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "head")
    words = counts.where("b is null").orderBy(F.desc("n"), "a").limit(HEAD_WORDS).collect()
    pairs = counts.where("b is not null").orderBy(F.desc("n"), "a", "b").limit(HEAD_PAIRS).collect()
    return head_of([r["a"] for r in words], [(r["a"], r["b"]) for r in pairs])


def feature_buckets(data: np.ndarray, offsets: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, bucket of every pair, words before each row, pairs before each row)."""
    codes, words, first = word_codes(data, offsets, APART)
    n = np.diff(first)
    before = np.concatenate(([0], np.cumsum(np.maximum(n - 1, 0))))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first, before
    at = pc.index_in(words, head.words)
    known = np.asarray(at.is_valid())
    at = at.fill_null(0).to_numpy(zero_copy_only=False)
    crc, length, opened = (np.zeros(len(words), t) for t in (np.uint32, np.int64, np.uint32))
    if known.any():
        crc[known], length[known], opened[known] = head.crc[at[known]], head.length[at[known]], head.open[at[known]]
    tail = np.flatnonzero(~known)
    crc[tail], length[tail] = word_crcs(words.take(pa.array(tail)))
    opened[tail] = _opened(crc[tail])
    # a pair starts at every word but the last one of its row
    starts = np.ones(len(codes), bool)
    starts[first[1:][n > 0] - 1] = False
    starts = np.flatnonzero(starts)
    a, b = codes[starts], codes[starts + 1]
    keys = np.where(known[a] & known[b], at[a].astype(np.int64) * len(head.words) + at[b], -2)
    slot = keys % len(head.pair)
    frequent = head.pair[slot] == keys
    pairs = head.bucket[slot]
    rest = np.flatnonzero(~frequent)
    a, b = a[rest], b[rest]
    pairs[rest] = joined_crc(opened[a], crc[b], length[b]) % BUCKETS
    return (crc % _U(BUCKETS)).astype(np.int64)[codes], pairs, first, before


_U = np.uint32


def bucket_totals(texts: DataFrame, head: Head) -> DataFrame:
    """(bucket, n): how many features of all ``texts`` (text) fall into each bucket."""

    def run(batches):
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(text_column(batch), PART):
                words, pairs, _, _ = feature_buckets(data, offsets, head)
                totals += np.bincount(words, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
        full = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(totals[full])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(docs: DataFrame, target: DataFrame, head: Head) -> np.ndarray:
    """floor(1000 * log ratio) of target against source share, for each bucket."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for totals, texts in ((s, docs), (t, target)):
        for bucket, n in bucket_totals(texts, head).collect():  # at most BUCKETS rows
            totals[bucket] = n
    ratio = ((t + 1.0) * (s.sum() + float(BUCKETS))) / ((s + 1.0) * (t.sum() + float(BUCKETS)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise of a doc_id, times 1000, floored: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row of ``docs`` (doc_id, text)
    against all texts of ``target`` (text).

    Features are words and pairs of adjacent words, A-Z as a-z. ``weight`` is the floored
    mean over them of floor(1000 * ln of the smoothed share of their bucket in ``target``
    by that in ``docs``); 0 without features. ``score`` adds the noise of the doc_id, so the
    highest scores are a weighted sample without replacement.

    Null text is empty. Repeated rows count and are returned each; a row without doc_id
    counts in the totals and has no score. Empty tables teach nothing. Other columns are
    ignored.
    """
    head = _frequent(docs)
    gains = _gains(docs, target, head)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_features", "n_words", "weight")])

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in slices(text_column(batch), PART):
                words, pairs, first, before = feature_buckets(data, offsets, head)
                sums = [np.concatenate(([0], np.cumsum(gains[b]))) for b in (words, pairs)]
                n = np.diff(first) + np.diff(before)
                total = np.diff(sums[0][first]) + np.diff(sums[1][before])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                columns = [batch.column(0).slice(i, j - i), pa.array(n), pa.array(np.diff(first)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """``weighted`` with ``rank``: 1, 2, 3 ... for the floor(percent * N / 100) highest scores
    of the N rows with a doc_id and at least ``min_words`` words, ties to the smaller doc_id;
    null for the others.

    Scores are whole numbers of bounded range: means of gains lie within +-50,000 (totals below
    2**64) and the noise within -3,200 and 22,900, so the table of distinct scores,
    which alone is summed in order, has at most some 130,000 rows at any size. No row is
    sorted against all others. Equal rows take the ranks of their tie in any order.
    """
    rows = materialize(weighted(docs, target, seed), "weighted")
    usable = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    able = rows.where(usable)
    counts = materialize(able.groupBy("score").agg(F.count("*").alias("n")), "scores")
    drawn = counts.agg(F.expr(f"({percent} * sum(n)) div 100")).scalar()
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_above"), drawn.alias("_drawn"))
    able = able.join(F.broadcast(starts.where("_above < _drawn")), "score", "left")
    rank = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    near = able.where("_above is not null").withColumn("rank", F.when(rank <= F.col("_drawn"), rank).cast("long"))
    rest = able.where("_above is null").select(*rows.columns).unionByName(rows.where(~usable | F.col("doc_id").isNull()))
    return near.select(*rows.columns, "rank").unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
