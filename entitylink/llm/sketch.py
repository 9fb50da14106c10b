"""Threshold-scaled document sketches.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash range,
and the smallest one, so that no text with words has an empty sketch. Sketches of
parts merge by union; what two share estimates how much of the smaller document
the larger one contains, however unequal they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.llm.text import row_shingles, slices, text_column

# One hash in SCALE is kept.
SCALE = 8
_U = np.uint64


def sketches(col: pa.Array, scale: int = SCALE) -> list[np.ndarray]:
    """Sorted 48-bit hashes kept of each text."""
    out = []
    for _, values, bounds in row_shingles(col):
        values = values >> _U(16)
        small = values < _U((1 << 48) // scale)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = values[a:b]
            kept = np.unique(own[small[a:b]])
            out.append(kept if len(kept) or a == b else own.min(keepdims=True))
    return out


def merged(sketch: np.ndarray, other: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of two texts' shingles together."""
    both = np.union1d(sketch, other)
    below = both[both < _U((1 << 48) // scale)]
    return below if len(below) else both[:1]


def containment(sketch: np.ndarray, other: np.ndarray) -> float:
    """Share of the smaller sketch that the other holds too; equal sketches give 1, one
    without words against one with words 0."""
    if len(sketch) == len(other) and (sketch == other).all():
        return 1.0
    if not len(sketch) or not len(other):
        return 0.0
    return len(np.intersect1d(sketch, other, assume_unique=True)) / min(len(sketch), len(other))


def spelled(sketch: np.ndarray) -> str:
    """The hashes in order, twelve hexadecimal digits each."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text); no shuffle.

    Null or blank text has the empty fingerprint. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            prints = [spelled(s) for s in sketches(text_column(batch), scale)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in one partition per range of doc_id, sorted by
    descending doc_id, ended by the first row of the next range (``borrowed``); the
    first range follows the last. Ranges are cut at quantiles, one for each shuffle
    partition; the driver holds that many ids. Null ids come last.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    cuts = docs.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0] or []
    cuts = sorted(set(cuts[: parts - 1]))
    in_range = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c < F.col("key"))).cast("int")
    heads = docs.groupBy(in_range.alias("range")).agg(F.max("key").alias("key")).orderBy("range").collect()
    lent = [(h["key"], heads[(k + 1) % len(heads)]["range"]) for k, h in enumerate(heads)]
    lent = docs.sparkSession.createDataFrame(lent, "key long, to int")  # one row per range
    rows = docs.join(F.broadcast(lent), "key", "left")
    own = F.struct(in_range.alias("range"), F.lit(False).alias("borrowed"))
    copy = F.struct(F.col("to").alias("range"), F.lit(True).alias("borrowed"))
    at = F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    rows = rows.withColumn("at", at).select("doc_id", "text", "key", "at.range", "at.borrowed")
    return rows.repartitionById(parts, "range").sortWithinPartitions("range", "borrowed", F.desc("key"), F.desc("text"))


FINGERPRINTS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document's by descending doc_id; after the last comes
    the first. ``near_edited`` and ``near_next`` are the containment of one sketch in
    the other. Null text is empty. Rows of one doc_id follow each other by descending
    text; rows without doc_id come last. A lone row is its own next. Other columns
    are ignored. The text is shuffled once.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema([(f.split()[0], k) for f, k in zip(FINGERPRINTS.split(", "), kinds)])

    def run(batches):
        last = None  # the row before this slice: (doc_id, text, range, borrowed, sketch)
        for batch in batches:
            col = text_column(batch)
            ids, ranges, borrowed = (batch.column(k).to_pylist() for k in (0, 3, 4))
            for i, j, _, _ in slices(col):
                part = col.slice(i, j - i)
                rows = list(zip(ids[i:j], part.to_pylist(), ranges[i:j], borrowed[i:j], sketches(part, scale)))
                rows = ([last] if last else []) + rows
                last = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
                edited = []
                for a, b in pairs:
                    n = len(a[1]) // 3
                    edited.append(a[1][: len(a[1]) - n] + b[1][:n])
                out = []
                for (a, b), text, sketch in zip(pairs, edited, sketches(pa.array(edited, pa.string()), scale)):
                    digest = hashlib.sha256(text.encode()).hexdigest()
                    near = containment(a[4], sketch), containment(a[4], b[4])
                    out.append((a[0], len(a[1]), digest, spelled(a[4]), spelled(sketch), *near))
                columns = zip(*out) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

    return with_next(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, FINGERPRINTS)
