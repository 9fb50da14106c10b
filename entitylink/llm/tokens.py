"""Token ids of whole texts, and what they decode to, as a DataFrame operator."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entitylink.llm.bpe import encoder
from entitylink.llm.text import slices, text_column


def encoded(docs: DataFrame, path: str, text: bool = True) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row of ``docs`` (doc_id, text).

    ``path``: a public byte-level BPE file that every executor can read. Null text is
    encoded as empty: no ids, decoded empty. Repeated rows and null ids are returned
    as they are; other columns are ignored. Memory is bounded by one slice of text
    and the words remembered.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            col = text_column(batch)
            for i, j, _, _ in slices(col):
                ids, bounds, decoded = enc.encode_decode(col.slice(i, j - i).to_pylist())
                rows = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows, pa.array(decoded)], schema=schema)
        enc.shrink()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encoded``, with digests in place of ids and text: n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8)."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            col = text_column(batch)
            for i, j, _, _ in slices(col):
                ids, bounds, decoded = enc.encode_decode(col.slice(i, j - i).to_pylist())
                raw = memoryview(ids.astype("<u4").tobytes())
                of_ids = [hashlib.sha256(raw[4 * bounds[k] : 4 * bounds[k + 1]]).hexdigest() for k in range(j - i)]
                of_text = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(of_ids), pa.array(of_text)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        enc.shrink()

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, shape)
