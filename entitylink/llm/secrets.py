"""Secrets in text: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as outside (0), begin (1) or inside (2) of a secret value by
token shape, neighbouring words and what stands between them, and features of the
whole file. It learns from what the fixed patterns find and adds what they miss.
Shapes ignore case, and a name may be anywhere within two tokens, so values
written in capitals or split from their names by noise are still recognised.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.llm.sampling import first_by_hash
from entitylink.llm.text import hashes_of, slices, text_column, word_bounds, word_hashes
from entitylink.session import materialize

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

# Documents the field is trained on, at most: so many with a base span, and as many of all.
SAMPLE = 400
_WIDTH = 48  # tokens of a training window

_VALUE = np.ones(256, bool)  # bytes apart from those of tokens
_VALUE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b"_+/-."]] = False
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_HEXIT = np.zeros(256, np.int32)
_HEXIT[[*range(48, 58), *range(65, 71), *range(97, 103)]] = 1
_ASSIGNS = np.zeros(256, np.int32)
_ASSIGNS[list(b"=:")] = 1
_QUOTES = np.zeros(256, np.int32)
_QUOTES[list(b"\"'")] = 1
_NAME_HASHES = np.sort(hashes_of(list(NAMES)))


def base_spans(text: str, may_hold_hex: bool = True) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, value start) of the fixed patterns, leftmost and not
    overlapping per kind; matches that are too short are dropped."""
    spans = []
    low = text.lower()
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        found = ((m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text))
        spans += [s for s in found if s[2] - s[3] >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if may_hold_hex:
        spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(spans)


def holds_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows may hold a run of LEAST_HEX hexadecimal digits."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(data) >= LEAST_HEX:
        others = np.concatenate(([0], np.cumsum(~_HEX[data], dtype=np.int32)))
        runs = np.flatnonzero(others[LEAST_HEX:] == others[:-LEAST_HEX])
        out[np.unique(np.searchsorted(offsets, runs, "right") - 1)] = True
    return out


# ---- features -------------------------------------------------------------------
# A token's features are one value of each of these: (name, number of values).
FEATURES = [("length", 7), ("digits", 5), ("turns", 5), ("hex", 2), ("mark", 2), ("name", 3), ("assigns", 2), ("quote", 2), ("file name", 2), ("file digits", 3)]
_SHAPE = 5  # the first features depend on the token alone
_FIRST = np.concatenate(([0], np.cumsum([n for _, n in FEATURES])))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
    return total[ends] - total[starts]


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Values of the shape features of every token."""
    length = ends - starts
    digit, letter = _DIGIT[data], _LETTER[data]
    digits = _sums(digit, starts, ends)
    letters = _sums(letter, starts, ends)
    turn = np.zeros(len(data), np.int32)
    turn[1:] = (digit[1:] != digit[:-1]) & (digit[1:] + letter[1:] > 0) & (digit[:-1] + letter[:-1] > 0)
    turns = _sums(turn, np.minimum(starts + 1, ends), ends)
    share = np.where(digits == 0, 0, np.where(digits == length, 4, 1 + np.minimum(digits * 3 // np.maximum(length, 1), 2)))
    return np.stack((
        np.searchsorted([4, 8, 12, 16, 24, 32], length, "right"),
        share,
        np.searchsorted([1, 2, 4, 8], turns, "right"),
        (_sums(_HEXIT[data], starts, ends) == length).astype(np.int64),
        (digits + letters < length).astype(np.int64),
    ), axis=1)


@dataclass
class Tokens:
    """Tokens of a slice: byte bounds, tokens before each row, row of each token."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        starts, ends, first = word_bounds(data, offsets, _VALUE)
        return cls(data, offsets, starts, ends, first, np.repeat(np.arange(len(first) - 1), np.diff(first)))

    def around(self, at: np.ndarray) -> np.ndarray:
        """Values of the other features of the tokens ``at``."""
        hashes = word_hashes(self.data, self.starts, self.ends)
        found = np.minimum(np.searchsorted(_NAME_HASHES, hashes), len(_NAME_HASHES) - 1)
        named = _NAME_HASHES[found] == hashes
        own = self.row[at]
        back = lambda k: np.where((at >= k) & (self.row[np.maximum(at - k, 0)] == own), np.maximum(at - k, 0), -1)
        one, two = back(1), back(2)
        name = np.where((one >= 0) & named[one], 2, np.where((two >= 0) & named[two], 1, 0))
        gap = np.where(one >= 0, self.ends[one], self.offsets[own])
        file_name = np.zeros(len(self.first) - 1, bool)
        file_name[self.row[named]] = True
        digits = _sums(_DIGIT[self.data], self.offsets[:-1], self.offsets[1:])
        share = np.searchsorted([0.01, 0.05], digits / np.maximum(np.diff(self.offsets), 1), "right")
        return np.stack((
            name,
            _sums(_ASSIGNS[self.data], gap, self.starts[at]) > 0,
            _sums(_QUOTES[self.data], gap, self.starts[at]) > 0,
            file_name[own],
            share[own],
        ), axis=1).astype(np.int64)


# ---- model ----------------------------------------------------------------------


@dataclass
class Field:
    """Weights of a linear chain: ``emit`` by feature value and tag, ``move`` by tag pair."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, values: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Emission scores of tokens by tag."""
        last = upto or len(FEATURES)
        return sum(self.emit[_FIRST[k] + values[:, k]] for k in range(last))

    def outside(self, shape: np.ndarray) -> np.ndarray:
        """Tokens that no best path tags as a secret, by shape alone: even with the most
        favourable neighbours, being outside scores higher."""
        gain = self.scores(shape, _SHAPE)
        gain = gain[:, 1:] - gain[:, :1]
        for k in range(_SHAPE, len(FEATURES)):
            own = self.emit[_FIRST[k] : _FIRST[k + 1]]
            gain = gain + (own[:, 1:] - own[:, :1]).max(axis=0)
        m = self.move
        best = [max(m[p, s] + m[s, n] - m[p, 0] - m[0, n] for p in range(3) for n in range(3)) for s in (1, 2)]
        return (gain + np.array(best) < -1e-6).all(axis=1)

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi tags of a run of tokens with outside tokens on both sides."""
        best, back = scores[0] + self.move[0], []
        for s in scores[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + s
        tag = int((best + self.move[:, 0]).argmax())
        tags = [tag]
        for b in reversed(back):
            tags.append(tag := int(b[tag]))
        return tags[::-1]

    def spans(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """(row, first byte, last byte + 1) of the secrets found."""
        shape = shapes(tokens.data, tokens.starts, tokens.ends)
        at = np.flatnonzero(~self.outside(shape))
        if not len(at):
            return []
        scores = self.scores(np.concatenate((shape[at], tokens.around(at)), axis=1))
        row = tokens.row[at]
        edge = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(row) > 0)))
        out = []
        for a, b in zip(edge, [*edge[1:], len(at)]):
            tags, open_ = self.decode(scores[a:b]), None
            for k, tag in enumerate([*tags, 0]):
                if open_ is not None and tag != 2:
                    out.append((int(row[a]), int(tokens.starts[at[a + open_]]), int(tokens.ends[at[a + k - 1]])))
                    open_ = None
                if tag and open_ is None and k < len(tags):
                    open_ = k
        return out


def _training_windows(batches):
    """Windows of feature values and tags: around base spans, around other tokens with
    digits, and evenly through each text."""
    schema = pa.schema([("values", pa.binary()), ("tags", pa.binary())])
    for batch in batches:
        col, out = text_column(batch), set()
        for i, j, data, offsets in slices(col):
            tokens = Tokens.of(data, offsets)
            if not len(tokens.starts):
                continue
            everything = np.arange(len(tokens.starts))
            shape = shapes(data, tokens.starts, tokens.ends)
            values = np.concatenate((shape, tokens.around(everything)), axis=1).astype(np.int8)
            tags = np.zeros(len(everything), np.int8)
            for k, text in enumerate(col.slice(i, j - i).to_pylist()):
                for _, _, end, value in base_spans(text):
                    a, b = (int(offsets[k]) + len(text[:x].encode()) for x in (value, end))
                    inside = np.flatnonzero((tokens.starts < b) & (tokens.ends > a) & (tokens.row == k))
                    tags[inside] = 2
                    tags[inside[:1]] = 1
            digits = (shape[:, 1] > 0) & (shape[:, 0] > 0)
            for a, b in zip(tokens.first[:-1], tokens.first[1:]):
                centres = [*np.flatnonzero(tags[a:b] == 1)[:8], *np.flatnonzero(digits[a:b])[:8], *range(_WIDTH // 2, b - a, 8 * _WIDTH)]
                for c in centres:
                    lo = max(a + c - _WIDTH // 2, a)
                    hi = min(lo + _WIDTH, b)
                    out.add((values[lo:hi].tobytes(), tags[lo:hi].tobytes()))
        rows = sorted(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary()) for c in (0, 1)], schema=schema)


def fitted(windows: list[tuple[bytes, bytes]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-5) -> Field | None:
    """Field of the largest conditional likelihood, less a square penalty; None if
    nothing is tagged. Full-batch steps over forward-backward sums."""
    rows = [(np.frombuffer(v, np.int8).reshape(-1, len(FEATURES)).astype(np.int64), np.frombuffer(t, np.int8)) for v, t in windows]
    if not any(t.any() for _, t in rows):
        return None
    n, width = len(rows), max(len(t) for _, t in rows)
    tags, live = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    values = np.zeros((n, width, len(FEATURES)), np.int64)
    for r, (v, t) in enumerate(rows):
        values[r, : len(t)], tags[r, : len(t)], live[r, : len(t)] = v, t, True
    # tokens of equal features share their score
    kinds, kind = np.unique(values.reshape(-1, len(FEATURES)), axis=0, return_inverse=True)
    kinds, kind = kinds + _FIRST[:-1], kind.reshape(n, width)
    emit, move = np.zeros((_FIRST[-1], 3)), np.zeros((3, 3))

    def by_feature(weights: np.ndarray) -> np.ndarray:
        """Sums of a tag weight of every token, by feature value and tag."""
        of_kind = np.stack([np.bincount(kind[live], weights[..., tag][live], len(kinds)) for tag in range(3)], axis=1)
        out = np.zeros_like(emit)
        for k in range(len(FEATURES)):
            np.add.at(out, kinds[:, k], of_kind)
        return out

    seen_emit, seen_move = by_feature(np.eye(3)[tags]), np.zeros_like(move)
    both = live[:, 1:] & live[:, :-1]
    np.add.at(seen_move, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    speed, size = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    total = live.sum()
    unit = lambda x: x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
    for step in range(1, rounds + 1):
        score = emit[kinds].sum(axis=1)[kind]
        grow, turn = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(move)
        forward, backward = np.empty_like(grow), np.ones_like(grow)
        forward[:, 0] = unit(grow[:, 0])
        for t in range(1, width):
            forward[:, t] = np.where(live[:, t, None], unit((forward[:, t - 1] @ turn) * grow[:, t]), forward[:, t - 1])
        want_move = np.zeros_like(move)
        for t in range(width - 2, -1, -1):
            onward = grow[:, t + 1] * backward[:, t + 1]
            pairs = unit(forward[:, t, :, None] * turn * onward[:, None, :])
            want_move += pairs[live[:, t + 1]].sum(axis=0)
            backward[:, t] = np.where(live[:, t + 1, None], unit(onward @ turn.T), 1.0)
        chance = forward * backward
        chance /= chance.sum(axis=2, keepdims=True)
        for p, (weight, slope) in enumerate(((emit, seen_emit - by_feature(chance)), (move, seen_move - want_move))):
            slope = slope / total - decay * weight
            speed[p] = 0.9 * speed[p] + 0.1 * slope
            size[p] = 0.999 * size[p] + 0.001 * slope**2
            weight += rate * (speed[p] / (1 - 0.9**step)) / (np.sqrt(size[p] / (1 - 0.999**step)) + 1e-8)
    return Field(emit, move)


def trained(docs: DataFrame, limit: int = SAMPLE) -> Field | None:
    """Field fitted on at most ``limit`` distinct texts with base spans and ``limit`` of all, the
    first by md5. None if no text has a base span."""
    schema = pa.schema([("text", pa.string())])

    def with_spans(batches):
        for batch in batches:
            col = text_column(batch)
            for i, j, data, offsets in slices(col):
                texts = col.slice(i, j - i).to_pylist()
                keep = [t for t, h in zip(texts, holds_hex(data, offsets)) if base_spans(t, h)]
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], schema=schema)

    texts = docs.select("text").where("text is not null")
    marked = materialize(texts.mapInArrow(with_spans, "text string"), "with-spans")
    sample = first_by_hash(marked, F.col("text"), limit).unionByName(first_by_hash(texts, F.col("text"), limit))
    sample = materialize(sample, "labelled")
    windows = sample.mapInArrow(_training_windows, "values binary, tags binary").distinct().collect()  # from at most 2 * limit texts
    return fitted(sorted((bytes(r[0]), bytes(r[1])) for r in windows))


def found(col: pa.Array, field: Field | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points of all secrets in each text, in order. A span of
    the field that touches a base span adds nothing."""
    out = []
    for i, j, data, offsets in slices(col):
        texts = col.slice(i, j - i).to_pylist()
        rows = [[s[:3] for s in base_spans(t, h)] for t, h in zip(texts, holds_hex(data, offsets))]
        for row, a, b in field.spans(Tokens.of(data, offsets)) if field else ():
            start = len(bytes(data[offsets[row] : a]).decode())
            end = start + len(bytes(data[a:b]).decode())
            if all(end <= s or start >= e for s, k, e in rows[row] if k < 3):
                rows[row].append((start, 3, end))
        out += [sorted(r) for r in rows]
    return out


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``
    (doc_id, text). Null and empty texts have none; repeated rows and null ids are
    returned as they are; other columns are ignored."""
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            rows = found(text_column(batch), field)
            base = [[s for s in r if s[1] < 3] for r in rows]
            counts = [pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(_spelled(r).encode()).hexdigest() for r in base], pa.string())
            columns = [batch.column(0), *counts, digests, pa.array([_spelled(r) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    shape = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, shape)


def redacted(docs: DataFrame, field: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``, overlapping spans once;
    other columns, and null texts, stay as they are."""

    def cover(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i, j, _, _ in slices(text_column(batch)):
                part = batch.slice(i, j - i)
                texts = [cover(t, s) for t, s in zip(part.column(at).to_pylist(), found(text_column(part), field))]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
