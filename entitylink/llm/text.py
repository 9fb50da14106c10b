"""Words, word hashes and shingles of Arrow text columns, in NumPy.

A word is a run of bytes other than the six ASCII white-space bytes; A-Z count as
a-z. Nothing here makes a Python object per word: a column's bytes are hashed in
slices of about ``SLICE`` bytes (a longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SHINGLE = 5

_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4096), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 2 * SLICE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as plain strings; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.string()), "")


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in the bytes)."""
    if len(col) == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()  # a worker lives on; what it no longer needs goes back


# Anything but a letter of ASCII; bytes of other scripts count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it.
    ``apart``: for each byte value whether it separates words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = apart[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z as a-z."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_P_INVERSE, n)[starts])


def hashes_of(words: list[str]) -> np.ndarray:
    """``word_hashes`` of given words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in each row, repeats included, and the
    number before each row. A row with fewer words has its whole sequence as one
    shingle, a row without words none.

    ``first``: number of words before each row, and their total at the end.
    """
    lengths = np.diff(first)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if bounds[-1] == 0:
        return np.zeros(0, np.uint64), bounds
    step = _power(0xD6E8FEB86659FD93, size)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    runs = words * step[0]
    for j in range(1, size):
        runs = runs + padded[j : j + len(words)] * step[j]
    at = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    out = runs[at] + _U(size)
    for r in np.flatnonzero((lengths > 0) & (lengths < size)):
        w = words[first[r] : first[r + 1]]
        out[bounds[r]] = (w * step[: len(w)]).sum(dtype=np.uint64) + _U(len(w))
    return mix(out), bounds


def row_shingles(col: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, bounds by row) for each slice of the column."""
    for i, _, data, offsets in slices(col):
        starts, ends, first = word_bounds(data, offsets)
        yield i, *shingle_hashes(word_hashes(data, starts, ends), first, size)
