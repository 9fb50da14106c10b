"""Words of Arrow text columns as exact codes into their distinct strings, and CRC-32
of words and word pairs in NumPy."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from entitylink.llm.text import word_bounds

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint32


def word_codes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of every word, distinct words with A-Z as a-z, number of words before each row).

    ``data`` and ``offsets`` as ``text.slices`` gives them; ``apart`` says for each byte
    value whether it separates words. Words are told apart by their bytes, not by hashes.
    """
    starts, ends, first = word_bounds(data, offsets, apart)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    letters = _LOWER[data[~apart[data]]] if len(data) else np.zeros(0, np.uint8)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)])
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, first


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> _U(1)) ^ _U(0xEDB88320), table >> _U(1))  # the CRC-32 polynomial
    return table


_TABLE = _crc_table()
# Word lengths with a shift table of their own; longer ones are shifted in steps.
NEAR = 64


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC becomes when n zero bytes follow."""
    tables = np.empty((NEAR, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, NEAR):
        tables[n] = (tables[n - 1] >> _U(8)) ^ _TABLE[tables[n - 1] & _U(255)]
    return tables


_SHIFT = _shift_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs moved over ``n`` < NEAR further bytes."""
    out = _SHIFT[n, 0, crc & _U(255)]
    for k in range(1, 4):
        out ^= _SHIFT[n, k, (crc >> _U(8 * k)) & _U(255)]
    return out


def joined_crc(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC of a string of CRC ``left`` followed by one of CRC ``right`` and ``n`` bytes."""
    far = np.flatnonzero(n >= NEAR)
    out = _shifted(left, np.where(n < NEAR, n, 0))
    if len(far):
        # doubling steps: the tables of 2**j bytes
        step, part, bits = _SHIFT[1], left[far], n[far].copy()
        while bits.any():
            moved = step[0][part & _U(255)] ^ step[1][(part >> _U(8)) & _U(255)] ^ step[2][(part >> _U(16)) & _U(255)] ^ step[3][part >> _U(24)]
            part = np.where(bits & 1, moved, part)
            bits >>= 1
            step = step[0][step & _U(255)] ^ step[1][(step >> _U(8)) & _U(255)] ^ step[2][(step >> _U(16)) & _U(255)] ^ step[3][step >> _U(24)]
        out[far] = part
    return out ^ right


def word_crcs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and byte length of every string, read byte by byte."""
    if len(words) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    n = np.diff(offsets)
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    active = np.flatnonzero((n > 0) & (n < NEAR))
    for place in range(NEAR):
        active = active[n[active] > place]
        if not len(active):
            break
        crc[active] = (crc[active] >> _U(8)) ^ _TABLE[(crc[active] ^ data[offsets[active] + place]) & _U(255)]
    crc ^= _U(0xFFFFFFFF)
    for i in np.flatnonzero(n >= NEAR):
        crc[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]])
    return crc, n
