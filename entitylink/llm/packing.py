"""Packing of token streams into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from entitylink.llm.bpe import encoder
from entitylink.llm.text import slices, text_column

WINDOW = 1024
# Open windows of a task at which they are settled early: at most 268 MB of ids.
OPEN_WINDOWS = 65_536


class Packer:
    """Windows of one stream of documents.

    A document's full windows stand alone. Its rest goes to the fill level, a new
    window included, where the sum over levels of (windows open at that level)**2
    becomes smallest; ties go to the fuller window. At the end the fuller of the windows
    left open keep their pieces and are filled up from the emptiest ones, and the last
    rest is cut at powers of two, which need no padding. ``moved`` counts the ids that
    left the window they were placed in.

    With ``open_windows`` windows open, which takes rests that hardly fit each other, they
    are settled the same way before the end, so a task's memory is bounded.
    """

    def __init__(self, stream: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window = window
        self.open_windows = open_windows
        self.n_open = self.moved = 0
        self.next_id = stream << 40
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self._close([(doc_id, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self._place((doc_id, whole, ids[whole:].copy(), len(ids)))

    def _place(self, piece: tuple) -> None:
        size, count = len(piece[2]), self.count
        # change of the sum of squares for each level h, h = 0 being a new window
        change = 2 * count[size:] + 1
        change[-1] = 0
        change[1:] -= 2 * count[1 : len(change)] - 1
        change[1:][count[1 : len(change)] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = self.open[level].pop() if level else []
        count[level] -= level > 0
        self.n_open -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        count[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.open_windows:
            self._settle(final=False)

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _settle(self, final: bool) -> None:
        """Close the open windows: the emptiest give their pieces to the fullest."""
        left = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        first, last = 0, len(left) - 1
        while first < last:
            filled, pieces = left[first]
            while filled < self.window and first < last:
                rest, giver = left[last]
                doc_id, start, ids, n = giver.pop()
                room = min(self.window - filled, len(ids))
                pieces.append((doc_id, start, ids[:room], n))
                filled, rest, self.moved = filled + room, rest - room, self.moved + room
                if room < len(ids):
                    giver.append((doc_id, start + room, ids[room:], n))
                left[last] = (rest, giver)
                last -= not rest
            left[first] = (filled, pieces)
            if filled == self.window:
                self._close(pieces)
                first += 1
        if first > last:
            return
        filled, pieces = left[first]
        if not final:
            self.open[filled].append(pieces)
            self.count[filled] = self.n_open = 1
            return
        while filled:
            size = 1 << (filled.bit_length() - 1)
            room, part = size, []
            while room:
                doc_id, start, ids, n = pieces.pop(0)
                part.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            self._close(part)
            filled -= size

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def finish(self) -> list[tuple]:
        self._settle(final=True)
        return self.take()


def packed(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids of each row of ``docs`` (doc_id, text) and ``end_id`` after them are packed
    into sequences of at most ``window``; every id lies in one piece. Each task packs
    the rows it reads, so nothing is shuffled and a lost task is repeated alone; windows it
    leaves open are settled among themselves and its rest is cut at powers of two, so no
    padding is left.

    Null or empty text is its end id alone. A null doc_id is carried as null, repeated
    rows are packed each. An empty table gives no rows. Other columns are ignored.
    ``sequence_id``: task number * 2**40 + count.
    """
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def table(rows):
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def run(batches):
        enc = encoder(path)
        packer = Packer(TaskContext.get().partitionId(), window)
        end = np.array([end_id], np.int32)
        for batch in batches:
            col, doc_ids = text_column(batch), batch.column(0).to_pylist()
            for i, j, _, _ in slices(col):
                ids, bounds = enc.ids(col.slice(i, j - i).to_pylist())
                for k in range(j - i):
                    packer.add(doc_ids[i + k], np.concatenate((ids[bounds[k] : bounds[k + 1]], end)))
                yield table(packer.take())
        enc.shrink()
        yield table(packer.finish())

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
