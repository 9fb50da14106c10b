"""Byte-pair encoding of whole columns by batched merge rounds.

Every distinct pre-token is encoded once per task. The symbols of all new ones lie
in one flat array; in each round every word merges its lowest-ranked pair (all
places of it), ranks being found by binary search over the sorted pair keys.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from itertools import chain, islice

import numpy as np
import regex

_NONE = np.int64(2**62)
# Words remembered by a worker, and how many of them, the first met and so mostly the
# common ones, when it has too many or a task ends; bounds its memory, not its results.
REMEMBERED, KEPT = 200_000, 50_000

# The pre-token patterns of the two public vocabularies (fixed values). "Letter" and
# "digit" are filled in for plain Latin text and in full.
_WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_LATIN = {"L": "A-Za-zÀ-ÖØ-öø-ÿ", "N": "0-9", "S": r" \t\n\r\x0b\x0c"}
_FULL = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
_NOT_LATIN = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]").search
_SPACES = regex.compile(r"\p{White_Space}+")
_CASED = re.compile("[A-ZÀ-ÖØ-Þ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Numbers(dict):
    """Numbers words in the order they come; ``new`` lists those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """A byte-level BPE read from a public tokenizer file.

    ``ids``: token ids of texts, equal to the library's with add_special_tokens off,
    so the text of a special token gives its id.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.word_end = bool(model["end_of_word_suffix"])
        suffix = model["end_of_word_suffix"] or ""
        names = sorted(self.vocab.items(), key=lambda kv: kv[1])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [k for k, _ in names]
        self.names += [k for k, v in sorted(self.special.items(), key=lambda kv: kv[1]) if v >= len(names)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pieces = _WORD_PIECES if self.word_end else _BYTE_PIECES
        fill = lambda chars: re.sub(r"\{(.)\}", lambda m: chars[m[1]], pieces)
        self.latin = re.compile(fill(_LATIN)).findall
        self.full = regex.compile(fill(_FULL)).findall
        symbols = byte_symbols()
        self.first = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + suffix] for s in symbols], np.int64)
        left, right = zip(*(m if isinstance(m, list) else m.split(" ") for m in model["merges"]))
        keys = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in zip(left, right)], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in zip(left, right)], np.int64)
        # A merge whose product takes part in an earlier merge is done one place at a time.
        least = np.full(len(names) + 1, _NONE)
        for side in (left, right):
            np.minimum.at(least, [self.vocab[x] for x in side], np.arange(len(left)))
        self.one_place = least[self.merged] < np.arange(len(left))
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.known = Numbers()
        self.spelled: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)

    def shrink(self) -> None:
        """Keep the first KEPT words."""
        if len(self.known) > KEPT:
            first = Numbers()
            first.update(islice(self.known.items(), KEPT))
            self.known, self.bounds = first, self.bounds[: KEPT + 1].copy()
            self.flat = self.flat[: self.bounds[-1]].copy()
            del self.spelled[KEPT:]

    def _pieces(self, text: str) -> list[str]:
        plain = _NOT_LATIN(text) is None
        if self.word_end:
            if not plain:
                text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
                # one character at a time: no context-dependent final sigma
                text = "".join(map(str.lower, text))
                plain = _NOT_LATIN(text) is None
            elif _CASED.search(text):
                text = text.lower()
        return (self.latin if plain else self.full)(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; the text of a special token stands for itself."""
        parts = self.split_special.split(text) if "<|" in text else (text,)
        if len(parts) == 1:
            return self._pieces(text)
        return [w for p in parts for w in ((p,) if p in self.special else self._pieces(p))]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the bounds of each."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.first[data]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            key = (ids[:-1] << 20) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(ids)))
            hit = (rank == np.repeat(best, size)) & (rank < _NONE)
            once = hit & self.one_place[np.where(hit, rank, 0)]
            if once.any():
                first = np.where(once, np.arange(len(hit)), len(hit))
                hit &= ~once | (np.arange(len(hit)) == np.repeat(np.minimum.reduceat(first, starts), size))
            # of overlapping places (a run of one pair) every other one merges, from the left
            again = hit & np.append(False, hit[:-1])
            if again.any():
                index = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~again, index, 0))
                hit &= (index - run) % 2 == 0
            ids = np.where(hit, self.merged[np.where(hit, rank, 0)], ids)
            gone = np.append(False, hit[:-1])
            live = np.repeat(best < _NONE, size)
            keep = ~gone
            done = keep & ~live
            if done.any():
                finished.append((word[done], ids[done]))
            keep &= live
            ids, word = ids[keep], word[keep]
        word = np.concatenate([f[0] for f in finished]) if finished else np.zeros(0, np.int64)
        flat = np.concatenate([f[1] for f in finished]) if finished else np.zeros(0, np.int64)
        flat = flat[np.argsort(word, kind="stable")].astype(np.int32)
        return flat, np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))))

    def _learn(self, words: list[str]) -> None:
        flat, bounds = self.merge([w for w in words if w not in self.special])
        parts, lengths, k = [], [], 0
        if any(w in self.special for w in words):
            for w in words:
                ids = np.array([self.special[w]], np.int32) if w in self.special else flat[bounds[k] : bounds[k + 1]]
                k += w not in self.special
                parts.append(ids)
                lengths.append(len(ids))
            flat, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))
        self.bounds = np.concatenate((self.bounds, bounds[1:] + len(self.flat)))
        self.flat = np.concatenate((self.flat, flat))

    def index(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Numbers of the pre-tokens of each text, and the same in one array."""
        if len(self.known) > REMEMBERED:
            self.shrink()
        number = self.known.__getitem__
        rows = [list(map(number, self.words(t))) for t in texts]
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        return rows, np.array(list(chain.from_iterable(rows)), np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and the bounds of each text."""
        return self._gather(*self.index(texts))

    def _gather(self, rows: list[list[int]], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = self.bounds[numbers], self.bounds[numbers + 1] - self.bounds[numbers]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[at], ends[np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)]

    def encode_decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """As ``ids``, and the text the ids decode to, special tokens included."""
        rows, numbers = self.index(texts)
        ids, bounds = self._gather(rows, numbers)
        if not self.word_end:
            return ids, bounds, [self.decode(ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        for k in range(len(self.spelled), len(self.known)):
            self.spelled.append(" ".join([self.names[i] for i in self.flat[self.bounds[k] : self.bounds[k + 1]].tolist()]))
        spelled = self.spelled.__getitem__
        return ids, bounds, [" ".join(map(spelled, r)) for r in rows]

    def decode(self, ids) -> str:
        """Tokens joined by a space where words carry an end mark, else the bytes they stand for."""
        names = [self.names[i] for i in ids]
        if self.word_end:
            return " ".join(names)
        return b"".join(map(self._bytes, names)).decode("utf-8", "replace")

    def _bytes(self, name: str) -> bytes:
        known = all(c in self.byte_of for c in name)
        return bytes(self.byte_of[c] for c in name) if known else name.encode()


@cache
def encoder(path: str) -> Encoder:
    """One encoder per file and worker."""
    return Encoder(path)
