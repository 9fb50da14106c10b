import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from entitylink.llm.bpe import Encoder
from entitylink.llm.packing import Packer, packed
from entitylink.llm.tokens import encoded, encoded_digests
from tests.llm.helpers import awkward, documents

TEXTS = [t or "" for _, t in awkward()] + [
    "<|endoftext|>x<|startoftext|> y <|ENDOFTEXT|>",
    "İstanbul ΣΑΣ ﬁ ẞ ǅ ²½ Ⅷ ١٢ é   x\x1c\x85y",
    "'S 's I'LL we've don't",
    "aaaaaaaaaaaaaaaaaaaaa =========== ababababab",
    "日本語 😀😀 👩‍👩‍👧 \x00 \x7f",
    "한국어 ไทย हिन्दी ª º µ ×÷",
    "  leading and trailing  ",
]


def noise(n=400):
    rng = random.Random(1)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGH '\n\t.,!?0123456789éüßñÀ日Σ😀́ ")
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_decoding_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, ours, texts = Tokenizer.from_file(path), Encoder(path), TEXTS + noise()
    ids, bounds, decoded = ours.encode_decode(texts)
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert own == want.ids
        assert decoded[k] == library.decode(own, skip_special_tokens=False)


def test_merges_whose_product_merged_earlier(tmp_path):
    """A vocabulary whose later merge feeds an earlier one is merged one place at a time."""
    import json

    from entitylink.llm.bpe import byte_symbols

    vocab = {s: i for i, s in enumerate(byte_symbols())}
    merges = [["y", "z"], ["x", "yz"], ["xyz", "x"], ["x", "y"], ["xy", "z"]]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = [spec["added_tokens"][0] | {"id": len(vocab)}]
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    library, ours = Tokenizer.from_file(str(path)), Encoder(str(path))
    texts = ["xyzxyzxyz", "xyxyz", "yzxyzx", "zzyx", "xyzxyxyzz" * 5]
    ids, bounds = ours.ids(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_encoded_table(spark):
    path, rows = public_tokenizers.path("word_bpe_49k.json"), awkward()
    library = Tokenizer.from_file(path)
    digests = encoded_digests(documents(spark, rows), path).collect()
    assert len(digests) == len(rows)
    for (i, t), r in zip(rows, digests):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["doc_id"] == i and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = encoded(documents(spark, rows[:4]), path).collect()
    assert [len(r["ids"]) for r in full] == [r["n_tokens"] for r in digests[:4]]
    assert encoded(documents(spark, []), path).count() == 0 and encoded_digests(documents(spark, []), path).count() == 0


def check_pieces(rows, streams, window):
    """Every id in one piece, gapless sequences, no padding but below powers of two."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, n, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, length, crc, n))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, ids in streams.items():
        at = 0
        for start, length, crc, n in sorted(by_doc[doc]):
            assert start == at and n == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.mark.parametrize("sizes", [[1], [1023, 1, 1024, 1025, 513, 513, 2, 700, 3000], [513] * 300, [700, 300, 24] * 50])
def test_packer_places_every_id_once(sizes):
    packer, streams = Packer(3), {k: list(range(k, k + n)) for k, n in enumerate(sizes)}
    for k, ids in streams.items():
        packer.add(k, np.array(ids, np.int32))
    rows = packer.finish()
    assert check_pieces(rows, streams, 1024) == 0


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(4)
    packer, levels = Packer(0, 64), {}
    for k in range(2000):
        size = rng.randint(1, 63)
        options = []
        for h in [0, *[h for h in levels if levels[h] and h + size <= 64]]:
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + size < 64:
                after[h + size] = after.get(h + size, 0) + 1
            options.append((sum(v * v for v in after.values()), -h, after))
        levels = min(options, key=lambda o: o[:2])[2]
        packer.add(k, np.arange(size, dtype=np.int32))
        assert {h: c for h, c in levels.items() if c} == {h: int(c) for h, c in enumerate(packer.count) if c}


@pytest.mark.parametrize("bound", [2, 5, 40])
def test_windows_settled_before_the_end(bound):
    """A small bound on the open windows changes where rests go, never what is packed."""
    rng = random.Random(bound)
    packer, streams = Packer(1, 64, bound), {k: list(range(rng.randint(1, 200))) for k in range(600)}
    for k, ids in streams.items():
        packer.add(k, np.array(ids, np.int32))
        assert packer.n_open == packer.count.sum() < bound
    assert check_pieces(packer.finish(), streams, 64) == 0 and not packer.n_open


def test_few_ids_leave_the_window_they_were_placed_in():
    """Over 8,000 texts with long-tailed lengths under 5 % of the ids move at the end."""
    rng = random.Random(9)
    packer, streams = Packer(0), {k: range(max(1, int(rng.lognormvariate(5.7, 1.0)))) for k in range(8000)}
    for k, ids in streams.items():
        packer.add(k, np.array(ids, np.int32))
    assert check_pieces(packer.finish(), {k: list(v) for k, v in streams.items()}, 1024) == 0
    assert packer.moved < 0.05 * sum(len(v) for v in streams.values())


def test_packed_table(spark):
    path, rows = public_tokenizers.path("byte_bpe_50k.json"), [r for k, r in enumerate(awkward()) if k != 10]
    library = Tokenizer.from_file(path)
    streams = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces = [tuple(r) for r in packed(documents(spark, rows).repartition(3), path).collect()]
    assert check_pieces(pieces, streams, 1024) == 0
    assert packed(documents(spark, []), path).count() == 0
    twice = packed(documents(spark, [(1, "a"), (1, "a")]), path).collect()
    assert sum(r["length"] for r in twice) == 4
