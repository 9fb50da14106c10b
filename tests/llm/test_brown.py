import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from entitylink.llm import brown
from entitylink.llm.toxicity import held_out
from tests.llm.helpers import awkward, documents


def corpus():
    """Two "languages" whose words never mix, in documents of their own."""
    rng = random.Random(6)
    kinds = ([f"ab{c}" for c in "cdefgh"], [f"xy{c}" for c in "zuvwrs"])
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(rng.randint(5, 60)))) for k in range(100, 260)]
    return awkward() + rows


def test_base_scores_and_counts(spark):
    rows = corpus()
    counts = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), "end"] for _, t in rows]
    for (i, _), ws in zip(rows, tokens):
        if not out(i):
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    got = brown.scored(documents(spark, rows), held_out(parts=7, part=2)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), out(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(rows, tokens))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    text = [r for r in got if r["held_out"] and r["doc_id"] >= 100]
    assert len(text) > 10 and sum(r["score"] for r in text) > sum(r["base_score"] for r in text)


def test_exchange_separates_the_languages(spark, monkeypatch):
    monkeypatch.setattr(brown, "CLASSES", 4)
    docs = documents(spark, corpus()[-160:]).select("doc_id", "text")
    parts = docs.select("text").mapInArrow(brown._count_words, "word long, grp int, n long")
    counts = parts.groupBy("word").agg(F.max("grp").alias("grp"), F.sum("n").alias("n"))
    v = brown._vocabulary(counts)
    rows = docs.withColumn("held_out", F.lit(False)).mapInArrow(*brown._encode(v))
    classes = np.zeros(v.units, np.int64)
    classes[: brown.GROUPS] = 1
    classes[brown.GROUPS + 1 :] = 1 + np.arange(v.units - brown.GROUPS - 1) % (brown.CLASSES - 1)

    def likelihood(left):
        pairs = np.zeros((brown.CLASSES, brown.CLASSES))
        np.add.at(pairs.T, classes, left.astype(float))
        return brown._xlogx(pairs).sum() - brown._xlogx(pairs.sum(axis=0)).sum() - brown._xlogx(pairs.sum(axis=1)).sum()

    left, right, self_ = brown._contexts(rows, classes, v.units)
    assert left.sum() == right.sum() == v.tokens
    before = likelihood(left)
    for _ in range(3):
        classes, _ = brown.exchange(classes, left, right, self_)
        left, right, self_ = brown._contexts(rows, classes, v.units)
    assert likelihood(left) > before
    first = {int(h): int(u) for h, u in zip(v.words, v.unit)}
    from entitylink.llm.text import hashes_of

    kinds = [{classes[first[int(h)]] for h in hashes_of([f"{p}{c}" for c in s])} for p, s in (("ab", "cdefgh"), ("xy", "zuvwrs"))]
    assert not kinds[0] & kinds[1]


def test_probabilities_of_a_step_sum_to_one():
    """All known words and one unseen, over all classes, after any class."""
    pairs = np.array([[0.0, 3, 1], [2, 5, 0], [2, 0, 4]])
    of_class = pairs.sum(axis=0)
    share = (of_class + 1) / (of_class.sum() + 3)
    moves = (pairs + brown.BACKING * share) / (pairs.sum(axis=1, keepdims=True) + brown.BACKING)
    assert np.allclose(moves.sum(axis=1), 1)


def test_nothing_to_learn_from(spark):
    got = brown.scored(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert brown.scored(documents(spark, []), F.lit(False)).count() == 0


def test_scores_equal_the_class_model_in_plain_python(spark, monkeypatch):
    """Given the classes found, every score by hand, over words of their own and words that
    share a group, known and unknown."""
    from entitylink.llm.text import hashes_of

    found = []
    exchange = brown.exchange
    monkeypatch.setattr(brown, "UNIT_SHARE", 0.0005)
    monkeypatch.setattr(brown, "CLASSES", 5)
    monkeypatch.setattr(brown, "exchange", lambda *a: found.append(exchange(*a)) or found[-1])
    rng = random.Random(8)
    rare = [f"r{a}{b}" for a in "abcdef" for b in "ghij"] + ["q", "é"]
    rows = corpus() + [(k, " ".join(rng.choice(rare + ["abc", "Xyz"]) for _ in range(rng.randint(1, 30)))) for k in range(300, 340)]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    space = {9, 10, 11, 12, 13, 32}

    def words(t):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return bytes(32 if c in space else c for c in raw).split(b" ")

    tokens = [[*(w for w in words(t) if w), None] for _, t in rows]
    train = [ws for (i, _), ws in zip(rows, tokens) if not out(i)]
    counts = Counter(w for ws in train for w in ws)
    n = sum(counts.values())
    own = [w for w in counts if w is not None and counts[w] >= n * brown.UNIT_SHARE]
    hashed = {w: int(hashes_of([w.decode()])[0]) for w in own}
    unit = {w: brown.GROUPS + 1 + k for k, w in enumerate(sorted(own, key=hashed.get))}
    unit[None] = brown.GROUPS
    grouped = [w for w in counts if w not in unit]
    assert own and len(grouped) > 10
    got = brown.scored(documents(spark, rows), held_out(parts=7, part=2)).collect()
    classes = [int(c) for c in found[-1][0]]
    assert len(set(classes[brown.GROUPS + 1 :])) > 1

    def cls(w):
        group = lambda: (w[-1] * 37 + (w[-2] if len(w) > 1 else 0)) % brown.GROUPS
        return classes[unit[w] if w in unit else group()]

    pairs, size, distinct = Counter(), Counter(), Counter()
    for ws in train:
        for a, b in zip([None, *ws], ws):
            pairs[cls(a), cls(b)] += 1
            size[cls(b)] += 1
    for w in counts:
        distinct[cls(w)] += 1
    k = brown.CLASSES
    leaving = Counter()
    for (a, _), c in pairs.items():
        leaving[a] += c

    def score(ws):
        total = 0.0
        for a, b in zip([None, *ws], ws):
            x, y = cls(a), cls(b)
            share = (size[y] + 1) / (n + k)
            total += math.log10((pairs[x, y] + share) / (leaving[x] + 1)) + math.log10((counts[b] + 1) / (size[y] + distinct[y] + 1))
        return total

    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == sorted((str(i), round(score(ws), 6)) for (i, _), ws in zip(rows, tokens))
