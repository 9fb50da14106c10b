import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from entitylink.llm import importance, text, vocab
from tests.llm.helpers import awkward, documents

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % importance.BUCKETS


def brute(rows, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    total = [sum(c.values()) + 10_000.0 for c in (s, t)]
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * total[0] / ((s[b] + 1.0) * total[1]))) for b in range(10_000)}
    out = []
    for i, x in rows:
        words, own = features(x)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), len(words), weight, score, None])
    able = sorted((r for r in out if r[0] is not None and r[2] >= least), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def test_crc_of_words_and_pairs():
    rng = random.Random(1)
    words = ["", "a", "é", "日本語" * 40, "x" * 63, "y" * 64, "z" * 65, "w" * 5000] + ["".join(rng.choices("abcdé", k=rng.randint(1, 90))) for _ in range(300)]
    crc, n = vocab.word_crcs(pa.array(words))
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in words] and n.tolist() == [len(w.encode()) for w in words]
    assert vocab.word_crcs(pa.array(words)[5:9])[0].tolist() == crc[5:9].tolist()
    a, b = np.array(rng.choices(range(len(words)), k=2000)), np.array(rng.choices(range(len(words)), k=2000))
    assert vocab.joined_crc(crc[a], crc[b], n[b]).tolist() == [zlib.crc32((words[i] + words[j]).encode()) for i, j in zip(a, b)]


def test_buckets_do_not_depend_on_the_head():
    texts = [t or "" for _, t in awkward()] + ["A" * 70_000 + " b", "x", "über Über 12 a-b"]
    heads = [importance.head_of([], []), importance.head_of(["the", "fox", "x", "日本語"], [("the", "fox"), ("fox", "the"), ("the", "the"), ("gone", "the")])]
    for head in heads:
        for i, j, data, offsets in text.slices(pa.array(texts), 1 << 20):
            words, pairs, first, before = importance.feature_buckets(data, offsets, head)
            for k in range(j - i):
                w, f = features(texts[i + k])
                assert words[first[k] : first[k + 1]].tolist() == [bucket(x) for x in w]
                assert pairs[before[k] : before[k + 1]].tolist() == [bucket(x) for x in f[len(w) :]]


def test_equals_brute_force(spark):
    rows = awkward() + [(100 + k, " ".join(f"w{k}x{i % 7}" for i in range(15 + k))) for k in range(20)]
    target = ["the quick brown fox likes strong tea", None, "", "w3x1 w3x2 the old stone bridge"]
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    columns = ("doc_id", "n_features", "n_words", "weight", "score", "rank")
    for percent, least in ((25, 20), (100, 1), (0, 20)):
        got = importance.resampled(documents(spark, rows), goal, percent, least).select(*columns).collect()
        want = brute(rows, target, percent, least)
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((r[:5] for r in want), key=repr)
        # rows of one tie may change places
        assert sorted((r["score"], r["doc_id"], r["rank"]) for r in got if r["rank"]) == sorted((r[4], r[0], r[5]) for r in want if r[5])


def test_empty_tables(spark):
    empty, goal = documents(spark, []), spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(empty, goal).count() == 0
    got = importance.resampled(documents(spark, [(1, "a b a"), (2, None)]), goal.where("false"), 100, 1).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in brute([(1, "a b a"), (2, None)], [])]
