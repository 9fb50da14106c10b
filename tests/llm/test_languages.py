import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from entitylink.llm import languages
from tests.llm.helpers import awkward, documents

TONGUES = {
    "aa": ["banana", "lamana", "nalaba", "ana", "mabala", "balana", "ama"],
    "ee": ["tretre", "sterte", "erst", "estre", "reste", "terse", "tste"],
    "iø": ["kiøk", "øiki", "vikiø", "kivi", "øvik", "ikøv", "viø"],
}


def speak(lang, n, seed):
    own = random.Random(f"{lang}{seed}")
    return " ".join(own.choices(TONGUES[lang], k=n)).capitalize() + "."


def brute_grams(text):
    raw = b" " + b"".join(w + b" " for w in re.findall(rb"[a-zA-Z\x80-\xff]+", text.lower().encode()))
    if not raw.strip():
        return []
    out = []
    for k in range(len(raw) - languages.GRAM + 1):
        code = int.from_bytes(raw[k : k + languages.GRAM], "big")
        out.append((code * 2654435761 % 2**32) >> 17)
    return out


def model_of(spark, rows):
    return languages.trained(spark.createDataFrame(rows, "text string, lang string"), F.lit(True))


def training():
    return [(speak(lang, 40, k), lang) for lang in TONGUES for k in range(12)] + [("no lang", None), (None, "aa"), ("", "ee")]


def test_grams_are_all_there():
    texts = [t or "" for _, t in awkward()] + ["Ünï-Cödé 12x", "a", "ab", "-", "É"]
    for i, j, bucket, row in languages.grams(pa.array(texts), 1 << 16):
        for k in range(j - i):
            assert bucket[row == k].tolist() == brute_grams(texts[i + k])


def test_model_counts_everything(spark):
    model = model_of(spark, training())
    assert model.names == sorted(TONGUES) and model.names[model.usual] == "aa"
    for at, lang in enumerate(model.names):
        n = Counter(b for t, x in training() if x == lang for b in brute_grams(t or ""))
        total = sum(n.values()) + languages.SMOOTHING * languages.BUCKETS
        for b in np.flatnonzero(model.known):
            assert math.isclose(model.logs[b, at], math.log((n[b] + languages.SMOOTHING) / total))


def brute_mixture(grams, model, langs):
    """Proportions and log likelihood of a set of languages, one n-gram at a time."""
    like = [[math.exp(model.logs[b, x]) for x in langs] for b in grams if model.known[b]]
    share = [1 / len(langs)] * len(langs)
    for _ in range(500):
        new = [0.0] * len(langs)
        for p in like:
            mixed = [a * s for a, s in zip(p, share)]
            for x, m in enumerate(mixed):
                new[x] += m / sum(mixed)
        share = [x / len(like) for x in new]
    return share, sum(math.log(sum(a * s for a, s in zip(p, share))) for p in like)


def test_mixtures_equal_plain_em(spark):
    model = model_of(spark, training())
    texts = [speak("aa", 30, 1), speak("aa", 40, 2) + speak("ee", 25, 3), speak("ee", 9, 4) + speak("iø", 30, 5), " ".join(speak(x, 30, 9) for x in TONGUES), "kivi", "qqq zzz"]
    (_, _, bucket, row), = languages.grams(pa.array(texts), 1 << 20)
    chosen, every = languages.mixtures(bucket, row, len(texts), model)
    for k, text in enumerate(texts):
        grams = [b for b in brute_grams(text) if model.known[b]]
        if not grams:
            assert not chosen[k].any()
            continue
        share, _ = brute_mixture(grams, model, range(3))
        assert np.allclose(every[k], share, atol=0.02)
        # the set is the best of the nested ones it was chosen from
        order = sorted(range(3), key=lambda x: -share[x])
        worth = [brute_mixture(grams, model, order[:n])[1] / languages.GRAM - languages.PRICE * (n - 1) * math.log(len(grams) + 1) for n in (1, 2, 3)]
        size = 1
        while size < 3 and worth[size] > worth[size - 1]:
            size += 1
        assert sorted(np.flatnonzero(chosen[k])) == sorted(order[:size])
        if size > 1:
            assert np.allclose(chosen[k][order[:size]], brute_mixture(grams, model, order[:size])[0], atol=0.02)
    assert [int((c > 0).sum()) for c in chosen] == [1, 2, 2, 3, 1, 0]


def test_texts_that_did_not_teach(spark):
    model = model_of(spark, training())
    rows = [(k, speak(lang, n, 100 + k)) for k, (lang, n) in enumerate((x, n) for x in TONGUES for n in (2, 5, 50, 5000))]
    got = {r["doc_id"]: r for r in languages.identified(documents(spark, rows), model).collect()}
    want = [x for x in TONGUES for _ in range(4)]
    assert [got[k]["lang_pred"] for k in range(len(rows))] == want
    assert all(0 <= r["score"] <= 1 and abs(sum(x["share"] for x in r["languages"]) - 1) < 0.01 for r in got.values())


def test_awkward_texts(spark):
    model = model_of(spark, training())
    rows = awkward() + [(200, "12 34 -- !"), (201, "日本語"), (202, "—"), (203, "x")]
    got = languages.identified(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((i or -1) for i, _ in rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        und = not any(c.isalpha() for c in t or "")
        assert (by[i]["lang_pred"] == "und") == und and (by[i]["score"] == 0) == und and (by[i]["languages"] == []) == und
    assert by[203]["lang_pred"] == "aa" and by[203]["score"] == 1 / 3


def test_nothing_learnt_and_empty_tables(spark):
    none = model_of(spark, [])
    assert none.names == []
    assert [r["lang_pred"] for r in languages.identified(documents(spark, [(1, "some text"), (2, None)]), none).collect()] == ["und", "und"]
    assert languages.identified(documents(spark, []), model_of(spark, training())).count() == 0
    one = model_of(spark, [("banana", "aa")])
    assert [tuple(r)[:3] for r in languages.identified(documents(spark, [(1, "banana x")]), one).collect()] == [(1, "aa", 1.0)]


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(languages, "LANGUAGES", 2)
    model = model_of(spark, training() + [("banana", "zz")])
    assert model.names == ["aa", "ee"]
