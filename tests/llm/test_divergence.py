import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from entitylink.llm import divergence

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, ranks=200):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(AZ) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}

        def p(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        shares = {s: p(own[s]) for s in sources}
        whole = p({t: sum(own[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o) for o in sources - {s}]
            terms = [((shares[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if own[s][t] and shares[s][t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def awkward(seed=4):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghé日" for b in "uvwxyzABC"]
    rows = [(None, None, None), ("en", "s0", ""), ("en", None, " \t 12 --"), ("xx", "s1", "only once"), ("en", "bare", None)]
    rows += [("en", "s0", "Repeat me. repeat ME")] * 3 + [(None, "s1", "a b c a")] * 3
    rows += [("de", f"s{k % 3}", " ".join(rng.choices(words, k=20_000))) for k in range(4)]
    for _ in range(150):
        s = rng.randrange(9)
        rows.append((rng.choice(["en", "en", "de"]), f"s{s}", "-".join(rng.choices(words[s : s + 40], k=rng.randint(1, 30)))))
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for name in ("term", "n", "docs", "g", "block", "rank", "doc_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_equals_brute_force(spark):
    rows = awkward()
    want = brute(rows)
    for block, tile in ((divergence.BLOCK, divergence.TILE), (16, 4)):
        got = divergence.audited(table(spark, rows), block=block, tile=tile).collect()
        assert sorted(map(tuple, got)) == want
    got = divergence.audited(table(spark, rows), min_docs=50, ranks=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50, 3)


def test_a_lang_without_kept_terms(spark):
    rows = [("en", "b", "one"), ("en", "a", "two"), ("en", "c", None)]
    got = sorted(map(tuple, divergence.audited(table(spark, rows)).collect()))
    assert got == brute(rows) and len(got) == 6 and {r[4] for r in got} == {0}


def test_empty_table(spark):
    assert divergence.audited(table(spark, [])).count() == 0


def test_tree_walk_equals_the_dense_sums(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(divergence, "FRONT", 50)
    for size, width, share, split in ((7, 30, 0.1, None), (1, 5, 0.5, None), (12, 3, 0.6, 8), (5, 100, 0.02, 4), (6, 9, 0.0, None)):
        n = rng.integers(1, 50, (size, width)) * (rng.random((size, width)) < share)
        totals = n.sum(1) + width
        r, c = np.nonzero(n)
        sums, seen = divergence.tile_sums(r, c, n[r, c], totals, split)
        p = 1 + 10**9 * (n + 1) // totals[:, None]
        for i in range(size):
            for j in range(size):
                crossing = i != j and (split is None or (i < split) != (j < split))
                some = (n[i] > 0) | (n[j] > 0)
                assert seen[i, j] == (some.sum() if crossing else 0)
                assert sums[i, j] == (((p[i] - p[j]) ** 2 // p[j])[some].sum() if crossing else 0)


def test_shares_are_exact():
    totals = np.array([1, 3, 7, 10**9 + 7, 9 * 10**15 - 1])
    n = np.array([0, 2, 5, 10**9, 8 * 10**15])
    assert divergence._shares(n, totals).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, totals)]
