"""Small awkward tables shared by the tests."""

import random

from pyspark.sql import functions as F

BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a fresh pot of very strong tea near the old stone bridge"


def documents(spark, rows):
    """rows: (doc_id, text). Extra columns carry names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "n", "component", "range", "score", "kept", "held_out", "unit", "group", "shard", "n_shingles"):
        df = df.withColumn(name, F.lit("x"))
    return df


def awkward(seed=5):
    """Nulls, blanks, repeated rows, ties, a very long text and near copies."""
    rng = random.Random(seed)
    words = BASE.split()
    rows = [(1, BASE), (2, BASE.upper()), (3, BASE + " today"), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "One  two"), (None, "no id at all here today")]
    rows += [(9, " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(30_000))), (1, BASE), (10, "ünïcödé ßtraße 日本語 😀   x")]
    for k in range(11, 60):
        own = BASE.split()
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words) + "x"
        rows.append((k, " ".join(own) + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))))
    return rows


def shingles(text):
    """Brute-force 5-word shingle set."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(rows, percent=75):
    """doc_id -> (set size, smallest id reachable), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    x, y = sorted((root(a), root(b)))
                    least[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}
