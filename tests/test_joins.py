"""Filtered joins equal the brute-force comparison of all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylink import session
from entitylink.functions import strings, tokens
from entitylink.operators import editjoin, editprefix, setjoin, skew, tilejoin
from entitylink.operators.values import expand_links, value_members


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    words = ["red", "blue", "bolt", "bolts", "gear", "gears", "widget", "wigdet", "of", "the", "Ring", "rings", "a", "ab", "ba"]

    def text():
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        return t if rng.random() < 0.7 else t[: rng.randint(0, 4)]

    def df(n):
        return spark.createDataFrame([(i, text()) for i in range(n)], "id long, v string").cache()

    return df(60), df(70)


def brute(spark, sides, score, theta):
    s, t = sides
    x = s.select(F.col("id").alias("source"), F.col("v").alias("x"))
    y = t.select(F.col("id").alias("target"), F.col("v").alias("y"))
    rows = x.crossJoin(y).select("source", "target", score(F.col("x"), F.col("y")).alias("sim")).where(F.col("sim") >= theta)
    return {(r.source, r.target): round(r.sim, 9) for r in rows.collect()}


def expanded(links, sides, value="v"):
    s, t = sides
    out = expand_links(links, value_members(s, "id", value), value_members(t, "id", value))
    return {(r.source, r.target): round(r.sim, 9) for r in out.collect()}


def overlap(tok, sim):
    def score(x, y):
        p, q = tok(x), tok(y)
        o, n, m = F.size(F.array_intersect(p, q)).cast("double"), F.size(p), F.size(q)
        return F.when((n > 0) & (m > 0), sim(o, n, m))

    return score


SET = [
    (setjoin.jaccard_join, 0.5, overlap(tokens.bag, lambda o, n, m: o / (n + m - o))),
    (setjoin.cosine_join, 0.7, overlap(tokens.bag, lambda o, n, m: o / F.sqrt(n.cast("double") * m))),
    (setjoin.dice_join, 0.6, overlap(tokens.bag, lambda o, n, m: 2 * o / (n + m))),
    (setjoin.overlap_join, 3, overlap(tokens.bag, lambda o, n, m: o)),
    (setjoin.qgram_join, 0.4, overlap(tokens.qgrams, lambda o, n, m: o / (n + m - o))),
    (setjoin.bigram_dice_join, 0.6, overlap(tokens.padded_bigrams, lambda o, n, m: 2 * o / (n + m))),
]


@pytest.mark.parametrize("join,theta,score", SET, ids=lambda x: getattr(x, "__name__", ""))
def test_set_joins(spark, sides, join, theta, score):
    want = brute(spark, sides, score, theta)
    assert want and expanded(join(*sides, "id", "v", theta), sides) == want


@pytest.mark.parametrize("theta", [0.34, 0.5, 0.25, 0.9])
def test_levenshtein(spark, sides, theta):
    want = brute(spark, sides, lambda x, y: 1 / (1 + F.levenshtein(x, y)), theta)
    assert want and expanded(editjoin.levenshtein_join(*sides, "id", "v", theta), sides) == want


@pytest.mark.parametrize("theta", [0.6, 0.85])
def test_jaro(spark, sides, theta):
    want = brute(spark, sides, strings.jaro, theta)
    assert want and expanded(editjoin.jaro_join(*sides, "id", "v", theta), sides) == want


@pytest.mark.parametrize("theta", [0.65, 0.9])
def test_jaro_winkler(spark, sides, theta):
    f = strings.winkler_form
    want = brute(spark, sides, lambda x, y: strings.jaro_winkler(f(x), f(y)), theta)
    assert want and expanded(editjoin.jaro_winkler_join(*sides, "id", "v", theta), sides, f(F.col("v"))) == want


def test_ratcliff(spark, sides):
    want = brute(spark, sides, strings.ratcliff, 0.75)
    assert want and expanded(editjoin.ratcliff_join(*sides, "id", "v", 0.75), sides, F.lower("v")) == want


@pytest.mark.parametrize("theta", [0.6, 0.9])
def test_soundex(spark, sides, theta):
    c = strings.soundex_code
    want = brute(spark, sides, lambda x, y: 1 - strings.hamming(c(x), c(y), 6) / 6, theta)
    assert want and expanded(editjoin.soundex_join(*sides, "id", "v", theta), sides, c(F.col("v"))) == want


@pytest.mark.parametrize("theta", [0.6, 0.85])
def test_monge_elkan(spark, sides, theta):
    def score(x, y):
        p, q = (F.transform(tokens.blank_words(z), tokens.padded_bigrams) for z in (x, y))
        best = F.transform(p, lambda g: F.array_max(F.transform(q, lambda h: strings.dice(g, h))))
        return F.when((F.size(p) > 0) & (F.size(q) > 0), F.aggregate(best, F.lit(0.0), lambda m, g: m + g) / F.size(p))

    want = brute(spark, sides, score, theta)
    assert want and expanded(editjoin.monge_elkan_join(*sides, "id", "v", theta), sides) == want


def test_hot_keys_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(skew, "CHUNK", 3)
    monkeypatch.setattr(skew, "PARTS", 4)
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"v{i}") for i in range(40)], "id long, v string")
    links = setjoin.jaccard_join(hot, hot, "id", "v", 0.9)
    assert sum(r.n_source * r.n_target for r in links.collect()) == 14 * 14 + 26
    assert len(expanded(links, (hot, hot))) == 14 * 14 + 26


def test_result_does_not_depend_on_partitions(spark, sides):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(map(tuple, setjoin.jaccard_join(*sides, "id", "v", 0.5).collect()))

    assert run(1) == run(13)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("theta", [0.15, 0.3])
def test_levenshtein_of_short_values(spark, theta):
    """Values of 0 to 12 characters, many edits."""
    import random

    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))
    rows = [[(k, text()) for k in range(60)] for _ in range(2)]
    short = tuple(spark.createDataFrame(r, "id long, v string") for r in rows)
    want = brute(spark, short, lambda x, y: 1 / (1 + F.levenshtein(x, y)), theta)
    assert want and expanded(editjoin.levenshtein_join(*short, "id", "v", theta), short) == want


@pytest.mark.parametrize("theta", [0.2, 0.3, 0.5])
def test_levenshtein_of_edited_values(spark, theta):
    """Values of 5 to 90 characters, many repeated grams, next to copies with a few edits."""
    rng = random.Random(11)

    def edited(t):
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(t))
            t = rng.choice([t[:at] + t[at + 1 :], t[:at] + rng.choice("abz") + t[at:], t[:at] + rng.choice("abz") + t[at + 1 :]])
        return t

    first = ["".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.choice([5, 9, 12, 20, 50, 90]))) for _ in range(60)]
    rows = [list(enumerate(first)), list(enumerate(edited(t) for t in first))]
    both = tuple(spark.createDataFrame(r, "id long, v string") for r in rows)
    want = brute(spark, both, lambda x, y: 1 / (1 + F.levenshtein(x, y)), theta)
    assert len(want) > 20 and expanded(editjoin.levenshtein_join(*both, "id", "v", theta), both) == want


def test_grams_have_their_places(spark):
    rows = spark.createDataFrame([("aaab",), ("xy",), ("x",), ("",)], "v string")
    got = rows.select("v", editprefix.placed_grams(F.col("v"), 2).alias("g")).collect()
    assert {r.v: [(e.elem, list(e.places)) for e in r.g] for r in got} == {"aaab": [("aa", [0, 1]), ("aa.2", []), ("ab", [2])], "xy": [("xy", [0])], "x": [], "": []}


def test_least_edits(spark):
    """Against the smallest set of edited characters that meets all grams."""
    rng = random.Random(3)
    rows = [(q, sorted(rng.sample(range(9), rng.randint(0, 6)))) for q in (1, 2, 3) for _ in range(20)]

    def brute_force(q, places):
        for n in range(len(places) + 1):
            for at in itertools.combinations(range(12), n):
                if all(any(p <= c < p + q for c in at) for p in places):
                    return n

    for q in (1, 2, 3):
        mine = [p for r, p in rows if r == q]
        df = spark.createDataFrame([(p[::-1],) for p in mine], "p array<int>").select("p", editprefix.least_edits(F.col("p"), q).alias("n"))
        assert all(r.n == brute_force(q, sorted(r.p)) for r in df.collect())


@pytest.mark.parametrize("join,theta", [(setjoin.jaccard_join, 0.5), (setjoin.overlap_join, 3), (editjoin.jaro_join, 0.85), (editjoin.jaro_winkler_join, 0.9), (editjoin.ratcliff_join, 0.75)])
def test_pairs_are_not_shuffled(sides, join, theta):
    plan = join(*sides, "id", "v", theta)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "hashpartitioning(source" not in plan and "hashpartitioning(target" not in plan


@pytest.mark.parametrize("name,theta", [("jaccard", 0.4), ("cosine", 0.5), ("overlap", 4)])
def test_tiles_of_any_size_find_the_same(spark, monkeypatch, name, theta):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(1, 40))) for _ in range(160)]
    both = [spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 2 == k], "id long, v string") for k in (0, 1)]
    run = lambda: {tuple(r) for r in setjoin.set_join(*both, "id", "v", tokens.bag, setjoin.Measure(name, theta)).collect()}
    whole = run()
    monkeypatch.setattr(tilejoin, "PART", 512)
    monkeypatch.setattr(tilejoin, "LOOK", 0)
    assert whole and run() == whole
    monkeypatch.setattr(tilejoin, "LOOK", 1 << 30)
    monkeypatch.setattr(tilejoin, "TILE", 1 << 9)
    assert run() == whole


def test_expanded_pairs_are_grouped_only_for_entities_with_several_values(spark):
    one = spark.createDataFrame([(i, f"red w{i % 3}") for i in range(12)], "id long, v string")
    more = one.unionByName(spark.createDataFrame([(5, "red w0"), (6, "red w0"), (50, "blue")], one.schema))

    def run(s, t):
        links = setjoin.jaccard_join(s, t, "id", "v", 0.3)
        return expand_links(links, value_members(s, "id", "v"), value_members(t, "id", "v"))

    for s, t in itertools.product((one, more), repeat=2):
        got = run(s, t)
        assert ("max(sim" in got._jdf.queryExecution().optimizedPlan().toString()) == (s is more or t is more)
        want = {}
        for x, y in itertools.product(s.collect(), t.collect()):
            sim = 1.0 if x.v == y.v else 0.0 if "blue" in (x.v, y.v) else 1 / 3
            want[x.id, y.id] = max(want.get((x.id, y.id), 0), sim)
        rows = [((r.source, r.target), r.sim) for r in got.collect()]
        assert len(rows) == len(dict(rows)) and dict(rows) == {k: pytest.approx(v) for k, v in want.items() if v}


def test_bounds_before_scoring():
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ab cÜ1中") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 70])))
    x = [text() for _ in range(400)]
    y = [t if rng.random() < 0.1 else "".join(c for c in t if rng.random() < 0.8) or text() for t in x]
    for of, exact, theta in ((strings.jaro_of, strings._jaro, 0.8), (strings.ratcliff_of, strings._ratcliff, 0.75)):
        p, q = ([t.lower() for t in z] if of is strings.ratcliff_of else z for z in (x, y))
        want = [float(exact([a], [b])[0]) for a, b in zip(p, q)]
        assert [w if w >= theta else 0 for w in want] == [g if g >= theta else 0 for g in of(x, y, theta).tolist()]


def test_rows_of_a_tile_score_like_pairs():
    rng = random.Random(9)
    x, y = (["".join(rng.choice("ab cÜ1中") for _ in range(rng.choice([0, 1, 5, 30, 62, 63]))) for _ in range(n)] for n in (40, 90))
    y += [t[:20] + "b" + t[22:] for t in x if len(t) > 22]
    held = strings.JaroPairs(x, y, 0.6)
    i, j = np.divmod(np.arange(len(x) * len(y)), len(y))
    got = [s if s >= 0.6 else 0 for s in held(i, j).tolist()]
    want = [float(s) if s >= 0.6 else 0 for a in x for t in y for s in strings._jaro([a], [t])]
    assert held.fits and got == want and any(want)
    assert not strings.JaroPairs(x, [*y, "a" * 64], 0.6).fits


def test_monge_elkan_lists_no_pairs(spark, sides, monkeypatch):
    """Tiles of few values and few numbers held give the links of one tile; rows that are shuffled
    grow with the values, not with their pairs."""
    want = sorted(map(tuple, editjoin.monge_elkan_join(*sides, "id", "v", 0.6).collect()))
    monkeypatch.setattr(editjoin, "MONGE_SIDE", 20)
    monkeypatch.setattr(editjoin, "MONGE_PART", 1)
    monkeypatch.setattr(strings, "MONGE_HELD", 8)
    assert want and sorted(map(tuple, editjoin.monge_elkan_join(*sides, "id", "v", 0.6).collect())) == want
    monkeypatch.undo()
    same = spark.range(3000).select("id", F.concat_ws(" ", F.lit("the common words"), F.col("id").cast("string")).alias("v"))
    written = []
    monkeypatch.setattr(session, "ON_MATERIALIZE", [lambda df: written.append(df.count())])
    links = editjoin.monge_elkan_join(same, same, "id", "v", 0.99)
    assert links.where("source = target").count() == 3000 and max(written) <= 3000
