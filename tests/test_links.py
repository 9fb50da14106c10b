import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entitylink.operators import editjoin, learn, values
from entitylink.operators import evaluate as ev
from entitylink.operators import links as lk


def links(spark, rows):
    return spark.createDataFrame(list(rows), "source long, target string, sim double")


def rows(df):
    return {(r.source, r.target, round(r.sim, 9)) for r in df.collect()}


def pairs(df):
    return {(r.source, r.target) for r in df.collect()}


@pytest.fixture(scope="module")
def ab(spark):
    return links(spark, [(1, "a", 0.9), (1, "b", 0.5)]), links(spark, [(1, "a", 0.7), (2, "c", 0.8)])


def test_algebra(ab):
    a, b = ab
    assert rows(lk.links_and(a, b)) == {(1, "a", 0.7)}
    assert rows(lk.links_or(a, b)) == {(1, "a", 0.9), (1, "b", 0.5), (2, "c", 0.8)}
    assert rows(lk.links_minus(a, b)) == {(1, "b", 0.5)}
    assert rows(lk.links_xor(a, b)) == {(1, "b", 0.5), (2, "c", 0.8)}
    assert rows(lk.links_add(a, b, 0.5, 0.5, 0.8)) == {(1, "a", 0.8)}
    assert rows(lk.links_mult(a, b, 1.0, 1.0, 0.6)) == {(1, "a", 0.63)}
    assert rows(lk.threshold(a, 0)) == rows(a)


def test_best(spark):
    tied = links(spark, [(1, "a", 0.9), (1, "b", 0.9), (1, "c", 0.2)])
    assert pairs(lk.best_one_to_n(tied)) == {(1, "a"), (1, "b")}
    assert pairs(lk.best_target(tied)) == {(1, "a")}
    contested = links(spark, [(1, "a", 0.9), (1, "b", 0.8), (2, "a", 0.95)])
    assert pairs(lk.best_one_to_one(contested)) == {(2, "a")}


LINKS = st.dictionaries(st.tuples(st.integers(0, 3), st.sampled_from("abc")), st.sampled_from([0.25, 0.5, 1.0]), max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(LINKS, LINKS)
def test_laws(spark, x, y):
    a, b = (links(spark, [(s, t, v) for (s, t), v in d.items()]) for d in (x, y))
    both, either = set(x) & set(y), set(x) | set(y)
    assert pairs(lk.links_and(a, b)) == both and pairs(lk.links_or(a, b)) == either
    assert pairs(lk.links_xor(a, b)) == either - both and pairs(lk.links_minus(a, b)) == set(x) - set(y)


def test_prf(spark):
    p, g = links(spark, [(1, "a", 1.0), (2, "b", 1.0)]), links(spark, [(1, "a", 1.0), (3, "c", 1.0)])
    r = ev.prf(p, g).collect()[0]
    assert (r.tp, r.precision, r.recall, r.f) == (1, 0.5, 0.5, 0.5)
    assert ev.prf(p.where("source > 9"), g).collect()[0].f == 0.0


def test_undirected(spark):
    p = spark.createDataFrame([(1, 2), (3, 4)], "source long, target long")
    g = spark.createDataFrame([(2, 1), (5, 6)], "source long, target long")
    assert tuple(ev.prf_undirected(p, g).collect()[0]) == (0.5, 0.5, 0.5)


def test_pseudo_f(spark):
    p = links(spark, [(1, "a", 1.0), (1, "b", 1.0)])
    src = spark.createDataFrame([(1,), (2,)], "id long")
    tgt = spark.createDataFrame([("a",), ("b",)], "id string")
    assert tuple(ev.pseudo_f(p, src, tgt, "id").collect()[0]) == (0.75, 0.75, 0.75)


def test_link_statistics(spark):
    result = links(spark, [(1, "a", 1.0), (2, "x", 1.0), (7, "q", 1.0)])
    gold = links(spark, [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 1.0)])
    r = ev.link_statistics(result, gold).collect()[0]
    assert (r.links, r.gold, r.true_links, r.false_links, r.missed_links) == (3, 3, 1, 1, 2)
    assert r.recall_percent == pytest.approx(100 / 3)
    assert pairs(ev.missed_links(result, gold)) == {(2, "b"), (3, "c")}


def test_sweep_keeps_the_best(spark):
    scored = links(spark, [(1, "a", 0.9), (2, "b", 0.8), (3, "x", 0.3), (4, "y", 0.2)])
    gold = links(spark, [(1, "a", 1.0), (2, "b", 1.0)])
    best = learn.threshold_sweep(scored, gold, [0.1, 0.5, 0.85]).where("best").collect()
    assert [(r.theta, r.f) for r in best] == [(0.5, 1.0)]


def test_controversy(spark):
    votes = spark.createDataFrame(
        [(1, "a")] * 2 + [(1, "b")] * 4 + [(2, "c")] * 1 + [(3, "d")] * 2, "source long, target string"
    )
    asked = spark.createDataFrame([(3, "d")], "source long, target string")
    got = learn.controversy(votes, 4, 5, asked).collect()
    assert [(r.source, r.target, r.sim) for r in got] == [(1, "a", 0.5), (2, "c", 0.25)]


@pytest.mark.parametrize("join", [lk.links_or, lk.links_xor])
def test_many_links_are_grouped_in_more_parts(spark, monkeypatch, join):
    sides = [spark.createDataFrame([(i, i * j % 7, j / 10) for i in range(n) for j in (1, 2)], "source long, target long, sim double") for n in (30, 20)]
    a, b = map(lk.unique_links, sides)
    few = sorted(map(tuple, join(a, b).collect()))
    monkeypatch.setattr(lk, "GROUPED", 5)
    a, b = map(lk.unique_links, sides)
    assert a.rdd.getNumPartitions() == 12 and b.rdd.getNumPartitions() == 8
    many = join(a, b)
    assert many.rdd.getNumPartitions() > 12 and sorted(map(tuple, many.collect())) == few and few


@pytest.mark.parametrize("many", [False, True])
def test_rank_joins_counts_pairs_behind_value_links(spark, many, monkeypatch):
    """Against all pairs listed; entities with several values or keys included. Without them no pair is listed."""
    names = ["ann", "anne", "bob", "rob", "zoe"]
    sides = []
    for shift in (0, 1):
        props = [(i, "name", names[(i * (shift + 2)) % 5]) for i in range(20)]
        keys = [(i, "k%d" % (i % 4)) for i in range(18)]
        if many:
            props += [(3, "name", "bob"), (4, "name", "annie")]
            keys += [(5, "k3")] * (shift + 1)
        sides.append((props, keys))
    src, tgt = (spark.createDataFrame(p, "id long, prop string, value string") for p, _ in sides)
    gold = [spark.createDataFrame(k, "id long, key string") for _, k in sides]
    right = {(i, j) for i, a in sides[0][1] for j, b in sides[1][1] if a == b}
    best = {}
    for i, _, a in sides[0][0]:
        for j, _, b in sides[1][0]:
            d = editdistance(a, b)
            if d <= 3:
                best[i, j] = max(best.get((i, j), 0), 1 / (1 + d))
    rated = []
    for theta in (0.25, 0.5, 1.0):
        found = {p for p, sim in best.items() if sim >= theta}
        p, r = len(found & right) / len(found), len(found & right) / len(right)
        rated.append((2 * p * r / (p + r), theta, p, r))
    f, theta, p, r = max(rated)
    listed = []
    expanded = values._expanded
    monkeypatch.setattr(values, "_expanded", lambda *a: listed.append(1) or expanded(*a))
    measures = {"levenshtein": editjoin.levenshtein_join}
    for form in (tuple(gold), spark.createDataFrame(sorted(right), "source long, target long")):
        (got,) = learn.rank_joins(src, tgt, form, measures, [0.25, 0.5, 1.0]).collect()
        assert (got.rule, got.theta) == ("levenshtein(name,name)", theta)
        assert (got.precision, got.recall, got.f) == pytest.approx((p, r, f))
    assert bool(listed) == many


def editdistance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]
