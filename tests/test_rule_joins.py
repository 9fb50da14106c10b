"""Rules as joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from entitylink.functions import rules, strings
from entitylink.operators import entities as en
from entitylink.plans import linker, rule_joins
from entitylink.plans.rule_joins import And, Atom, Minus, Or, Xor, link_by_rule, rule_pairs

NAMES = ["martha stone", "marhta stone", "martha stones", "dixon", "dickson", "cold widget", "cold gadget", "blue widget", "", None]


def people(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(NAMES), rng.choice(["1999", "2000", "2001", None]), rng.choice(["a", "b"])) for i in range(n)]
    rows += [(0, "dixon", "1999", "a"), (0, "dixon", "1999", "a")]  # several rows of one entity, one repeated
    return spark.createDataFrame(rows, "id long, name string, year string, city string")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rule, x, y):
    """Similarity of two rows, 0 where the rule does not hold."""
    if isinstance(rule, Atom):
        a, b = x[rule.prop], y[rule.prop]
        if a is None or b is None:
            return 0.0
        sim = 1 / (1 + edits(a, b)) if rule.measure == "levenshtein" else float(a == b)
        return sim if sim >= rule.theta else 0.0
    sims = [brute(p, x, y) for p in rule.parts]
    if isinstance(rule, Or):
        return max(sims)
    if isinstance(rule, Minus):
        return 0.0 if any(sims[1:]) else sims[0]
    if isinstance(rule, Xor):
        return max(sims) if (sims[0] > 0) != (sims[1] > 0) else 0.0
    return min(sims)


NAME, YEAR, CITY = Atom("levenshtein", "name", 0.3), Atom("exact", "year", 1.0), Atom("exact", "city", 1.0)


@pytest.mark.parametrize("rule", [NAME, And(NAME, YEAR), And(NAME, Or(YEAR, CITY)), Or(And(NAME, CITY), YEAR), Minus(NAME, YEAR, CITY), And(NAME, Xor(YEAR, CITY))], ids=range(6))
def test_pairs_equal_all_pairs(spark, rule):
    s, t = people(spark, 1, 25).dropDuplicates(["id"]), people(spark, 2, 30).dropDuplicates(["id"])
    got = {(r.source, r.target): r.sim for r in rule_pairs(rule, s, t, "id").collect()}
    want = {(x.id, y.id): brute(rule, x, y) for x in s.collect() for y in t.collect()}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("purging", [True, False])
def test_best_targets_equal_the_blocked_job(spark, purging):
    """The same links as by listing every pair of every kept block."""
    s, t = people(spark, 3, 60), people(spark, 4, 60)
    text = F.concat_ws(" ", "name", "year", "city")
    same = F.when(F.col("year_s") == F.col("year_t"), 1.0).otherwise(0.0)
    rule = rules.all_of(rules.atom(strings.jaro("name_s", "name_t"), 0.7), rules.atom(same, 1.0))
    want = sorted(map(tuple, linker.link(s, t, "id", text, rule, 0.7, purging).collect()))
    got = link_by_rule(s, t, "id", And(Atom("jaro", "name", 0.7), YEAR), 0.7, text, purging).select("source", "target", "sim")
    assert sorted(map(tuple, got.collect())) == want and want


def test_equal_entities_are_one_until_the_pairs_are_found(spark, monkeypatch):
    """Copies make no pairs inside a rule; an entity with several rows is none."""
    s, t = (spark.createDataFrame([(i, "a", str(i % 2)) for i in range(20)] + [(99, "a", "0"), (99, "b", "1")], "id long, name string, year string") for _ in "st")
    inner, seen = rule_joins._rule_pairs, []
    monkeypatch.setattr(rule_joins, "_rule_pairs", lambda *p: seen.append(inner(*p)) or seen[-1])
    got = {(r.source, r.target): r.sim for r in rule_pairs(And(NAME, YEAR), s, t, "id").collect()}
    values = {i: ({"a"}, {str(i % 2)}) for i in range(20)} | {99: ({"a", "b"}, {"0", "1"})}
    want = {(i, j) for i, x in values.items() for j, y in values.items() if x[0] & y[0] and x[1] & y[1]}
    assert got == dict.fromkeys(want, 1.0)
    assert max(df.count() for df in seen) <= 9


def test_triples_are_linked_by_a_rule_without_listing_blocks(spark, monkeypatch):
    """A rule given as joins finds what the same rule finds as a column, and no block lists its pairs."""
    sides = [en.to_triples(people(spark, k, 40).where("name is not null and year is not null").dropDuplicates(["id"]), "id", ["name", "year"], "urn:P", "urn:") for k in (3, 4)]
    side = linker.Side("urn:P", {"urn:name": ("name", []), "urn:year": ("year", [])})
    same = F.when(F.col("year_s") == F.col("year_t"), 1.0).otherwise(0.0)
    column = rules.all_of(rules.atom(strings.jaro("name_s", "name_t"), 0.7), rules.atom(same, 1.0))
    want = sorted(map(tuple, linker.link_triples(*sides, side, side, column, 0.7).collect()))
    monkeypatch.setattr(linker.blocking, "candidates", None)
    got = linker.link_triples(*sides, side, side, And(Atom("jaro", "name", 0.7), YEAR), 0.7)
    assert sorted(map(tuple, got.select("source", "target", "sim").collect())) == want and want


def test_empty_sides(spark):
    none = people(spark, 1, 3).where("false")
    assert link_by_rule(none, people(spark, 2, 9), "id", And(NAME, YEAR), 0.3).count() == 0
    assert rule_pairs(Minus(NAME, YEAR), people(spark, 2, 9), none, "id").count() == 0
