"""Worked-out values of the string measures."""

import pytest
from pyspark.sql import functions as F

from entitylink.functions import strings, tokens


def one(spark, expr, x, y=None):
    """``expr(a, b)`` for one pair."""
    row = spark.createDataFrame([(x, y)], "a string, b string").select(expr(F.col("a"), F.col("b")).alias("r"))
    return row.collect()[0].r


JARO = [
    ("martha", "marhta", 0.944444),
    ("dixon", "dicksonx", 0.0),
    ("a", "a", 0.0),
    ("", "abc", 0.0),
    ("1999", "1999", 1.0),
    ("cold widget", "cold gadget", 0.841751),
]
WINKLER = [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), (" cold widget", "cold gadget", 0.905051), ("abc", "xyz", 0.0)]
RATCLIFF = [("martha", "marhta", 0.833333), ("Cold widget", "cold gadget", 0.818182), ("", "", 0.0)]


@pytest.mark.parametrize("x,y,want", JARO)
def test_jaro(spark, x, y, want):
    assert one(spark, strings.jaro, x, y) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("x,y,want", WINKLER)
def test_jaro_winkler(spark, x, y, want):
    got = one(spark, lambda a, b: strings.jaro_winkler(strings.winkler_form(a), strings.winkler_form(b)), x, y)
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("x,y,want", RATCLIFF)
def test_ratcliff(spark, x, y, want):
    assert one(spark, strings.ratcliff, x, y) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "x,want",
    [("Robert", "R16300"), ("Rupert", "R16300"), ("Ashcraft", "S26130"), ("Pfister", "P12360"), ("Alan", "L50000"), ("Lloyd", "L30000"), ("", "000000")],
)
def test_soundex(spark, x, want):
    assert one(spark, lambda a, b: strings.soundex_code(a), x) == want


def test_gram_measures(spark):
    x, y = "cold widget", "cold gadget"
    assert one(spark, lambda a, b: strings.dice(tokens.padded_bigrams(a), tokens.padded_bigrams(b)), x, y) == pytest.approx(0.769231, abs=1e-6)

    def jaccard(a, b):
        g, h = tokens.qgrams(a, 3), tokens.qgrams(b, 3)
        o = F.size(F.array_intersect(g, h))
        return o / (F.size(g) + F.size(h) - o)

    assert one(spark, jaccard, x, y) == pytest.approx(0.384615, abs=1e-6)
    assert one(spark, lambda a, b: tokens.qgrams(a, 3), "  a  b ") == ["a b"]
    assert one(spark, lambda a, b: tokens.qgrams(a, 3), "a") == ["a__"]


def test_number_repeats(spark):
    assert sorted(one(spark, lambda a, b: tokens.bag(a), "the cat, the dog. the")) == ["cat", "dog", "the", "the.2", "the.3"]
    assert one(spark, lambda a, b: tokens.bag(a), " .,") == []
    assert sorted(one(spark, lambda a, b: tokens.char_bag(a), "aba")) == ["a", "a.2", "b"]


def test_block_tokens(spark):
    assert one(spark, lambda a, b: tokens.block_tokens(a), 'The "Café", the 2nd\nrow') == ["the", "caf", "2nd", "row"]


def test_random_ratcliff_equals_the_textbook():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 25)))
    pairs = [(text(), text()) for _ in range(300)]
    want = [SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 0.0 for x, y in pairs]
    assert strings._ratcliff(*map(list, zip(*pairs))).tolist() == pytest.approx(want)


@pytest.mark.parametrize("measure", [strings.jaro, strings.jaro_winkler, strings.ratcliff])
def test_a_missing_value_has_no_similarity(spark, measure):
    from entitylink.functions import rules

    rows = spark.createDataFrame([("ab", None), (None, "ab"), (None, None), ("abcd", "abcd")], "a string, b string")
    got = rows.select(measure("a", "b").alias("s")).withColumn("r", rules.atom(F.col("s"), 0.5)).collect()
    assert [r.s for r in got[:3]] == [None] * 3 and [r.r for r in got[:3]] == [0.0] * 3 and got[3].s == 1.0
