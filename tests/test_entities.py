import datetime as dt

import pytest
from pyspark.sql import functions as F

from entitylink.functions import prep
from entitylink.operators import entities as en
from entitylink.sources import rdf, sinks


def one(spark, expr, x):
    return spark.createDataFrame([(x,)], "x string").select(expr(F.col("x")).alias("r")).collect()[0].r


@pytest.mark.parametrize(
    "chain,x,want",
    [
        (["lowercase"], "ABC^^xsd:string", "abc"),
        (["nolang"], "a@b@en", "a@b"),
        (["nolang"], "abc", "abc"),
        (["cleaniri"], "http://x/y/z", "z"),
        (["number"], "about 12.5 C", "12.5"),
        (["number"], "1-2", "0"),
        (["number"], "none", "0"),
        (["celsius"], "100 C", "212.0"),
        (["fahrenheit"], "212", "100.0"),
        (["date"], "on 2001-02-03!", "2001-02-03"),
        (["removebraces"], "ring (red) big", "ring big"),
        (["removebraces"], "(red) big", " big"),
        (["removebraces"], "a) b", "a b"),
        (["regularalphabet"], " a-b_c! ", "abc"),
        (["uriasstring"], "http://x.org/a_b", "//x.org/a b"),
        (["uriasstring"], "x.org/a_b", "a b"),
        (["uriasstring"], "plain_text", "plain text"),
        (["lowercase", ("regexreplace", "[^a-z]+", " "), ("replace", "b", "d")], "A.B!", "a d"),
    ],
)
def test_chains(spark, chain, x, want):
    assert one(spark, lambda c: prep.apply(c, chain), x) == want


@pytest.mark.parametrize(
    "x,want",
    [
        ("1997", dt.date(1997, 1, 1)),
        ("2001-2-3", dt.date(2001, 2, 3)),
        ("2001/02/03", dt.date(2001, 2, 3)),
        ("03/02/2001", dt.date(2001, 2, 3)),
        ("3.2.2001", dt.date(2001, 2, 3)),
        ("3-Feb-2001", dt.date(2001, 2, 3)),
        ("3/February/2001", dt.date(2001, 2, 3)),
        ("31.02.2001", dt.date(2001, 3, 3)),
        ("3-Feb/2001", None),
        ("3-Xyz-2001", None),
        ("soon", None),
    ],
)
def test_parse_date(spark, x, want):
    assert one(spark, prep.parse_date, x) == want


@pytest.mark.parametrize(
    "x,want",
    [("http%3A%2F%2Fdx.doi.org%2F10.1000%2Fa%20b1", "10.1000/a-b1"), ("doi:10.1234/x12", "10.1234/x12"), ("isbn 10-12", None), ("%zz 10.1000/q", "10.1000/q")],
)
def test_normalize_doi(spark, x, want):
    assert one(spark, prep.normalize_doi, x) == want


def test_points(spark):
    assert [tuple(p) for p in one(spark, prep.parse_points, "POLYGON((1  1, 2 -1.5))")] == [(1.0, 1.0), (2.0, -1.5)]
    assert [tuple(p) for p in one(spark, lambda c: prep.parse_points(c, "lonlat"), "LINE(1 2)")] == [(2.0, 1.0)]


def test_parse_triples(spark):
    lines = [
        '<s> <p> "a \\"q\\" literal"^^<t> .',
        "<s>\t<p>\t<o> .",
        "_:b <p> <o> .",
        "<s> <p> bare .",
        "<s> <p>  <two blanks> .",
        "# note",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(r.subject, r.predicate, r.object) for r in rdf.parse_triples(df).collect()]
    assert got == [("s", "p", '"a \\"q\\" literal"^^<t>'), ("s", "p", "o")]


def test_literals_keep_their_last_characters(spark):
    lines = ['<s> <p> "x".', '<s> <p> "y" . ', '<s> <p> "z"^^<t>.', '<s> <p> "a. b"@en .', "<s> <p> bare .", "_:b <p> <o> .", "# note", " "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.object for r in rdf.parse_triples(df).collect()] == ['"x"', '"y"', '"z"^^<t>', '"a. b"@en']
    assert [r.value for r in rdf.rejected_lines(df).collect()] == ["<s> <p> bare .", "_:b <p> <o> ."]


@pytest.mark.parametrize(
    "x,want",
    [("2^10 m", "2^10 m"), ("a^b^^c d", "a^b^^c d"), ('"5"^^xsd:int', '"5"'), ('"5"^^<http://x#int>', '"5"'), ("x^", "x^"), (None, None)],
)
def test_only_a_closing_datatype_is_cut(spark, x, want):
    assert one(spark, lambda c: prep.apply(c, []), x) == want


def test_large_entities_continue_in_parts(spark):
    rows = [("hot", "p", str(i)) for i in range(40)] + [("cold", "p", "1"), ("cold", "p", "1")]
    df = en.aggregate_entities(spark.createDataFrame(rows, "subject string, predicate string, object string"), part_size=5).collect()
    assert sum(len(r.pairs) for r in df if r.subject == "hot") == 40 and len([r for r in df if r.subject == "hot"]) > 1
    assert [len(r.pairs) for r in df if r.subject == "cold"] == [1]


def test_complete_entities(spark):
    rows = [("a", en.RDF_TYPE, "C"), ("a", "p", '"1"^^int'), ("a", "q", "x"), ("a", "z", "no"), ("b", "p", "1"), ("b", "q", "1"), ("c", en.RDF_TYPE, "C"), ("c", "p", "1")]
    df = en.complete_entities(spark.createDataFrame(rows, "subject string, predicate string, object string"), ["p", "q"], "C")
    assert {tuple(r) for r in df.collect()} == {("a", "p", "1"), ("a", "q", "x")}


def test_link_csv_round_trip(spark, tmp_path):
    links = spark.createDataFrame([('a"b', "c,d", 0.5)], "source string, target string, sim double")
    sinks.write_links(links, str(tmp_path / "l"), "csv")
    assert [tuple(r) for r in rdf.read_links_csv(spark, str(tmp_path / "l"), 3).collect()] == [('a"b', "c,d", 0.5)]
    with pytest.raises(ValueError):
        sinks.write_links(links, str(tmp_path / "x"), "rdfxml")
