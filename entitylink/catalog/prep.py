"""Value transforms over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import table
from entitylink.functions import prep

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


def _one(name, tab, key, value, chain, sql_value, sql_out):
    """Register one chain over one column of one table."""

    @query(name, f"SELECT {key}, {sql_out} AS value FROM (SELECT {key}, {sql_value} AS v FROM {tab})")
    def run(spark, sf):
        return table(spark, sf, tab).select(key, prep.apply(F.expr(value) if isinstance(value, str) else value(), chain).alias("value"))


_one("prep_case", "part", "p_partkey", "p_name || ' ' || p_type", ["uppercase"], "p_name || ' ' || p_type", "upper(v)")
_one(
    "prep_lower", "part", "p_partkey", "p_brand || ' 2^10 ^^ ' || p_type || '^^xsd:string'", ["lowercase"],
    "p_brand || ' 2^10 ^^ ' || p_type", "lower(v)",
)
_one("prep_replace", "pages", "page_id", "url", [("replace", "example.", "site.")], "url", "replace(v, 'example.', 'site.')")
_one(
    "prep_regexreplace", "pages", "page_id", _title, ["lowercase", ("regexreplace", "[^a-z0-9]", " ")],
    TITLE, "trim(regexp_replace(lower(v), '[^a-z0-9]', ' ', 'g'))",
)
_one("prep_nolang", "documents", "doc_id", "source || '@' || lang", ["nolang"], "source || '@' || lang", "regexp_replace(v, '@[^@]*$', '')")
_one("prep_cleaniri", "pages", "page_id", "url", ["cleaniri"], "url", "regexp_extract(v, '[^/]*$')")

NUMBER = "CASE WHEN regexp_matches(d, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN d ELSE '0' END"


@query(
    "prep_number",
    f"""SELECT 'event' AS kind, event_id AS id, {NUMBER} AS value FROM (SELECT event_id, regexp_replace(props, '[^0-9,.-]', '', 'g') AS d FROM events)
UNION ALL SELECT 'page', page_id, {NUMBER} FROM (SELECT page_id, regexp_replace(url, '[^0-9,.-]', '', 'g') AS d FROM pages)""",
)
def prep_number(spark, sf):
    e = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), prep.number(F.col("props")).alias("value"))
    p = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), prep.number(F.col("url")).alias("value"))
    return e.unionByName(p)


@query(
    "prep_temperature",
    """SELECT event_id, round(32 + k * 9 / 5, 6) AS to_fahrenheit, round((k - 32) * 5 / 9, 6) AS to_celsius
FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events)""",
)
def prep_temperature(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.round(prep.celsius(F.col("props")), 6).alias("to_fahrenheit"),
        F.round(prep.fahrenheit(F.col("props")), 6).alias("to_celsius"),
    )


_one("prep_date", "orders", "o_orderkey", "'on ' || date_format(o_orderdate, 'yyyy-MM-dd') || ' (' || o_orderstatus || ')'", ["date"],
     "'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' (' || o_orderstatus || ')'", "regexp_replace(v, '[^0-9,.-]', '', 'g')")


@query(
    "prep_removebraces",
    """SELECT p_partkey, p_name || ' ' || p_type AS paired, p_name || p_brand AS lone, p_type AS leading FROM part""",
)
def prep_removebraces(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        prep.removebraces(F.expr("p_name || ' (' || p_brand || ') ' || p_type")).alias("paired").cast("string"),
        prep.removebraces(F.expr("p_name || ')' || p_brand")).alias("lone"),
        prep.removebraces(F.expr("'(' || p_brand || ')' || p_type")).alias("leading"),
    )


_one("prep_alphabet", "pages", "page_id", _title, ["regularalphabet"], TITLE, "trim(regexp_replace(v, '[^A-Za-z0-9 ]', '', 'g'))")


@query(
    "prep_uriasstring",
    """SELECT page_id, replace(regexp_extract(url, '[^:]*$'), '_', ' ') AS colon,
  replace(CASE WHEN regexp_matches(path, '^.+/[^/]+$') THEN regexp_extract(path, '[^/]*$') ELSE path END, '_', ' ') AS slash
FROM (SELECT page_id, url, regexp_replace(url, '^https?:', '') AS path FROM pages)""",
)
def prep_uriasstring(spark, sf):
    path = F.regexp_replace("url", "^https?:", "")
    return table(spark, sf, "pages").select(
        "page_id", prep.uriasstring(F.col("url")).alias("colon"), prep.uriasstring(path).alias("slash")
    )


LAYOUTS = {  # Spark pattern, DuckDB pattern
    "1-URGENT": ("yyyy", "%Y"),
    "2-HIGH": ("yyyy-MM-dd", "%Y-%m-%d"),
    "3-MEDIUM": ("yyyy/M/d", "%Y/%-m/%-d"),
    "4-NOT SPECIFIED": ("dd.MM.yyyy", "%d.%m.%Y"),
}
STATUS = {"F": ("dd/MM/yyyy", "%d/%m/%Y"), "O": ("d-MMM-yyyy", "%-d-%b-%Y"), "P": ("dd.MMMM.yyyy", "%d.%B.%Y")}


@query(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN date_trunc('year', o_orderdate)::DATE
  ELSE o_orderdate::DATE END AS parsed FROM orders""",
)
def parse_dates(spark, sf):
    """Order dates written in seven layouts, by priority and status, and parsed back."""
    text = F.lit(None).cast("string")
    for status, (pattern, _) in STATUS.items():
        text = F.when(F.col("o_orderstatus") == status, F.date_format("o_orderdate", pattern)).otherwise(text)
    for priority, (pattern, _) in LAYOUTS.items():
        text = F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", pattern)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", prep.parse_date(text).alias("parsed"))
