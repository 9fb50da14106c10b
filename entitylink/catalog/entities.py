"""Entity assembly, filters, samples and gold sets over driver tables as triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import table
from entitylink.catalog.links import BASE_ALL, _all
from entitylink.functions import prep
from entitylink.operators import entities as en
from entitylink.operators import learn

RDF = en.RDF_TYPE


def doc_triples(spark, sf):
    """Documents as typed entities; labelled ones also have a quality."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    base = en.to_triples(docs, "doc_id", ["source", "lang"], "urn:Document", "urn:")
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("urn:"), F.col("doc_id").cast("string")).alias("subject"),
        F.lit("urn:quality").alias("predicate"),
        F.concat(F.lit('"'), F.col("quality").cast("string"), F.lit('"^^xsd:int')).alias("object"),
    )
    return base.unionByName(labels)


SQL_TRIPLES = f"""WITH triples AS (
  SELECT 'urn:' || doc_id AS subject, '{RDF}' AS predicate, 'urn:Document' AS object FROM documents
  UNION ALL SELECT 'urn:' || doc_id, 'urn:source', '"' || source || '"' FROM documents
  UNION ALL SELECT 'urn:' || doc_id, 'urn:lang', '"' || lang || '"' FROM documents
  UNION ALL SELECT 'urn:' || doc_id, 'urn:quality', '"' || quality || '"^^xsd:int' FROM labels)
"""


@query("filter_config", SQL_TRIPLES + f"SELECT * FROM triples WHERE predicate IN ('urn:lang', 'urn:quality') OR (predicate = '{RDF}' AND object = 'urn:Document')")
def filter_config(spark, sf):
    return en.filter_config(doc_triples(spark, sf), ["urn:lang", "urn:quality"], "urn:Document")


@query(
    "filter_complete_entities",
    SQL_TRIPLES + """SELECT subject AS id, predicate AS prop, replace(regexp_replace(object, '\\^\\^[^^]*$', ''), '"', '') AS value
FROM triples WHERE predicate IN ('urn:lang', 'urn:quality')
AND subject IN (SELECT 'urn:' || doc_id FROM labels JOIN documents USING (doc_id))""",
)
def filter_complete_entities(spark, sf):
    return en.complete_entities(doc_triples(spark, sf), ["urn:lang", "urn:quality"], "urn:Document")


@query(
    "aggregate_entities",
    SQL_TRIPLES + """SELECT subject, CAST(0 AS INT) AS part, count(*) AS n, string_agg(predicate || '=' || object, ';' ORDER BY predicate, object) AS pairs
FROM (SELECT DISTINCT * FROM triples) GROUP BY subject""",
)
def aggregate_entities(spark, sf):
    text = F.array_join(F.transform("pairs", lambda p: F.concat(p.predicate, F.lit("="), p.object)), ";")
    return en.aggregate_entities(doc_triples(spark, sf)).select("subject", "part", F.size("pairs").cast("bigint").alias("n"), text.alias("pairs"))


def _doi_text():
    coded = F.concat(F.lit("http%3A%2F%2Fdx.doi.org%2F10.1000%2F"), F.col("o_orderkey").cast("string"))
    plain = F.concat(F.lit("doi:10.12345/"), F.col("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string"))
    none = F.concat(F.lit("isbn 10-"), F.col("o_orderkey").cast("string"))
    return F.when(F.col("o_orderstatus") == "F", coded).when(F.col("o_orderstatus") == "O", plain).otherwise(none)


@query(
    "normalize_doi",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '10.1000/' || o_orderkey
  WHEN 'O' THEN '10.12345/' || replace(o_orderpriority, ' ', '-') || '/' || o_orderkey END AS doi FROM orders""",
)
def normalize_doi(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", prep.normalize_doi(_doi_text()).alias("doi"))


def _part_props(spark, sf):
    return en.to_props(table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


SQL_PROPS = """WITH props AS (SELECT p_partkey AS id, 'p_name' AS prop, p_name AS value FROM part
  UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part)
"""


@query(
    "transform_property",
    SQL_PROPS + """SELECT id, CASE prop WHEN 'p_brand' THEN 'brand' ELSE prop END AS prop,
  CASE prop WHEN 'p_brand' THEN replace(lower(value), '#', ' ') ELSE value END AS value FROM props""",
)
def transform_property(spark, sf):
    return en.transform_property(_part_props(spark, sf), "p_brand", ["lowercase", ("replace", "#", " ")], "brand")


@query("add_property", SQL_PROPS + "SELECT * FROM props UNION ALL SELECT id, 'NAME', upper(value) FROM props WHERE prop = 'p_name'")
def add_property(spark, sf):
    return en.add_property(_part_props(spark, sf), "p_name", "NAME", ["uppercase"])


@query("list_properties", SQL_PROPS + "SELECT DISTINCT prop FROM props")
def list_properties(spark, sf):
    return en.list_properties(_part_props(spark, sf))


@query("sample_entities", "SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50")
def sample_entities(spark, sf):
    return en.sample_entities(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 50)


@query("trim_to_links", BASE_ALL + "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT target FROM a WHERE sim >= 0.95)")
def trim_to_links(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return en.trim_to_links(parts, "p_partkey", _all(spark, sf).where(F.col("sim") >= 0.95), "target")


@query(
    "trim_examples",
    BASE_ALL + """, one AS (SELECT source, target FROM a
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(source || '|' || target), target) = 1)
SELECT * FROM one ORDER BY md5(CAST(source AS VARCHAR)), source LIMIT 40""",
)
def trim_examples(spark, sf):
    return en.trim_examples(_all(spark, sf), 40)


@query(
    "balanced_examples",
    BASE_ALL + """, s AS (SELECT o_orderkey AS source, row_number() OVER (ORDER BY md5('s|' || o_orderkey), o_orderkey) AS k FROM orders QUALIFY k <= 30),
t AS (SELECT p_partkey AS target, row_number() OVER (ORDER BY md5('t|' || p_partkey), p_partkey) AS k FROM part QUALIFY k <= 30),
known AS (SELECT source, target FROM a ORDER BY md5(source || '|' || target), source, target LIMIT 15)
SELECT source, target, bool_or(known) AS known FROM (SELECT source, target, false AS known FROM s JOIN t USING (k)
  UNION ALL SELECT source, target, true FROM known) GROUP BY ALL""",
)
def balanced_examples(spark, sf):
    src = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    tgt = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return en.balanced_examples(src, tgt, "id", _all(spark, sf), 30)


@query(
    "property_pairs",
    """WITH s(prop, kind) AS (SELECT 'p_name', 'string' UNION ALL SELECT 'p_brand', 'string' UNION ALL SELECT 'p_size',
    CASE WHEN (SELECT bool_and(TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) IS NOT NULL) FROM part) THEN 'number' ELSE 'string' END),
t(prop, kind) AS (SELECT 'o_orderdate', CASE WHEN (SELECT bool_and(TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) IS NOT NULL) FROM orders) THEN 'date' ELSE 'string' END
  UNION ALL SELECT 'o_totalprice', 'number' UNION ALL SELECT 'o_custkey', 'number' UNION ALL SELECT 'o_orderpriority', 'string')
SELECT s.prop AS source_prop, t.prop AS target_prop, kind FROM s JOIN t USING (kind)""",
)
def property_pairs(spark, sf):
    orders = en.to_props(table(spark, sf, "orders"), "o_orderkey", ["o_orderdate", "o_totalprice", "o_custkey", "o_orderpriority"])
    return learn.property_pairs(_part_props(spark, sf), orders)


def _keyed(spark, sf):
    key = F.md5("text").alias("key")
    number = F.substring("source", 4, 10).cast("int")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), key, "lang", (number < 10).alias("s"))


@query(
    "gold_pairs",
    """WITH d AS (SELECT doc_id AS id, text, CAST(substr(source, 4) AS INT) < 10 AS s FROM documents)
SELECT x.id AS source, y.id AS target FROM d x JOIN d y ON x.text = y.text AND x.s AND NOT y.s""",
)
def gold_pairs(spark, sf):
    """Every pair of equal texts of both document sets."""
    d = _keyed(spark, sf)
    return learn.gold_pairs(d.where("s"), d.where("not s"), "id", "key")


@query("entity_pairs", SQL_TRIPLES + "SELECT DISTINCT * FROM triples")
def entity_pairs(spark, sf):
    """Documents with labels in long form, each triple given twice."""
    triples = doc_triples(spark, sf)
    return en.entity_pairs(triples.unionByName(triples))


@query(
    "normalize_doi_triples",
    """SELECT 'urn:' || o_orderkey AS subject, 'urn:identifier' AS predicate, CASE o_orderstatus WHEN 'F' THEN '10.1000/' || o_orderkey
  WHEN 'O' THEN '10.12345/' || replace(o_orderpriority, ' ', '-') || '/' || o_orderkey END AS object FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT 'urn:' || o_orderkey, 'urn:priority', o_orderpriority FROM orders""",
)
def normalize_doi_triples(spark, sf):
    """Identifiers of orders as triples; those without a DOI go, other properties stay."""
    orders = table(spark, sf, "orders")
    subject = F.concat(F.lit("urn:"), F.col("o_orderkey").cast("string")).alias("subject")
    ids = orders.select(subject, F.lit("urn:identifier").alias("predicate"), _doi_text().alias("object"))
    rest = orders.select(subject, F.lit("urn:priority").alias("predicate"), F.col("o_orderpriority").alias("object"))
    return en.normalize_dois(ids.unionByName(rest), "urn:identifier")


@query(
    "trim_examples_first",
    BASE_ALL + """, one AS (SELECT source, target FROM a
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(source || '|' || target), target) = 1)
SELECT * FROM one ORDER BY source LIMIT 40""",
)
def trim_examples_first(spark, sf):
    return en.trim_examples(_all(spark, sf), 40, random=False)


@query(
    "gold_from_key",
    """WITH d AS (SELECT doc_id AS id, md5(text) AS key, lang, CAST(substr(source, 4) AS INT) < 10 AS s FROM documents),
links AS (SELECT 'link' AS kind, min(id) FILTER (WHERE s) AS source, min(id) FILTER (WHERE NOT s) AS target,
  count(*) FILTER (WHERE s) AS n_source, count(*) FILTER (WHERE NOT s) AS n_target FROM d GROUP BY key
  HAVING bool_or(s) AND bool_or(NOT s)),
lone AS (SELECT * FROM d x WHERE NOT EXISTS (SELECT 1 FROM d y WHERE y.key = x.key AND y.s <> x.s)
  QUALIFY row_number() OVER (PARTITION BY s, lang ORDER BY md5(CAST(id AS VARCHAR)), id) <= 20)
SELECT * FROM links UNION ALL SELECT CASE WHEN s THEN 'source_noise' ELSE 'target_noise' END,
  CASE WHEN s THEN id END, CASE WHEN NOT s THEN id END, 0, 0 FROM lone""",
)
def gold_from_key(spark, sf):
    """Equal texts of both document sets, and 20 unlinked documents per side and language."""
    d = _keyed(spark, sf)
    return learn.gold_from_key(d.where("s"), d.where("not s"), "id", "key", "lang", 20)
