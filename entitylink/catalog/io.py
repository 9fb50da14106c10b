"""Sources and sinks: lines are made from driver tables, written, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import table
from entitylink.catalog.entities import SQL_TRIPLES, doc_triples
from entitylink.catalog.links import BASE_ALL, _all
from entitylink.functions import prep
from entitylink.operators import entities as en
from entitylink.operators import evaluate as ev
from entitylink.operators import learn
from entitylink.session import shared_folder
from entitylink.sources import rdf, sinks

SAME = rdf.SAME_AS


def _text(spark, df, name):
    path = shared_folder(spark, name)
    df.write.text(path)
    return path


def _str(c):
    return F.col(c).cast("string")


def _customer_lines(spark, sf):
    """Per customer a literal, an IRI, and two lines that are no triples."""
    key = _str("c_custkey")
    lines = F.array(
        F.concat(F.lit("<urn:c:"), key, F.lit('> <urn:name> "'), F.col("c_name"), F.lit('" .')),
        F.concat(F.lit("<urn:c:"), key, F.lit(">\t<urn:nation>\t<urn:n:"), _str("c_nationkey"), F.lit("> .")),
        F.concat(F.lit("# customer "), key),
        F.concat(F.lit("<urn:c:"), key, F.lit("> <urn:segment> "), F.col("c_mktsegment"), F.lit(" .")),
    )
    return table(spark, sf, "customer").select(F.explode(lines).alias("value"))


@query(
    "src_ntriples",
    """SELECT 'urn:c:' || c_custkey AS subject, 'urn:name' AS predicate, '"' || c_name || '"' AS object FROM customer
UNION ALL SELECT 'urn:c:' || c_custkey, 'urn:nation', 'urn:n:' || c_nationkey FROM customer""",
)
def src_ntriples(spark, sf):
    path = shared_folder(spark, "ntriples")
    _customer_lines(spark, sf).write.text(path, compression="gzip")
    return rdf.read_ntriples(spark, path)


@query(
    "src_csv_entities",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, 'name' AS prop, upper('a "' || p_name || '", new') AS value FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'type', p_type FROM part""",
)
def src_csv_entities(spark, sf):
    path = shared_folder(spark, "csv")
    name = F.concat(F.lit('a "'), F.col("p_name"), F.lit('", new'))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_type").alias("type"), "p_size")
    rows.write.csv(path, header=True, escape='"')
    return rdf.read_csv_entities(spark, path, {"name": ["uppercase"], "type": []})


@query("src_vectors", "SELECT 'v' || vec_id AS id, CAST(i - 1 AS INT) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(i)")
def src_vectors(spark, sf):
    values = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "|")
    lines = table(spark, sf, "embeddings").select(F.concat(F.lit("<v"), _str("vec_id"), F.lit(">\t"), values).alias("value"))
    v = rdf.read_vectors(spark, _text(spark, lines, "vectors"))
    return v.select("id", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query(
    "src_links_csv",
    """SELECT 'two' AS kind, 'urn:o' || o_orderkey AS source, 'urn:c' || o_custkey AS target, 1.0::DOUBLE AS sim FROM orders
UNION ALL SELECT 'sim', 'urn:o' || o_orderkey, 'urn:c' || o_custkey, 0.5::DOUBLE FROM orders
UNION ALL SELECT 'predicate', 'urn:o' || o_orderkey, 'urn:c' || o_custkey, 1.0::DOUBLE FROM orders""",
)
def src_links_csv(spark, sf):
    s = F.concat(F.lit("<urn:o"), _str("o_orderkey"), F.lit(">")).alias("s")
    t = F.concat(F.lit("urn:c"), _str("o_custkey")).alias("t")
    o = table(spark, sf, "orders").select(s, t)
    out = None
    for kind, cols, sep in [("two", ["s", "t"], ","), ("sim", ["s", "t", F.lit("0.5").alias("x")], ";"), ("predicate", ["s", F.lit("owl:sameAs").alias("p"), "t"], ",")]:
        path = shared_folder(spark, "links")
        o.select(*cols).write.csv(path, sep=sep, quoteAll=True)
        part = rdf.read_links_csv(spark, path, len(cols), sep).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _order_links(spark, sf):
    s = F.concat(F.lit("urn:o:"), _str("l_orderkey")).alias("source")
    t = F.concat(F.lit("urn:p:"), _str("l_partkey")).alias("target")
    return table(spark, sf, "lineitem").select(s, t, (F.col("l_quantity") / 50).alias("sim"))


SQL_ORDER_LINKS = "WITH links AS (SELECT 'urn:o:' || l_orderkey AS source, 'urn:p:' || l_partkey AS target, l_quantity / 50 AS sim FROM lineitem)\n"


@query(
    "links_by_file_name",
    SQL_ORDER_LINKS + """SELECT 'csv' AS kind, source, target, round(sim, 6) AS sim FROM links
UNION ALL SELECT 'tsv', source, target, round(sim, 6) FROM links UNION ALL SELECT 'nt', source, target, 1.0::DOUBLE FROM links""",
)
def links_by_file_name(spark, sf):
    """Written and read back with nothing but the file name to go by."""
    out = None
    for kind in ("csv", "tsv", "nt"):
        path = shared_folder(spark, "links") + f".{kind}"
        sinks.write_links(_order_links(spark, sf), path)
        part = rdf.read_links(spark, path).select(F.lit(kind).alias("kind"), "source", "target", F.round("sim", 6).alias("sim"))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_links_nt", SQL_ORDER_LINKS + "SELECT source, target, 1.0::DOUBLE AS sim FROM links")
def src_links_nt(spark, sf):
    path = shared_folder(spark, "links-nt")
    sinks.write_links(_order_links(spark, sf), path, "nt")
    return rdf.read_links_nt(spark, path, SAME)


@query("gold_from_sameas", SQL_ORDER_LINKS + "SELECT source, target FROM links")
def gold_from_sameas(spark, sf):
    path = shared_folder(spark, "gold-nt")
    sinks.write_links(_order_links(spark, sf), path, "nt")
    return ev.gold_from_sameas(rdf.read_ntriples(spark, path).unionByName(doc_triples(spark, sf)), SAME)


def _polygon_text(spark, sf):
    """Whole embeddings as 32-point polygons: (x * 90, y * 180)."""
    point = F.transform(
        F.sequence(F.lit(0), F.lit(62), F.lit(2)),
        lambda i: F.concat((F.get("embedding", i).cast("double") * 90).cast("string"), F.lit(" "), (F.get("embedding", i + 1).cast("double") * 180).cast("string")),
    )
    text = F.concat(_str("vec_id"), F.lit("\tPOLYGON(("), F.array_join(point, ", "), F.lit("))"))
    return table(spark, sf, "embeddings").select(text.alias("value"))


SQL_POINTS = """WITH pts AS (SELECT vec_id AS id, i AS pos, CAST(embedding[2 * i + 1] AS DOUBLE) * 90 AS lat, CAST(embedding[2 * i + 2] AS DOUBLE) * 180 AS lon
  FROM embeddings, range(0, 32) r(i))
"""


def _flat(df):
    rows = df.select("id", F.posexplode("pts").alias("pos", "p"))
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("src_polygons", SQL_POINTS + "SELECT CAST(id AS VARCHAR) AS id, pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts")
def src_polygons(spark, sf):
    return _flat(rdf.read_polygons(spark, _text(spark, _polygon_text(spark, sf), "polygons")))


@query("src_polygon_lines", SQL_POINTS + "SELECT 'p' || id AS id, pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts")
def src_polygon_lines(spark, sf):
    pts = prep.parse_points(F.split("value", "\t")[1])
    numbers = F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", p.lon.cast("string"), p.lat.cast("string"))), " ")
    lines = _polygon_text(spark, sf).select(F.concat(F.lit("p"), F.split("value", "\t")[0], F.lit(" "), numbers).alias("value"))
    return _flat(rdf.read_polygon_lines(spark, _text(spark, lines, "polygon-lines")))


def _polygons(spark, sf):
    parts = F.split("value", "\t")
    return _polygon_text(spark, sf).select(parts[0].cast("bigint").alias("id"), prep.parse_points(parts[1]).alias("pts"))


@query(
    "perturb_points",
    SQL_POINTS + """SELECT p.id, p.pos, round(p.lat + (q.lat - p.lat) * 0.25, 6) AS lat, round(p.lon + (q.lon - p.lon) * 0.25, 6) AS lon
FROM pts p JOIN pts q ON q.id = p.id AND q.pos = (p.pos + 1) % 32""",
)
def perturb_points(spark, sf):
    return _flat(_polygons(spark, sf).select("id", learn.slide_points(F.col("pts"), 0.25).alias("pts")))


@query(
    "perturb_random",
    SQL_POINTS + """, kept AS (SELECT id, lat, lon, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos FROM pts
  WHERE pos = 0 OR ('0x' || substr(md5(id || '|' || pos), 1, 7))::BIGINT / 268435456.0::DOUBLE >= 0.3)
SELECT id, pos, round(lat + (('0x' || substr(md5(id || '|' || pos || '|0'), 1, 7))::BIGINT / 268435456.0::DOUBLE * 2 - 1) * 0.5, 6) AS lat,
  round(lon + (('0x' || substr(md5(id || '|' || pos || '|1'), 1, 7))::BIGINT / 268435456.0::DOUBLE * 2 - 1) * 0.5, 6) AS lon FROM kept""",
)
def perturb_random(spark, sf):
    dropped = _polygons(spark, sf).select("id", learn.drop_points(F.col("id"), F.col("pts"), 0.3).alias("pts"))
    return _flat(dropped.select("id", learn.jitter_points(F.col("id"), F.col("pts"), 0.5).alias("pts")))


NT = "'<' || source || '> <http://www.w3.org/2002/07/owl#sameAs> <' || target || '> .'"


@query("sink_links_nt", SQL_ORDER_LINKS + f"SELECT {NT} AS value FROM links")
def sink_links_nt(spark, sf):
    path = shared_folder(spark, "sink-nt")
    sinks.write_links(_order_links(spark, sf), path, "nt")
    return spark.read.text(path)


@query(
    "sink_links_ttl",
    SQL_ORDER_LINKS + "SELECT '@prefix owl: <http://www.w3.org/2002/07/owl#> .' AS value UNION ALL SELECT '<' || source || '> owl:sameAs <' || target || '> .' FROM links",
)
def sink_links_ttl(spark, sf):
    path = shared_folder(spark, "sink-ttl")
    sinks.write_links(_order_links(spark, sf), path, "ttl")
    return spark.read.text(f"{path}/prefixes").unionByName(spark.read.text(f"{path}/links"))


@query("sink_links_tsv", SQL_ORDER_LINKS + "SELECT '<' || source || '>' || chr(9) || '<' || target || '>' || chr(9) || CAST(sim AS VARCHAR) AS value FROM links")
def sink_links_tsv(spark, sf):
    path = shared_folder(spark, "sink-tsv")
    sinks.write_links(_order_links(spark, sf), path, "tsv")
    return spark.read.text(path)


@query("sink_links_csv", SQL_ORDER_LINKS + """SELECT '"' || source || '","' || target || '",' || CAST(sim AS VARCHAR) AS value FROM links""")
def sink_links_csv(spark, sf):
    path = shared_folder(spark, "sink-csv")
    sinks.write_links(_order_links(spark, sf), path, "csv")
    return spark.read.text(path)


@query("sink_links_parquet", BASE_ALL + "SELECT source, target, round(sim, 6) AS sim FROM a")
def sink_links_parquet(spark, sf):
    path = shared_folder(spark, "sink-parquet")
    sinks.write_links(_all(spark, sf), path, "parquet")
    return spark.read.parquet(path).withColumn("sim", F.round("sim", 6))


@query(
    "sink_entities_nt",
    SQL_TRIPLES + "SELECT DISTINCT '<' || subject || '> <' || predicate || '> ' || CASE WHEN ascii(object) = 34 THEN object ELSE '<' || object || '>' END || ' .' AS value FROM triples "
    "UNION ALL SELECT '<urn:page:' || page_id || '> <urn:url> <' || url || '> .' FROM pages",
)
def sink_entities_nt(spark, sf):
    urls = table(spark, sf, "pages").select(
        F.concat(F.lit("urn:page:"), _str("page_id")).alias("subject"), F.lit("urn:url").alias("predicate"), F.col("url").alias("object")
    )
    path = shared_folder(spark, "sink-entities")
    sinks.write_entities(en.aggregate_entities(doc_triples(spark, sf).unionByName(urls)), path)
    return spark.read.text(path)


@query(
    "entities_round_trip",
    SQL_TRIPLES + "SELECT DISTINCT subject, predicate, object FROM triples "
    "UNION ALL SELECT 'urn:page:' || page_id, 'urn:title', '\"2^10 ' || replace(url, '\"', '') || '.\"' FROM pages",
)
def entities_round_trip(spark, sf):
    """Typed entities and odd literals written and read back."""
    title = F.concat(F.lit('"2^10 '), F.replace("url", F.lit('"'), F.lit("")), F.lit('."'))
    odd = table(spark, sf, "pages").select(
        F.concat(F.lit("urn:page:"), _str("page_id")).alias("subject"), F.lit("urn:title").alias("predicate"), title.alias("object")
    )
    path = shared_folder(spark, "round-trip")
    sinks.write_entities(en.aggregate_entities(doc_triples(spark, sf).unionByName(odd)), path)
    return rdf.read_ntriples(spark, path)


@query(
    "src_ntriples_rejects",
    "SELECT '<urn:c:' || c_custkey || '> <urn:segment> ' || c_mktsegment || ' .' AS value FROM customer",
)
def src_ntriples_rejects(spark, sf):
    """Lines that are neither triples nor comments."""
    return rdf.rejected_lines(_customer_lines(spark, sf))


@query(
    "csv_to_triples",
    f"""SELECT 'urn:' || p_partkey AS subject, '{en.RDF_TYPE}' AS predicate, 'urn:Part' AS object FROM part
UNION ALL SELECT 'urn:' || p_partkey, 'urn:p_name', '"' || p_name || '"' FROM part
UNION ALL SELECT 'urn:' || p_partkey, 'urn:p_size', '"' || p_size || '"' FROM part""",
)
def csv_to_triples(spark, sf):
    path = shared_folder(spark, "parts")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.csv(path, header=True)
    return en.to_triples(spark.read.csv(path, header=True), "p_partkey", ["p_name", "p_size"], "urn:Part", "urn:")


@query("repartition_text", "SELECT url AS value FROM pages")
def repartition_text(spark, sf):
    path = _text(spark, table(spark, sf, "pages").select(F.col("url").alias("value")), "urls")
    out = shared_folder(spark, "urls-again")
    sinks.repartition_text(spark, path, out, 5)
    return spark.read.text(out)
