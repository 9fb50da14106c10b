"""Vectors, numbers, dates, points, shapes and boxes.

Shapes: an order is a few points around a place, both derived from its columns.
Source: orders with status F; target: the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import SQL_VALUES, table
from entitylink.operators import geojoin as gj
from entitylink.operators import rangejoin as rj


def _r(df):
    return df.withColumn("sim", F.round("sim", 6)).drop("key_s", "key_t")


def _events(spark, sf):
    v = F.array(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 3600000000, F.col("value"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), v.alias("v"), "event_type")
    clicks = F.col("event_type").isin("click", "view")
    return e.where(clicks).select("id", "v"), e.where(~clicks).select("id", "v")


SQL_EUCLIDEAN = """WITH e AS (SELECT event_id AS id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000::DOUBLE AS x, value AS y, event_type IN ('click', 'view') AS s FROM events),
vs AS (SELECT x, y, min(id) AS source, count(*) AS n_source FROM e WHERE s GROUP BY x, y),
vt AS (SELECT x, y, min(id) AS target, count(*) AS n_target FROM e WHERE NOT s GROUP BY x, y),
d AS (SELECT source, target, n_source, n_target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM vs a JOIN vt b ON b.x BETWEEN a.x - 0.251 AND a.x + 0.251 AND b.y BETWEEN a.y - 0.251 AND a.y + 0.251)
SELECT source, target, round(1 / (1 + d), 6) AS sim, n_source, n_target FROM d WHERE d <= 0.25"""


@query("euclidean_join_fine", SQL_EUCLIDEAN)
def euclidean_join_fine(spark, sf):
    """The same with cells a third as wide as the radius."""
    return _r(rj.euclidean_join(*_events(spark, sf), "id", "v", 0.8, granularity=3))


@query("euclidean_join", SQL_EUCLIDEAN)
def euclidean_join(spark, sf):
    """Events by hour and value."""
    return _r(rj.euclidean_join(*_events(spark, sf), "id", "v", 0.8))


@query(
    "euclidean_sets_join",
    """WITH prices AS (SELECT o_custkey AS id, array_agg(DISTINCT o_totalprice::DOUBLE / 1000 ORDER BY o_totalprice::DOUBLE / 1000) AS ps FROM orders GROUP BY 1),
e AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS s, ps, c_acctbal::DOUBLE / 100 AS b FROM customer JOIN prices ON id = c_custkey),
v AS (SELECT ps, b, s, min(id) AS id, count(*) AS n FROM e GROUP BY ps, b, s),
x AS (SELECT id, s, n, b, unnest(ps) AS p FROM v),
d AS (SELECT a.id AS source, c.id AS target, a.n AS n_source, c.n AS n_target, sqrt(pow(min(abs(a.p - c.p)), 2) + pow(any_value(abs(a.b - c.b)), 2)) AS d
  FROM x a JOIN x c ON a.s AND NOT c.s AND c.b BETWEEN a.b - 0.26 AND a.b + 0.26 GROUP BY a.id, c.id, a.n, c.n)
SELECT source, target, round(1 / (1 + d), 6) AS sim, n_source, n_target FROM d WHERE d <= (1 - 0.8::DOUBLE) / 0.8""",
)
def euclidean_sets_join(spark, sf):
    """Customers by balance and the nearest two of their order totals."""
    prices = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.col("o_totalprice").cast("double") / 1000).alias("ps"))
    rows = table(spark, sf, "customer").join(prices, "c_custkey")
    rows = rows.select(F.col("c_custkey").alias("id"), F.array(F.array(F.col("c_acctbal").cast("double") / 100), "ps").alias("v"), "c_mktsegment")
    return _r(rj.euclidean_sets_join(rows.where("c_mktsegment = 'BUILDING'"), rows.where("c_mktsegment <> 'BUILDING'"), "id", "v", 0.8))


@query(
    "numeric_range_join",
    f"""WITH ds AS (SELECT s_suppkey AS id, s_acctbal AS value FROM supplier), dt AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer), {SQL_VALUES}
SELECT source, target, round(1 / (1 + abs(vs.value - vt.value)), 6) AS sim, n_source, n_target
FROM vs JOIN vt ON abs(vs.value - vt.value) <= (1 - 0.51::DOUBLE) / 0.51""",
)
def numeric_range_join(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return _r(rj.numeric_range_join(s, c, "id", "v", 0.51))


SQL_DATES = f"""WITH ds AS (SELECT o_orderkey AS id, o_orderdate::DATE AS value FROM orders),
dt AS (SELECT l_orderkey AS id, l_shipdate::DATE AS value FROM lineitem), {SQL_VALUES},
d AS (SELECT source, target, n_source, n_target, abs(date_diff('day', vs.value, vt.value)) AS d FROM vs, vt)
"""


def _dates(spark, sf, theta, measure):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("day"))
    return _r(rj.date_join(o, l, "id", "day", theta, measure))


@query("date_join_exp", SQL_DATES + "SELECT source, target, round(exp(d * -0.01::DOUBLE), 6) AS sim, n_source, n_target FROM d WHERE exp(d * -0.01::DOUBLE) >= 0.945")
def date_join_exp(spark, sf):
    return _dates(spark, sf, 0.945, "exp")


@query("date_join_day", SQL_DATES + "SELECT source, target, round((365 - d) / 365::DOUBLE, 6) AS sim, n_source, n_target FROM d WHERE (365 - d) / 365::DOUBLE >= 0.981")
def date_join_day(spark, sf):
    return _dates(spark, sf, 0.981, "day")


@query("date_join_year", SQL_DATES + "SELECT source, target, round((3650 - d) / 3650::DOUBLE, 6) AS sim, n_source, n_target FROM d WHERE (3650 - d) / 3650::DOUBLE >= 0.9985")
def date_join_year(spark, sf):
    return _dates(spark, sf, 0.9985, "year")


def _place():
    """Latitude in [-80, 80) from the price, longitude in [-180, 180) from the key."""
    lat = (F.col("o_totalprice") * 100) % 16000 / 100 - 80
    lon = (F.col("o_orderkey") * 7919) % 36000 / 100 - 180
    return lat, lon


def _shapes(spark, sf):
    """1 to 5 points (by priority) within a tenth of a degree of the order's place."""
    lat, lon = _place()
    points = F.sequence(F.lit(1), F.substring("o_orderpriority", 1, 1).cast("int"))

    def point(k):
        y = F.col("lat") + (F.col("o_custkey") * (k + 3)) % 97 / 970
        x = F.col("lon") + (F.col("o_orderkey") * (k + 5)) % 89 / 890
        return F.struct(y.alias("lat"), x.alias("lon"))

    o = table(spark, sf, "orders").withColumns({"lat": lat, "lon": lon})
    shapes = o.select(F.col("o_orderkey").alias("id"), F.transform(points, point).alias("pts"), F.col("o_orderstatus").alias("st"))
    return shapes.where("st = 'F'").drop("st"), shapes.where("st <> 'F'").drop("st")


THETA = 0.05  # 19 km

SQL_HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
HAV = SQL_HAVERSINE.format(a="a.", b="b.")

SQL_PLACES = """WITH o AS (SELECT o_orderkey AS id, (o_totalprice * 100) % 16000 / 100 - 80 AS lat,
  (o_orderkey * 7919) % 36000 / 100::DOUBLE - 180 AS lon, o_orderstatus = 'F' AS s FROM orders)
"""
SQL_SHAPES = SQL_PLACES + f""", pts AS (SELECT id, s, k AS pos, lat + (o_custkey * (k + 3)) % 97 / 970::DOUBLE AS lat, lon + (o_orderkey * (k + 5)) % 89 / 890::DOUBLE AS lon
  FROM (SELECT o.*, o_custkey, o_orderkey, unnest(range(1, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 1)) AS k FROM o JOIN orders ON o_orderkey = id)),
near AS (SELECT DISTINCT a.id AS source, b.id AS target FROM pts a JOIN pts b ON a.s AND NOT b.s AND b.lat BETWEEN a.lat - 0.18 AND a.lat + 0.18
  WHERE {HAV} <= 19.000001),
d AS (SELECT source, target, a.pos AS i, b.pos AS j, {HAV} AS d
  FROM near JOIN pts a ON a.id = source JOIN pts b ON b.id = target),
sx AS (SELECT source, target, i, min(d) AS m FROM d GROUP BY ALL),
sy AS (SELECT source, target, j, min(d) AS m FROM d GROUP BY ALL),
n AS (SELECT id, count(*) AS n FROM pts GROUP BY id),
near_n AS (SELECT source, target, x.n AS nx, y.n AS ny FROM near JOIN n x ON x.id = source JOIN n y ON y.id = target)
"""
SQL_SIM = "SELECT source, target, round(1 / (1 + d), 6) AS sim FROM ({}) q WHERE d <= 1 / 0.05::DOUBLE - 1"


@query(
    "geo_point_join",
    SQL_PLACES + "SELECT source, target, round(1 / (1 + d), 6) AS sim FROM (SELECT a.id AS source, b.id AS target, "
    + HAV + " AS d FROM o a JOIN o b ON a.s AND NOT b.s AND b.lat BETWEEN a.lat - 0.18 AND a.lat + 0.18) q WHERE d <= 1 / 0.05::DOUBLE - 1",
)
def geo_point_join(spark, sf):
    return _r(gj.point_join(*_points(spark, sf), "id", "p", THETA))


def _points(spark, sf):
    lat, lon = _place()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("p"), F.col("o_orderstatus").alias("st"))
    return o.where("st = 'F'").drop("st"), o.where("st <> 'F'").drop("st")


# Vincenty's inverse formula on the ellipsoid of WGS84, for pairs that the sphere does not put more
# than its 0.6 % error beyond reach; below 20 km the steps settle after about eight.
_RAD = "pi() / 180"
SQL_ELLIPSOID = SQL_PLACES + f""", p AS (SELECT a.id AS source, b.id AS target, a.lat AS la, b.lat AS lb, (b.lon - a.lon) * {_RAD} AS turn
  FROM o a JOIN o b ON a.s AND NOT b.s AND b.lat BETWEEN a.lat - 0.19 AND a.lat + 0.19 WHERE {HAV} <= 19.2),
u AS (SELECT source, target, turn - 2 * pi() * floor((turn + pi()) / (2 * pi())) AS l, atan((1 - f) * tan(la * {_RAD})) AS u1, atan((1 - f) * tan(lb * {_RAD})) AS u2
  FROM p, (SELECT 1 / 298.257223563 AS f)),
t AS (SELECT source, target, l, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM u),
it AS (SELECT *, list_reduce(range(12), lambda lam, k: l + list_transform([{{'s': sqrt((c2 * sin(lam)) * (c2 * sin(lam)) + (c1 * s2 - s1 * c2 * cos(lam)) * (c1 * s2 - s1 * c2 * cos(lam))),
      'c': s1 * s2 + c1 * c2 * cos(lam)}}], lambda x: list_transform([{{'a': CASE WHEN x.s = 0 THEN 0 ELSE c1 * c2 * sin(lam) / x.s END}}],
      lambda y: list_transform([{{'q': 1 - y.a * y.a}}], lambda z: list_transform([{{'m': CASE WHEN z.q = 0 THEN 0 ELSE x.c - 2 * s1 * s2 / z.q END,
        'k': 1 / 298.257223563 / 16 * z.q * (4 + 1 / 298.257223563 * (4 - 3 * z.q))}}],
      lambda w: (1 - w.k) / 298.257223563 * y.a * (atan2(x.s, x.c) + w.k * x.s * (w.m + w.k * x.c * (2 * w.m * w.m - 1))))[1])[1])[1])[1], l) AS lam FROM t),
e AS (SELECT *, sqrt((c2 * sin(lam)) * (c2 * sin(lam)) + (c1 * s2 - s1 * c2 * cos(lam)) * (c1 * s2 - s1 * c2 * cos(lam))) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM it),
g AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa, 6378137 * (1 - 1 / 298.257223563) AS b FROM e),
h AS (SELECT *, 1 - sa * sa AS q, (1 - sa * sa) * (6378137.0::DOUBLE * 6378137 - b * b) / (b * b) AS w FROM g),
k AS (SELECT *, CASE WHEN q = 0 THEN 0 ELSE cs - 2 * s1 * s2 / q END AS m, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS aa,
  w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS bb FROM h),
far AS (SELECT source, target, b * aa * (atan2(ss, cs) - bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1) - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) / 1000 AS d FROM k)
SELECT source, target, round(1 / (1 + d), 6) AS sim FROM far WHERE d <= 1 / 0.05::DOUBLE - 1"""


@query("geo_point_join_ellipsoid", SQL_ELLIPSOID)
def geo_point_join_ellipsoid(spark, sf):
    return _r(gj.point_join(*_points(spark, sf), "id", "p", THETA, "ellipsoid"))


def _shape_query(name: str, sql: str | None):
    @query(f"geo_{name}", None if sql is None else SQL_SHAPES + SQL_SIM.format(sql))
    def run(spark, sf):
        return _r(gj.shape_join(*_shapes(spark, sf), "id", "pts", THETA, name))


_shape_query("hausdorff", "SELECT source, target, max(m) AS d FROM sx GROUP BY ALL")
_shape_query("sym_hausdorff", "SELECT source, target, max(m) AS d FROM (SELECT source, target, m FROM sx UNION ALL SELECT source, target, m FROM sy) GROUP BY ALL")
_shape_query("min", "SELECT source, target, min(d) AS d FROM d GROUP BY ALL")
_shape_query("max", "SELECT source, target, max(d) AS d FROM d GROUP BY ALL")
_shape_query("avg", "SELECT source, target, avg(d) AS d FROM d GROUP BY ALL")
_shape_query(
    "mean",
    "SELECT a.id AS source, b.id AS target, " + HAV + """ AS d FROM (SELECT id, s, avg(lat) AS lat, avg(lon) AS lon FROM pts GROUP BY id, s) a
  JOIN (SELECT id, s, avg(lat) AS lat, avg(lon) AS lon FROM pts GROUP BY id, s) b ON a.s AND NOT b.s AND b.lat BETWEEN a.lat - 0.18 AND a.lat + 0.18""",
)
_shape_query("sum_of_min", "SELECT source, target, sum(m) / 2 AS d FROM (SELECT source, target, m FROM sx UNION ALL SELECT source, target, m FROM sy) GROUP BY ALL")
LINK = """SELECT source, target, sum(d) AS d FROM (
  SELECT source, target, d, nx, ny, row_number() OVER (PARTITION BY source, target, CASE WHEN nx < ny THEN i ELSE j END ORDER BY d) AS k
  FROM d JOIN near_n USING (source, target)) WHERE k <= ceil(greatest(nx, ny)::DOUBLE / least(nx, ny)) GROUP BY ALL"""
_shape_query("link", LINK)
_shape_query("fair_surjection", LINK)
SQL_SURJECTION = """, sized AS (SELECT source, target, nx, ny, CASE WHEN nx < ny THEN i ELSE j END AS k, CASE WHEN nx < ny THEN j ELSE i END AS l, d
  FROM d JOIN near_n USING (source, target)),
lists AS (SELECT source, target, k, list({'d': d, 'l': l}) AS a, least(any_value(nx), any_value(ny)) AS n FROM sized GROUP BY source, target, k),
take(source, target, k, used, total) AS (
  SELECT DISTINCT source, target, 0::BIGINT, []::BIGINT[], 0.0::DOUBLE FROM lists
  UNION ALL
  SELECT source, target, k, list_append(used, best.l), total + best.d FROM (
    SELECT t.source, t.target, l.k, t.used, t.total, list_min(list_filter(l.a, lambda x: NOT list_contains(t.used, x.l))) AS best
    FROM take t JOIN lists l ON l.source = t.source AND l.target = t.target AND l.k = t.k + 1)),
done AS (SELECT t.* FROM take t JOIN (SELECT source, target, max(k) AS k FROM take GROUP BY ALL) USING (source, target, k)),
rest AS (SELECT source, target, l, min(d) AS m FROM sized GROUP BY ALL),
surjection AS (SELECT source, target, total + coalesce((SELECT sum(m) FROM rest r WHERE r.source = done.source AND r.target = done.target
  AND NOT list_contains(used, l)), 0) AS d FROM done)
"""
# All monotone walks over the cells of a pair, with the largest distance on the way.
SQL_FRECHET = """, walk(source, target, i, j, m) AS (
  SELECT source, target, i, j, d FROM d WHERE i = 1 AND j = 1
  UNION
  SELECT w.source, w.target, d.i, d.j, greatest(w.m, d.d) FROM walk w JOIN d ON d.source = w.source AND d.target = w.target
    AND (d.i, d.j) IN ((w.i + 1, w.j), (w.i, w.j + 1), (w.i + 1, w.j + 1))),
frechet AS (SELECT source, target, min(m) AS d FROM walk JOIN near_n USING (source, target) WHERE i = nx AND j = ny GROUP BY ALL)
"""


def _walked(name: str, body: str):
    @query(f"geo_{name}", SQL_SHAPES.replace("WITH ", "WITH RECURSIVE ", 1) + body + SQL_SIM.format(f"SELECT * FROM {name}"))
    def run(spark, sf):
        return _r(gj.shape_join(*_shapes(spark, sf), "id", "pts", THETA, name))


_walked("surjection", SQL_SURJECTION)
_walked("frechet", SQL_FRECHET)


@query("geo_frechet_continuous", None)
def geo_frechet_continuous(spark, sf):
    return _r(gj.line_join(*_shapes(spark, sf), "id", "pts", THETA))


def _boxes(spark, sf):
    """Half-degree boxes: size from priority and month."""
    lat, lon = (F.floor(x * 2) / 2 for x in _place())
    high = F.substring("o_orderpriority", 1, 1).cast("int") * 0.5
    wide = (F.month("o_orderdate") % 3 + 1) * 0.5
    box = F.struct(lat.alias("lat_lo"), (lat + high).alias("lat_hi"), lon.alias("lon_lo"), (lon + wide).alias("lon_hi"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), box.alias("box"), F.col("o_orderstatus").alias("st"))
    return o.where("st = 'F'").drop("st"), o.where("st <> 'F'").drop("st")


SQL_BOXES = SQL_PLACES + """, boxes AS (SELECT id, s, floor(lat * 2) / 2 AS y0, floor(lat * 2) / 2 + CAST(substr(o_orderpriority, 1, 1) AS INT) * 0.5::DOUBLE AS y1,
  floor(lon * 2) / 2 AS x0, floor(lon * 2) / 2 + (month(o_orderdate) % 3 + 1) * 0.5::DOUBLE AS x1 FROM o JOIN orders ON o_orderkey = id),
meet AS (SELECT a.id AS source, b.id AS target, a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1 AS inner_,
    a.y0 >= b.y0 AND a.y1 <= b.y1 AND a.x0 >= b.x0 AND a.x1 <= b.x1 AS within_, b.y0 >= a.y0 AND b.y1 <= a.y1 AND b.x0 >= a.x0 AND b.x1 <= a.x1 AS contains_
  FROM boxes a JOIN boxes b ON a.s AND NOT b.s AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.x0 <= b.x1 AND b.x0 <= a.x1)
"""


def _topo(relation: str, where: str):
    @query(f"topo_{relation}", SQL_BOXES + f"SELECT source, target, 1.0::DOUBLE AS sim FROM meet WHERE {where}")
    def run(spark, sf):
        return gj.topology_join(*_boxes(spark, sf), "id", "box", relation)


_topo("equals", "within_ AND contains_")
_topo("intersects", "true")
_topo("touches", "NOT inner_")
_topo("within", "within_")
_topo("contains", "contains_")
_topo("overlaps", "inner_ AND NOT within_ AND NOT contains_")


@query("topo_disjoint", SQL_BOXES + """SELECT id AS source, (SELECT count(*) FROM boxes WHERE NOT s) - count(target) AS disjoint
FROM boxes LEFT JOIN meet ON source = id WHERE s GROUP BY id""")
def topo_disjoint(spark, sf):
    return gj.disjoint_counts(*_boxes(spark, sf), "id", "box")


@query("topo_disjoint_links", SQL_BOXES + """SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem
JOIN boxes a ON a.id = l_orderkey AND a.s JOIN boxes b ON b.id = l_partkey AND NOT b.s ANTI JOIN meet ON source = l_orderkey AND target = l_partkey""")
def topo_disjoint_links(spark, sf):
    """Disjointness of given links: each line's order against the order with its part's number."""
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return gj.relate(links, *_boxes(spark, sf), "id", "box", "disjoint")


@query(
    "topo_crosses",
    SQL_SHAPES + """, seg AS (SELECT p.id, p.s, p.lat AS y0, p.lon AS x0, q.lat AS y1, q.lon AS x1 FROM pts p JOIN pts q ON q.id = p.id AND q.pos = p.pos + 1)
SELECT DISTINCT a.id AS source, b.id AS target, 1.0::DOUBLE AS sim FROM seg a JOIN seg b ON a.s AND NOT b.s AND b.y0 BETWEEN a.y0 - 0.3 AND a.y0 + 0.3
WHERE abs(a.x0 - b.x0) < 1
AND sign((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * sign((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) < 0
AND sign((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * sign((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) < 0""",
)
def topo_crosses(spark, sf):
    return gj.crossing_lines(*_shapes(spark, sf), "id", "pts")


def _diamonds(spark, sf):
    """Diamonds around the orders' places: size from priority and month."""
    lat, lon = _place()
    high = F.substring("o_orderpriority", 1, 1).cast("int") * 0.25 + 0.1
    wide = (F.month("o_orderdate") % 3 + 1) * 0.3
    corner = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    ring = F.array(corner(lat - high, lon), corner(lat, lon + wide), corner(lat + high, lon), corner(lat, lon - wide))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ring.alias("pts"), F.col("o_orderstatus").alias("st"))
    return o.where("st = 'F'").drop("st"), o.where("st <> 'F'").drop("st")


_TURN = "sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _turns(a, b, c, d):
    return _TURN.format(a=a, b=b, c=c) + " * " + _TURN.format(a=a, b=b, c=d)


SQL_DIAMONDS = SQL_PLACES + f""", g AS (SELECT id, s, lat, lon, CAST(substr(o_orderpriority, 1, 1) AS INT) * 0.25::DOUBLE + 0.1::DOUBLE AS h, (month(o_orderdate) % 3 + 1) * 0.3::DOUBLE AS w
  FROM o JOIN orders ON o_orderkey = id),
corner AS (SELECT id, s, 0 AS k, lat - h AS y, lon AS x FROM g UNION ALL SELECT id, s, 1, lat, lon + w FROM g
  UNION ALL SELECT id, s, 2, lat + h, lon FROM g UNION ALL SELECT id, s, 3, lat, lon - w FROM g),
edge AS (SELECT c.id, c.y AS py, c.x AS px, d.y AS qy, d.x AS qx FROM corner c JOIN corner d ON d.id = c.id AND d.k = (c.k + 1) % 4),
near AS (SELECT a.id AS source, b.id AS target FROM g a JOIN g b ON a.s AND NOT b.s
  AND a.lat - a.h <= b.lat + b.h AND b.lat - b.h <= a.lat + a.h AND a.lon - a.w <= b.lon + b.w AND b.lon - b.w <= a.lon + a.w),
cross_ AS (SELECT source, target,
    bool_or({_turns("e.p", "e.q", "f.p", "f.q")} < 0 AND {_turns("f.p", "f.q", "e.p", "e.q")} < 0) AS pass,
    bool_or({_turns("e.p", "e.q", "f.p", "f.q")} <= 0 AND {_turns("f.p", "f.q", "e.p", "e.q")} <= 0
      AND greatest(f.py, f.qy) >= least(e.py, e.qy) AND least(f.py, f.qy) <= greatest(e.py, e.qy)
      AND greatest(f.px, f.qx) >= least(e.px, e.qx) AND least(f.px, f.qx) <= greatest(e.px, e.qx)) AS meet
  FROM near JOIN edge e ON e.id = source JOIN edge f ON f.id = target GROUP BY source, target),
hit AS (SELECT source, target, c.id AS own, c.k, count(*) FILTER (WHERE (e.py > c.y) <> (e.qy > c.y) AND c.x < (e.qx - e.px) * (c.y - e.py) / nullif(e.qy - e.py, 0) + e.px) % 2 = 1 AS inside
  FROM (SELECT source, target, source AS a, target AS b FROM near UNION ALL SELECT source, target, target, source FROM near)
  JOIN corner c ON c.id = a JOIN edge e ON e.id = b GROUP BY ALL),
corners AS (SELECT source, target, bool_and(inside) FILTER (WHERE own = source) AS all_s, bool_and(inside) FILTER (WHERE own = target) AS all_t,
    bool_or(inside) AS any_, bool_or(inside AND k = 0) AS first FROM hit GROUP BY source, target),
rel AS (SELECT source, target, meet OR first AS intersects, all_s AND NOT pass AS within, all_t AND NOT pass AS contains, pass OR any_ AS common
  FROM cross_ JOIN corners USING (source, target))
SELECT source, target, 1.0::DOUBLE AS sim FROM rel WHERE """


def _polygon_query(relation: str, where: str):
    @query(f"polygon_{relation}", SQL_DIAMONDS + where)
    def run(spark, sf):
        return gj.polygon_join(*_diamonds(spark, sf), "id", "pts", relation)


_polygon_query("intersects", "intersects")
_polygon_query("within", "within")
_polygon_query("contains", "contains")
_polygon_query("overlaps", "common AND NOT within AND NOT contains")
_polygon_query("touches", "intersects AND NOT common")


# Parcels: customers as regions on a lattice, two and two on the same place, so that
# neighbours share borders and corners. The shapes (lat, lon from the place),
# the second ring a hole or an island; and the lines.
PARCELS = [
    [[(0, 0), (0, 2), (2, 2), (2, 0)]],
    [[(0, 0), (0, 1), (2, 1), (2, 0)]],
    [[(0, 0), (0, 3), (1, 3), (1, 1), (3, 1), (3, 0)]],
    [[(1, 0), (2, 1), (1, 2), (0, 1)]],
    [[(0, 0), (0, 3), (3, 3), (3, 0)], [(1, 1), (1, 2), (2, 2), (2, 1)]],
    [[(0, 0), (0, 2), (2, 0)]],
    [[(0, 0), (0, 1), (1, 1), (1, 0)], [(1, 1), (1, 2), (2, 2), (2, 1)]],
]
PATHS = [[(0, 0), (3, 3)], [(1, 0), (1, 2)], [(0, 0), (0, 2), (1, 2)], [(2, 0), (0, 2)], [(0, 1), (1, 1), (2, 2), (2, 0)]]


def _ring(shape, y, x):
    return F.array(*[F.struct((y + p).cast("double").alias("lat"), (x + q).cast("double").alias("lon")) for p, q in shape])


def _parcels(spark, sf):
    c = table(spark, sf, "customer")
    j = F.expr("c_custkey div 2")
    y, x = j % 60, F.expr("c_custkey div 120")
    kind, way = F.pmod("c_nationkey", F.lit(len(PARCELS))), F.pmod("c_nationkey", F.lit(len(PATHS)))
    region = F.array(*[_ring(r, y, x) for r in PARCELS[0]])
    for k, shape in enumerate(PARCELS):
        region = F.when(kind == k, F.array(*[_ring(r, y, x) for r in shape])).otherwise(region)
    path = _ring(PATHS[0], y, x)
    for k, shape in enumerate(PATHS):
        path = F.when(way == k, _ring(shape, y, x)).otherwise(path)
    return c.select(F.col("c_custkey").alias("id"), region.alias("rings"), path.alias("path"), (F.col("c_custkey") % 2 == 0).alias("s"))


def _sides(spark, sf):
    p = _parcels(spark, sf)
    return p.where("s").select("id", "rings"), p.where("not s").select("id", "rings")


def _values(shapes):
    """(kind, part, py, px, qy, qx) of all edges of fixed rings, SQL."""
    rows = [(k, *p, *q) for k, rings in enumerate(shapes) for r in rings for p, q in zip(r, r[1:] + r[:1])]
    return ", ".join(str(r) for r in rows)


# All borders run along the lattice or its diagonals, so quarter points of the lattice lie in
# every face, edge and corner of whatever two shapes cut each other into: relations are
# those of their sets of quarter points, 'in' or 'on' the border.
SQL_PARCELS = f"""WITH edge(kind, py, px, qy, qx) AS (VALUES {_values(PARCELS)}),
grid AS (SELECT a.i / 4::DOUBLE AS y, b.i / 4::DOUBLE AS x FROM range(13) a(i), range(13) b(i)),
sample AS (SELECT kind, y, x,
    bool_or((qx - px) * (y - py) = (qy - py) * (x - px) AND y BETWEEN least(py, qy) AND greatest(py, qy) AND x BETWEEN least(px, qx) AND greatest(px, qx)) AS on_,
    count(*) FILTER ((py > y) <> (qy > y) AND x < (qx - px) * (y - py) / nullif(qy - py, 0) + px) % 2 = 1 AS in_
  FROM edge, grid GROUP BY kind, y, x),
parcel AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS s, c_nationkey % {len(PARCELS)} AS kind, c_nationkey % {len(PATHS)} AS way, (c_custkey // 2) % 60 AS oy, c_custkey // 120 AS ox FROM customer),
pts AS (SELECT id, s, y + oy AS y, x + ox AS x, in_ AND NOT on_ AS inner_ FROM parcel JOIN sample USING (kind) WHERE in_ OR on_),
size AS (SELECT id, count(*) FILTER (inner_) AS n FROM pts GROUP BY id),
"""
# A region lies within another if each of its inner points is there, inside or on the border.
SQL_REGIONS = SQL_PARCELS + """meet AS (SELECT a.id AS source, b.id AS target, count(*) FILTER (a.inner_ AND b.inner_) AS both_,
    count(*) FILTER (a.inner_ AND NOT b.inner_) AS a_on, count(*) FILTER (b.inner_ AND NOT a.inner_) AS b_on
  FROM pts a JOIN pts b ON a.y = b.y AND a.x = b.x WHERE a.s AND NOT b.s GROUP BY a.id, b.id),
rel AS (SELECT source, target, both_ > 0 AS common, both_ + a_on = m.n AND both_ > 0 AS within_, both_ + b_on = o.n AND both_ > 0 AS contains_
  FROM meet JOIN size m ON m.id = source JOIN size o ON o.id = target)
SELECT source, target, 1.0::DOUBLE AS sim FROM rel WHERE """


def _region_query(relation: str, where: str):
    @query(f"region_{relation}", SQL_REGIONS + where)
    def run(spark, sf):
        return gj.region_join(*_sides(spark, sf), "id", "rings", relation)


_region_query("intersects", "true")
_region_query("touches", "NOT common")
_region_query("within", "within_")
_region_query("contains", "contains_")
_region_query("equals", "within_ AND contains_")
_region_query("overlaps", "common AND NOT within_ AND NOT contains_")


@query("region_disjoint_links", SQL_REGIONS.split("rel AS")[0].rstrip().rstrip(",") + """
SELECT p.id AS source, q.id AS target FROM parcel p JOIN parcel q ON p.s AND NOT q.s AND q.oy = p.oy AND q.ox BETWEEN p.ox - 5 AND p.ox + 5
ANTI JOIN meet ON source = p.id AND target = q.id""")
def region_disjoint_links(spark, sf):
    """Disjointness of given links: parcels of one row of the lattice, at most five columns apart."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 2 % 60").alias("y"), F.expr("c_custkey div 120").alias("x"))
    s, t = c.where("id % 2 = 0").withColumn("x", F.explode(F.sequence(F.col("x") - 5, F.col("x") + 5))), c.where("id % 2 = 1")
    links = s.withColumnRenamed("id", "source").join(t.withColumnRenamed("id", "target"), ["y", "x"]).select("source", "target")
    return gj.relate_regions(links, *_sides(spark, sf), "id", "rings", "disjoint")


_STEPS = ", ".join(str((k, p[0] + (q[0] - p[0]) * i / 12, p[1] + (q[1] - p[1]) * i / 12)) for k, w in enumerate(PATHS) for p, q in zip(w, w[1:]) for i in range(13))


@query("region_line_crosses", SQL_PARCELS + f"""step AS (SELECT way, y::DOUBLE AS y, x::DOUBLE AS x FROM (VALUES {_STEPS}) v(way, y, x)),
path AS (SELECT DISTINCT id, y + oy AS y, x + ox AS x FROM parcel JOIN step USING (way) WHERE NOT s AND (y * 4::DOUBLE) = floor(y * 4::DOUBLE) AND (x * 4::DOUBLE) = floor(x * 4::DOUBLE)),
hit AS (SELECT path.id AS source, pts.id AS target, count(*) FILTER (inner_) AS inner_, count(*) AS n FROM path JOIN pts ON pts.s AND pts.y = path.y AND pts.x = path.x GROUP BY ALL)
SELECT source, target, 1.0::DOUBLE AS sim FROM hit WHERE inner_ > 0 AND n < (SELECT count(*) FROM path WHERE path.id = source)""")
def region_line_crosses(spark, sf):
    """Paths of the odd customers against the parcels of the even ones."""
    p = _parcels(spark, sf)
    return gj.line_region_join(p.where("not s").select("id", F.col("path").alias("shape")), p.where("s").select("id", F.col("rings").alias("shape")), "id", "shape", "crosses")
