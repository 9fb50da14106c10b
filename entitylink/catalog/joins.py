"""String similarity joins over document texts and page titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import SQL_DOCUMENTS, SQL_PAGES, SQL_VALUES, documents, pages, table
from entitylink.operators import editjoin, setjoin
from entitylink.operators.values import expand_links, value_members

def _round(df):
    return df.withColumn("sim", F.round("sim", 6)).drop("key_s", "key_t")


SQL_BAGS = f"""WITH {SQL_DOCUMENTS}, {SQL_VALUES},
words AS (
  SELECT side, id, w, count(*) AS c FROM (
    SELECT 's' AS side, source AS id, unnest(regexp_split_to_array(value, '[ .,?!\\t]')) AS w FROM vs
    UNION ALL SELECT 't', target, unnest(regexp_split_to_array(value, '[ .,?!\\t]')) FROM vt)
  WHERE w <> '' GROUP BY ALL),
n AS (SELECT side, id, sum(c) AS n FROM words GROUP BY ALL),
common AS (
  SELECT a.id AS source, b.id AS target, CAST(sum(least(a.c, b.c)) AS DOUBLE) AS o
  FROM words a JOIN words b ON a.w = b.w AND a.side = 's' AND b.side = 't' GROUP BY ALL),
scored AS (
  SELECT source, target, o, CAST(x.n AS DOUBLE) AS a, CAST(y.n AS DOUBLE) AS b, n_source, n_target
  FROM common JOIN n x ON x.side = 's' AND x.id = source JOIN n y ON y.side = 't' AND y.id = target
  JOIN vs USING (source) JOIN vt USING (target))
"""


@query("exact_join", f"WITH {SQL_DOCUMENTS}, {SQL_VALUES} SELECT source, target, 1.0::DOUBLE AS sim, n_source, n_target FROM vs JOIN vt USING (value)")
def exact_join(spark, sf):
    return _round(setjoin.exact_join(*documents(spark, sf), "id", "text"))


def _bag_sql(sim: str, theta: float) -> str:
    return SQL_BAGS + f"SELECT source, target, round({sim}, 6) AS sim, n_source, n_target FROM scored WHERE {sim} >= {theta}"


@query("jaccard_join", _bag_sql("o / (a + b - o)", 0.45))
def jaccard_join(spark, sf):
    return _round(setjoin.jaccard_join(*documents(spark, sf), "id", "text", 0.45))


@query("cosine_join", _bag_sql("o / sqrt(a * b)", 0.6))
def cosine_join(spark, sf):
    return _round(setjoin.cosine_join(*documents(spark, sf), "id", "text", 0.6))


@query("dice_join", _bag_sql("2 * o / (a + b)", 0.55))
def dice_join(spark, sf):
    return _round(setjoin.dice_join(*documents(spark, sf), "id", "text", 0.55))


@query("overlap_join", _bag_sql("o", 150))
def overlap_join(spark, sf):
    return _round(setjoin.overlap_join(*documents(spark, sf), "id", "text", 150))


SQL_TITLES = f"WITH {SQL_PAGES}, {SQL_VALUES}"


@query("levenshtein_join", SQL_TITLES + """
SELECT source, target, round(1.0 / (1 + levenshtein(vs.value, vt.value)), 6) AS sim, n_source, n_target
FROM vs JOIN vt ON levenshtein(vs.value, vt.value) <= 4""")
def levenshtein_join(spark, sf):
    return _round(editjoin.levenshtein_join(*pages(spark, sf), "id", "title", 0.2))


SQL_GRAMS = """, base AS (
  SELECT 's' AS side, source AS id, {text} AS t FROM vs UNION ALL SELECT 't', target, {text} FROM vt),
grams AS (SELECT DISTINCT side, id, substr(t, i, {q}) AS g FROM (
  SELECT side, id, t, unnest(range(1, length(t) - {q} + 2)) AS i FROM base)),
n AS (SELECT side, id, CAST(count(*) AS DOUBLE) AS n FROM grams GROUP BY ALL),
common AS (SELECT a.id AS source, b.id AS target, CAST(count(*) AS DOUBLE) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.side = 's' AND b.side = 't' GROUP BY ALL),
scored AS (SELECT source, target, o, x.n AS a, y.n AS b, n_source, n_target
  FROM common JOIN n x ON x.side = 's' AND x.id = source JOIN n y ON y.side = 't' AND y.id = target
  JOIN vs USING (source) JOIN vt USING (target))
SELECT source, target, round({sim}, 6) AS sim, n_source, n_target FROM scored WHERE {sim} >= {theta}"""


@query("qgram_join", SQL_TITLES + SQL_GRAMS.format(
    text="rpad(trim(regexp_replace(value, ' {2,}', ' ', 'g')), CAST(greatest(3, length(trim(regexp_replace(value, ' {2,}', ' ', 'g')))) AS INT), '_')",
    q=3, sim="o / (a + b - o)", theta=0.3))
def qgram_join(spark, sf):
    return _round(setjoin.qgram_join(*pages(spark, sf), "id", "title", 0.3))


@query("bigram_dice_join", SQL_TITLES + SQL_GRAMS.format(text="'  ' || value || '  '", q=2, sim="2 * o / (a + b)", theta=0.65))
def bigram_dice_join(spark, sf):
    return _round(setjoin.bigram_dice_join(*pages(spark, sf), "id", "title", 0.65))


SQL_COMMON = """CASE WHEN a = '' THEN '' ELSE list_reduce(
  [{{'i': -1, 'rest': b, 'taken': ''}}] || list_transform(range(length(a)), lambda k: {{'i': CAST(k AS INT), 'rest': '', 'taken': ''}}),
  lambda st, e: CASE WHEN position(substr(a, e.i + 1, 1) IN {win}) > 0 THEN
    {{'i': e.i,
      'rest': substr(st.rest, 1, {lo} + position(substr(a, e.i + 1, 1) IN {win}) - 1) || chr(1)
              || substr(st.rest, {lo} + position(substr(a, e.i + 1, 1) IN {win}) + 1),
      'taken': st.taken || substr(a, e.i + 1, 1)}}
  ELSE {{'i': e.i, 'rest': st.rest, 'taken': st.taken}} END).{field} END"""


def _common_sql(a: str, b: str, back: str, ahead: str, field: str) -> str:
    lo = f"greatest(e.i - {back}, 0)"
    win = f"substr(st.rest, {lo} + 1, CAST(greatest(e.i + {ahead} - {lo}, 0) AS BIGINT))"
    text = SQL_COMMON.format(lo=lo, win=win, field=field)
    return text.replace("length(a)", f"length({a})").replace("substr(a,", f"substr({a},").replace("'rest': b", f"'rest': {b}").replace("WHEN a =", f"WHEN {a} =")


def _swaps_sql(x: str, y: str) -> str:
    return f"len(list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) <> substr({y}, i, 1))) // 2"


HALF = "(least(length(a), length(b)) // 2)"


@query("jaro_join", SQL_TITLES + f""", pairs AS (
  SELECT source, target, n_source, n_target, vs.value AS a, vt.value AS b FROM vs, vt),
c AS (SELECT *, {_common_sql("a", "b", HALF, HALF, "taken")} AS x, {_common_sql("b", "a", HALF, HALF, "taken")} AS y FROM pairs),
scored AS (SELECT *, (length(x)::DOUBLE / length(a) + length(x)::DOUBLE / length(b)
    + (length(x) - {_swaps_sql("x", "y")})::DOUBLE / length(x)) / 3 AS sim
  FROM c WHERE length(x) > 0 AND length(x) = length(y))
SELECT source, target, round(sim, 6) AS sim, n_source, n_target FROM scored WHERE sim >= 0.8""")
def jaro_join(spark, sf):
    return _round(editjoin.jaro_join(*pages(spark, sf), "id", "title", 0.8))


REACH = "(greatest(greatest(length(a), length(b)) // 2 - 1, 0))"

@query("jaro_winkler_join", f"""WITH {SQL_PAGES.replace(
    "regexp_extract(html, '<title>([^<]*)</title>', 1) AS value",
    "upper(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS value")}, {SQL_VALUES}, pairs AS (
  SELECT source, target, n_source, n_target, vs.value AS a, vt.value AS b FROM vs, vt),
c AS (SELECT *, {_common_sql("a", "b", REACH, "(" + REACH + " + 1)", "taken")} AS x, {_common_sql("a", "b", REACH, "(" + REACH + " + 1)", "rest")} AS rest FROM pairs),
d AS (SELECT *, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda i: substr(rest, i, 1) = chr(1)), lambda i: substr(b, i, 1)), '') AS y
  FROM c WHERE length(x) > 0),
j AS (SELECT *, (length(x)::DOUBLE / length(a) + length(x)::DOUBLE / length(b)
    + (length(x) - {_swaps_sql("x", "y")})::DOUBLE / length(x)) / 3 AS w FROM d),
lead AS (SELECT *, length(regexp_extract(
    array_to_string(list_transform(range(1, least(4, length(a), length(b)) + 1), lambda i:
      CASE WHEN substr(a, i, 1) = substr(b, i, 1) AND NOT regexp_matches(substr(a, i, 1), '[0-9]') THEN '=' ELSE '.' END), ''), '^=*')) AS k FROM j),
scored AS (SELECT *, CASE WHEN w > 0.7 THEN w + k * 0.1 * (1 - w) ELSE w END AS sim FROM lead)
SELECT source, target, round(sim, 6) AS sim, n_source, n_target FROM scored WHERE sim >= 0.87""")
def jaro_winkler_join(spark, sf):
    return _round(editjoin.jaro_winkler_join(*pages(spark, sf), "id", "title", 0.87))


# Maximal runs of equal characters on the diagonals of a pair; an open segment takes
# the longest part of a run inside it and leaves two segments.
SQL_RATCLIFF = f"""WITH RECURSIVE {SQL_PAGES.replace("regexp_extract(html, '<title>([^<]*)</title>', 1) AS value", "lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS value")}, {SQL_VALUES},
cs AS (SELECT source, value, unnest(range(1, length(value) + 1)) AS i FROM vs), ct AS (SELECT target, value, unnest(range(1, length(value) + 1)) AS j FROM vt),
hs AS (SELECT source, substr(value, i, 1) AS c, count(*) AS n FROM cs GROUP BY ALL), ht AS (SELECT target, substr(value, j, 1) AS c, count(*) AS n FROM ct GROUP BY ALL),
pairs AS (SELECT source, target, any_value(length(vs.value)) AS a, any_value(length(vt.value)) AS b, any_value(n_source) AS n_source, any_value(n_target) AS n_target
  FROM hs JOIN ht USING (c) JOIN vs USING (source) JOIN vt USING (target) GROUP BY source, target
  HAVING 2 * sum(least(hs.n, ht.n)) >= 0.75 * (any_value(length(vs.value)) + any_value(length(vt.value)))),
eq AS (SELECT source, target, i, j FROM pairs JOIN cs USING (source) JOIN ct USING (target) WHERE substr(cs.value, i, 1) = substr(ct.value, j, 1)),
runs AS (SELECT source, target, min(i) AS i, min(j) AS j, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY source, target, i - j ORDER BY i) AS g FROM eq) GROUP BY source, target, i - j, g),
open_(source, target, i, k, j, m) AS (
  SELECT source, target, 1::BIGINT, (a + 1)::BIGINT, 1::BIGINT, (b + 1)::BIGINT FROM pairs
  UNION ALL
  SELECT source, target, s.i, s.k, s.j, s.m FROM (SELECT source, target, unnest([{{'i': i, 'k': -best.i, 'j': j, 'm': -best.j}},
      {{'i': best.n - best.i, 'k': k, 'j': best.n - best.j, 'm': m}}]) AS s
    FROM (SELECT *, (SELECT max({{'n': least(r.i + r.n, o.k, o.m - r.j + r.i) - greatest(r.i, o.i, o.j - r.j + r.i),
        'i': -greatest(r.i, o.i, o.j - r.j + r.i), 'j': -(greatest(r.i, o.i, o.j - r.j + r.i) - r.i + r.j)}}) FROM runs r
        WHERE r.source = o.source AND r.target = o.target) AS best FROM open_ o) WHERE best.n > 0)),
taken AS (SELECT source, target, (SELECT max(least(r.i + r.n, o.k, o.m - r.j + r.i) - greatest(r.i, o.i, o.j - r.j + r.i)) FROM runs r
  WHERE r.source = o.source AND r.target = o.target) AS n FROM open_ o),
scored AS (SELECT source, target, n_source, n_target, 2 * sum(greatest(n, 0)) / (a + b)::DOUBLE AS sim FROM pairs JOIN taken USING (source, target) GROUP BY source, target, n_source, n_target, a, b)
SELECT source, target, round(sim, 6) AS sim, n_source, n_target FROM scored WHERE sim >= 0.75"""


@query("ratcliff_join", SQL_RATCLIFF)
def ratcliff_join(spark, sf):
    return _round(editjoin.ratcliff_join(*pages(spark, sf), "id", "title", 0.75))


def _soundex_sql(text: str) -> str:
    t = f"upper(replace({text}, 'ß', 'ss'))"  # upper-casing there keeps it as one letter
    for c in "BFPVCGJKQSXZDTLMNR":
        t = f"regexp_replace({t}, '{c}({c}|[HW]{c})', '{c}', 'g')"
    return t


@query("soundex_join", f"""WITH {SQL_PAGES.replace("dt AS", "dt_ AS").replace("ds AS", "ds_ AS")},
folded AS (SELECT 's' AS side, id, regexp_replace({_soundex_sql("value")}, '[AEIOUYHW]', '', 'g') AS t FROM ds_
  UNION ALL SELECT 't', id, regexp_replace({_soundex_sql("value")}, '[AEIOUYHW]', '', 'g') FROM dt_),
coded AS (SELECT side, id, rpad(substr(substr(t, 1, 1) || translate(regexp_replace(substr(t, 2), '[^BFPVCGJKQSXZDTLMNR]', '', 'g'),
  'BFPVCGJKQSXZDTLMNR', '111122222222334556'), 1, 6), 6, '0') AS value FROM folded),
ds AS (SELECT id, value FROM coded WHERE side = 's'), dt AS (SELECT id, value FROM coded WHERE side = 't'), {SQL_VALUES}
SELECT source, target, round(1 - h / 6.0::DOUBLE, 6) AS sim, n_source, n_target FROM (
  SELECT *, len(list_filter(range(1, 7), lambda i: substr(vs.value, i, 1) <> substr(vt.value, i, 1))) AS h FROM vs, vt)
WHERE h <= 1""")
def soundex_join(spark, sf):
    return _round(editjoin.soundex_join(*pages(spark, sf), "id", "title", 0.8))


@query("monge_elkan_join", SQL_TITLES + """,
ws AS (SELECT source, row_number() OVER () AS pos, w FROM (SELECT source, unnest(string_split(value, ' ')) AS w FROM vs) WHERE w <> ''),
wt AS (SELECT DISTINCT target, w FROM (SELECT target, unnest(string_split(value, ' ')) AS w FROM vt) WHERE w <> ''),
lex AS (SELECT DISTINCT w FROM (SELECT w FROM ws UNION ALL SELECT w FROM wt)),
grams AS (SELECT DISTINCT w, substr('  ' || w || '  ', i, 2) AS g FROM (SELECT w, unnest(range(1, length(w) + 4)) AS i FROM lex)),
n AS (SELECT w, CAST(count(*) AS DOUBLE) AS n FROM grams GROUP BY w),
sim AS (SELECT a.w AS w1, b.w AS w2, 2 * count(*) / (any_value(x.n) + any_value(y.n)) AS s
  FROM grams a JOIN grams b USING (g) JOIN n x ON x.w = a.w JOIN n y ON y.w = b.w GROUP BY ALL),
best AS (SELECT source, target, pos, max(s) AS s FROM ws JOIN sim ON w1 = ws.w JOIN wt ON wt.w = w2 GROUP BY ALL),
size AS (SELECT source, count(*) AS k FROM ws GROUP BY source),
scored AS (SELECT source, target, sum(s) / any_value(k) AS sim FROM best JOIN size USING (source) GROUP BY source, target)
SELECT source, target, round(sim, 6) AS sim, n_source, n_target
FROM scored JOIN vs USING (source) JOIN vt USING (target) WHERE sim >= 0.75""")
def monge_elkan_join(spark, sf):
    return _round(editjoin.monge_elkan_join(*pages(spark, sf), "id", "title", 0.75))


@query("expanded_links", "SELECT o_custkey AS source, o_orderkey AS target, 1.0::DOUBLE AS sim FROM orders JOIN customer ON c_custkey = o_custkey")
def expanded_links(spark, sf):
    """Entity pairs behind an exact join: customers and the orders that name them."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("v"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("v"))
    links = setjoin.exact_join(c, o, "id", "v")
    return expand_links(links, value_members(c, "id", "v"), value_members(o, "id", "v"))


@query("jaccard_multi_join", """WITH ds AS (SELECT p_partkey AS id, p_name AS value FROM part UNION ALL SELECT p_partkey, p_type || ' ' || p_brand FROM part),
dt AS (SELECT l_orderkey AS id, l_returnflag || ' ' || p_name AS value FROM lineitem JOIN part ON p_partkey = l_partkey), """ + SQL_VALUES + """,
ws AS (SELECT value, unnest(string_split(value, ' ')) AS w FROM vs), wt AS (SELECT value, unnest(string_split(value, ' ')) AS w FROM vt),
c AS (SELECT a.value AS x, b.value AS y, count(*) AS o FROM ws a JOIN wt b USING (w) GROUP BY ALL),
s AS (SELECT vs.source, vt.target, n_source, n_target, o::DOUBLE / (len(string_split(x, ' ')) + len(string_split(y, ' ')) - o) AS sim
  FROM c JOIN vs ON vs.value = x JOIN vt ON vt.value = y)
SELECT source, target, round(sim, 6) AS sim, n_source, n_target FROM s WHERE sim >= 0.6""")
def jaccard_multi_join(spark, sf):
    """Entities with several values: two names per part, a name per line of an order."""
    part = table(spark, sf, "part")
    s = part.select(F.col("p_partkey").alias("id"), F.explode(F.array("p_name", F.concat_ws(" ", "p_type", "p_brand"))).alias("v"))
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    t = line.join(part.select("p_partkey", "p_name"), "p_partkey").select("id", F.concat_ws(" ", "l_returnflag", "p_name").alias("v"))
    return _round(setjoin.jaccard_join(s, t, "id", "v", 0.6))
