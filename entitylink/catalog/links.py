"""Link algebra, evaluation and learning support.

Two link sets come from lineitem: order -> part, scored by quantity (returned and
accepted lines) and by discount (returned and open lines). Gold: lightly taxed lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import table
from entitylink.functions import rules
from entitylink.operators import evaluate as ev
from entitylink.operators import learn
from entitylink.operators import links as lk


def _link_set(spark, sf, flags, sim):
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin(*flags))
    rows = rows.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), sim.alias("sim"))
    return lk.unique_links(rows)


def _a(spark, sf):
    return _link_set(spark, sf, ("A", "R"), F.col("l_quantity") / 50)


def _all(spark, sf):
    """Every line, for what needs one link set only."""
    return _link_set(spark, sf, ("A", "N", "R"), F.col("l_quantity") / 50)


def _b(spark, sf):
    return _link_set(spark, sf, ("N", "R"), 1 - F.col("l_discount"))


def _gold(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_tax") <= 0.04)
    return rows.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")


BASE = """WITH a AS (SELECT l_orderkey AS source, l_partkey AS target, max(l_quantity / 50) AS sim
  FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
b AS (SELECT l_orderkey AS source, l_partkey AS target, max(1 - l_discount) AS sim
  FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL),
gold AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_tax <= 0.04),
both_ AS (SELECT source, target, a.sim AS x, b.sim AS y FROM a JOIN b USING (source, target)),
either AS (SELECT source, target, max(sim) AS sim FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
"""
BASE_ALL = """WITH a AS (SELECT l_orderkey AS source, l_partkey AS target, max(l_quantity / 50) AS sim FROM lineitem GROUP BY ALL)
"""
OUT = "source, target, round(sim, 6) AS sim"


def _r(df):
    return df.withColumn("sim", F.round("sim", 6))


@query("links_and", BASE + "SELECT source, target, round(least(x, y), 6) AS sim FROM both_")
def links_and(spark, sf):
    return _r(lk.links_and(_a(spark, sf), _b(spark, sf)))


@query("links_or", BASE + f"SELECT {OUT} FROM either")
def links_or(spark, sf):
    return _r(lk.links_or(_a(spark, sf), _b(spark, sf)))


@query("links_minus", BASE + f"SELECT {OUT} FROM a ANTI JOIN b USING (source, target)")
def links_minus(spark, sf):
    return _r(lk.links_minus(_a(spark, sf), _b(spark, sf)))


@query("links_xor", BASE + f"SELECT {OUT} FROM either ANTI JOIN both_ USING (source, target)")
def links_xor(spark, sf):
    return _r(lk.links_xor(_a(spark, sf), _b(spark, sf)))


@query("links_add", BASE + "SELECT source, target, round(x * 0.6 + y * 0.4, 6) AS sim FROM both_ WHERE x * 0.6 + y * 0.4 >= 0.7051")
def links_add(spark, sf):
    return _r(lk.links_add(_a(spark, sf), _b(spark, sf), 0.6, 0.4, 0.7051))


@query("links_mult", BASE + "SELECT source, target, round(x * y * 0.72, 6) AS sim FROM both_ WHERE x * y * 0.72 >= 0.4001")
def links_mult(spark, sf):
    return _r(lk.links_mult(_a(spark, sf), _b(spark, sf), 0.9, 0.8, 0.4001))


@query("links_threshold", BASE_ALL + f"SELECT {OUT} FROM a WHERE sim >= 0.61")
def links_threshold(spark, sf):
    return _r(lk.threshold(_all(spark, sf), 0.61))


@query("links_accept_review", BASE_ALL + f"SELECT {OUT}, sim >= 0.81 AS accepted FROM a WHERE sim >= 0.41")
def links_accept_review(spark, sf):
    return _r(lk.accept_review(_all(spark, sf), 0.81, 0.41))


BEST = """, n1 AS (SELECT * FROM a QUALIFY sim = max(sim) OVER (PARTITION BY source)),
one AS (SELECT * FROM n1 QUALIFY sim = max(sim) OVER (PARTITION BY target))
"""


@query("best_one_to_n", BASE_ALL + BEST + f"SELECT {OUT} FROM n1")
def best_one_to_n(spark, sf):
    return _r(lk.best_one_to_n(_all(spark, sf)))


@query("best_one_to_one", BASE_ALL + BEST + f"SELECT {OUT} FROM one")
def best_one_to_one(spark, sf):
    return _r(lk.best_one_to_one(_all(spark, sf)))


@query("best_target", BASE_ALL + f"SELECT {OUT} FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) = 1")
def best_target(spark, sf):
    return _r(lk.best_target(_all(spark, sf)))


@query("links_reverse", BASE_ALL + "SELECT target AS source, source AS target, round(sim, 6) AS sim FROM a")
def links_reverse(spark, sf):
    return _r(lk.reverse(_all(spark, sf)))


@query("links_scale", BASE_ALL + "SELECT source, target, round(sim / 0.5, 6) AS sim FROM a")
def links_scale(spark, sf):
    return _r(lk.scale(_all(spark, sf), 0.5))


@query("links_trim", BASE_ALL + "SELECT source, target, round(least(sim / 0.5, 1), 6) AS sim FROM a")
def links_trim(spark, sf):
    return _r(lk.trim(lk.scale(_all(spark, sf), 0.5)))


@query("links_confidence", BASE + "SELECT source, target, round(coalesce(a.sim, 0), 6) AS sim FROM gold LEFT JOIN a USING (source, target)")
def links_confidence(spark, sf):
    return _r(lk.confidence(_gold(spark, sf), _a(spark, sf)))


@query("links_by_similarity", BASE_ALL + "SELECT round(sim, 6) AS sim, count(*) AS links FROM a GROUP BY a.sim")
def links_by_similarity(spark, sf):
    return _r(lk.by_similarity(_all(spark, sf)))


@query("links_count", BASE_ALL + "SELECT count(*) AS links FROM a")
def links_count(spark, sf):
    return lk.count_links(_all(spark, sf))


RULE = "1 / (1 + abs(o_totalprice / 500 - p_retailprice) / 1000)"


@query(
    "rule_filter",
    BASE_ALL + f""", r AS (SELECT source, target, sim, {RULE} AS rule FROM a JOIN orders ON o_orderkey = source JOIN part ON p_partkey = target)
SELECT source, target, round(least(sim, rule), 6) AS sim FROM r WHERE rule >= 0.61 AND least(sim, rule) >= 0.51""",
)
def rule_filter(spark, sf):
    near = 1 / (1 + F.abs(F.col("o_totalprice_s") / 500 - F.col("p_retailprice_t")) / 1000)
    return _r(lk.filter_by_rule(_all(spark, sf), _orders(spark, sf), _parts(spark, sf), "id", near, 0.61, 0.51))


@query(
    "rule_pairwise",
    BASE_ALL + """, s AS (SELECT source, target, CASE WHEN sim >= 0.5 THEN sim ELSE 0 END AS p,
    CASE WHEN 1 / (1 + abs(p_size - 25) / 10::DOUBLE) >= 0.51 THEN 1 / (1 + abs(p_size - 25) / 10::DOUBLE) ELSE 0 END AS q
  FROM a JOIN part ON p_partkey = target)
SELECT source, target, round(least(p, q), 6) AS r_and, round(greatest(p, q), 6) AS r_or,
  round(CASE WHEN q = 0 THEN p ELSE 0 END, 6) AS r_minus, round(CASE WHEN (p > 0) <> (q > 0) THEN greatest(p, q) ELSE 0 END, 6) AS r_xor,
  round(CASE WHEN p > 0 AND q > 0 AND p * 0.5 + q * 0.5 >= 0.71 THEN p * 0.5 + q * 0.5 ELSE 0 END, 6) AS r_add FROM s""",
)
def rule_pairwise(spark, sf):
    """Pair-wise rules over the first link set and a part-size similarity."""
    size = 1 / (1 + F.abs(F.col("p_size") - 25) / 10)
    p, q = rules.atom(F.col("sim"), 0.5), rules.atom(size, 0.51)
    rows = _all(spark, sf).join(_parts(spark, sf).withColumnRenamed("id", "target"), "target")
    out = {"r_and": rules.all_of(p, q), "r_or": rules.any_of(p, q), "r_minus": rules.minus(p, q), "r_xor": rules.one_of(p, q), "r_add": rules.weighted(p, q, 0.5, 0.5, 0.71)}
    return rows.select("source", "target", *[F.round(c, 6).alias(k) for k, c in out.items()])


@query(
    "custom_scorer",
    BASE + f"""SELECT source, target, round({RULE}, 6) AS sim FROM gold JOIN orders ON o_orderkey = source JOIN part ON p_partkey = target
WHERE {RULE} >= 0.55""",
)
def custom_scorer(spark, sf):
    src = _orders(spark, sf).select("id", F.col("o_totalprice").alias("price"))
    tgt = _parts(spark, sf).select("id", F.col("p_retailprice").alias("price"))
    scorer = 1 / (1 + F.abs(F.col("price_s") / 500 - F.col("price_t")) / 1000)
    return _r(learn.custom_join(src, tgt, "id", _gold(spark, sf), scorer, 0.55))


# evaluation

PRF = "tp, n_pred, n_gold, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f"


def _rp(df):
    for c in ("precision", "recall", "f"):
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "eval_prf",
    BASE + f"""SELECT {PRF} FROM (SELECT *, tp::DOUBLE / n_pred AS p, tp::DOUBLE / n_gold AS r FROM (SELECT
  (SELECT count(*) FROM a JOIN gold USING (source, target)) AS tp, (SELECT count(*) FROM a) AS n_pred, (SELECT count(*) FROM gold) AS n_gold))""",
)
def eval_prf(spark, sf):
    return _rp(ev.prf(_a(spark, sf), _gold(spark, sf)))


@query(
    "eval_prf_undirected",
    BASE + """, g2 AS (SELECT source, target FROM gold UNION SELECT target, source FROM gold),
p2 AS (SELECT source, target FROM a UNION SELECT target, source FROM a)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM (SELECT
  (SELECT count(*) FROM a SEMI JOIN g2 USING (source, target))::DOUBLE / (SELECT count(*) FROM a) AS p,
  (SELECT count(*) FROM gold SEMI JOIN p2 USING (source, target))::DOUBLE / (SELECT count(*) FROM gold) AS r)""",
)
def eval_prf_undirected(spark, sf):
    return _rp(ev.prf_undirected(_a(spark, sf), _gold(spark, sf)))


@query(
    "eval_pseudo_f",
    BASE + """SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM (SELECT
  (count(DISTINCT source) + count(DISTINCT target)) / (2.0::DOUBLE * count(*)) AS p,
  (count(DISTINCT source) + count(DISTINCT target))::DOUBLE / ((SELECT count(*) FROM orders) + (SELECT count(*) FROM part)) AS r FROM a)""",
)
def eval_pseudo_f(spark, sf):
    return _rp(ev.pseudo_f(_a(spark, sf), _orders(spark, sf), _parts(spark, sf), "id"))


@query(
    "eval_pseudo_f_one_to_n",
    BASE + BEST + """, back AS (SELECT * FROM n1 QUALIFY sim = max(sim) OVER (PARTITION BY target))
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(1.25 * p * r / (0.25 * p + r), 6) AS f FROM (SELECT
  ((SELECT count(DISTINCT source) FROM n1) + (SELECT count(DISTINCT target) FROM back)) / (2.0::DOUBLE * (SELECT count(*) FROM a)) AS p,
  ((SELECT count(DISTINCT source) FROM n1) + (SELECT count(DISTINCT target) FROM n1))::DOUBLE
    / ((SELECT count(*) FROM orders) + (SELECT count(*) FROM part)) AS r)""",
)
def eval_pseudo_f_one_to_n(spark, sf):
    return _rp(ev.pseudo_f(_a(spark, sf), _orders(spark, sf), _parts(spark, sf), "id", beta=0.5, one_to_n=True))


@query(
    "link_statistics",
    BASE + """, j AS (SELECT a.target AS x, gold.target AS y FROM a JOIN gold USING (source)),
c AS (SELECT (SELECT count(*) FROM a) AS links, (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM j WHERE x = y) AS true_links,
  (SELECT count(*) FROM j WHERE x <> y) AS false_links, (SELECT count(*) FROM gold ANTI JOIN a USING (source, target)) AS missed_links)
SELECT *, round(100.0::DOUBLE * true_links / (true_links + missed_links), 6) AS recall_percent FROM c""",
)
def link_statistics(spark, sf):
    return ev.link_statistics(_a(spark, sf), _gold(spark, sf)).withColumn("recall_percent", F.round("recall_percent", 6))


@query("missed_links", BASE + "SELECT source, target FROM gold ANTI JOIN a USING (source, target)")
def missed_links(spark, sf):
    return ev.missed_links(_a(spark, sf), _gold(spark, sf))


@query(
    "eval_accuracy",
    BASE + """SELECT tp, wrong, round((n - wrong) / n, 6) AS accuracy FROM (SELECT
  (SELECT count(*) FROM a JOIN gold USING (source, target)) AS tp,
  (SELECT count(*) FROM a ANTI JOIN gold USING (source, target)) + (SELECT count(*) FROM gold ANTI JOIN a USING (source, target)) AS wrong,
  (SELECT count(*) FROM orders)::DOUBLE * (SELECT count(*) FROM part) AS n)""",
)
def eval_accuracy(spark, sf):
    df = ev.accuracy(_a(spark, sf), _gold(spark, sf), _orders(spark, sf), _parts(spark, sf), "id")
    return df.withColumn("accuracy", F.round("accuracy", 6))


SQL_TABLE = """, pred AS (SELECT 'quantity' AS method, source, target FROM a UNION ALL SELECT 'discount', source, target FROM b)
"""


@query(
    "eval_table",
    BASE + SQL_TABLE + f""", d AS (SELECT o_orderkey AS source, o_orderpriority AS dataset FROM orders),
t AS (SELECT method, dataset, count(g.source) AS tp, count(*) AS n_pred FROM pred JOIN d USING (source) LEFT JOIN gold g USING (source, target) GROUP BY ALL),
n AS (SELECT dataset, count(*) AS n_gold FROM gold JOIN d USING (source) GROUP BY ALL)
SELECT method, dataset, {PRF} FROM (SELECT *, tp::DOUBLE / n_pred AS p, tp::DOUBLE / n_gold AS r FROM t JOIN n USING (dataset))""",
)
def eval_table(spark, sf):
    """Two methods over five datasets (the order priorities)."""
    dataset = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_orderpriority").alias("dataset"))
    pred = _a(spark, sf).withColumn("method", F.lit("quantity")).unionByName(_b(spark, sf).withColumn("method", F.lit("discount")))
    return _rp(ev.eval_table(pred.join(dataset, "source"), _gold(spark, sf).join(dataset, "source")))


SQL_FOLD = "CAST('0x' || substr(md5(CAST(source AS VARCHAR)), 1, 8) AS BIGINT) % 5"
SQL_FOLDS = f"""WITH_BASE, t AS (SELECT {SQL_FOLD} AS fold, count(g.source) AS tp, count(*) AS n_pred FROM a LEFT JOIN gold g USING (source, target) GROUP BY ALL),
n AS (SELECT {SQL_FOLD} AS fold, count(*) AS n_gold FROM gold GROUP BY ALL),
folds AS (SELECT fold, {PRF} FROM (SELECT *, tp::DOUBLE / n_pred AS p, tp::DOUBLE / n_gold AS r FROM t JOIN n USING (fold)))
""".replace("WITH_BASE", BASE)


@query("eval_folds", SQL_FOLDS + "SELECT * FROM folds")
def eval_folds(spark, sf):
    return _rp(ev.eval_folds(_a(spark, sf), _gold(spark, sf), 5))


@query("eval_mean_sd", SQL_FOLDS + "SELECT round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS sd FROM folds")
def eval_mean_sd(spark, sf):
    folds = _rp(ev.eval_folds(_a(spark, sf), _gold(spark, sf), 5))
    return ev.mean_sd(folds, "f").select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


# learning support

GRID = [round(0.05 * i, 2) for i in range(1, 20)]
SQL_SWEEP = BASE + SQL_TABLE.replace("source, target FROM a", "source, target, sim FROM a").replace("source, target FROM b", "source, target, sim FROM b") + f""",
grid AS (SELECT unnest({GRID}::DOUBLE[]) AS theta),
t AS (SELECT method AS rule, theta, count(g.source) FILTER (WHERE sim >= theta) AS tp, count(*) FILTER (WHERE sim >= theta) AS n_pred
  FROM pred LEFT JOIN gold g USING (source, target), grid GROUP BY ALL),
pr AS (SELECT *, (SELECT count(*) FROM gold) AS n_gold, CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0 END AS p,
  tp::DOUBLE / (SELECT count(*) FROM gold) AS r FROM t),
rated AS (SELECT rule, theta, tp, n_pred, n_gold, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr),
swept AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY f DESC, theta DESC) = 1 AS best FROM rated)
"""


@query(
    "threshold_sweep",
    SQL_SWEEP + """SELECT theta, tp, n_pred, n_gold, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f, best
FROM swept WHERE rule = 'quantity'""",
)
def threshold_sweep(spark, sf):
    return _rp(learn.threshold_sweep(_a(spark, sf), _gold(spark, sf), GRID))


@query("rank_rules", SQL_SWEEP + "SELECT rule, theta, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM swept WHERE best")
def rank_rules(spark, sf):
    scored = _a(spark, sf).withColumn("rule", F.lit("quantity")).unionByName(_b(spark, sf).withColumn("rule", F.lit("discount")))
    return _rp(learn.rank_rules(scored, _gold(spark, sf), GRID))


@query(
    "controversy",
    BASE + """, votes AS (SELECT source, target, count(*) AS votes FROM (
    SELECT source, target FROM a UNION ALL SELECT source, target FROM b UNION ALL SELECT source, target FROM gold)
  GROUP BY ALL),
asked AS (SELECT source, target FROM b WHERE sim >= 0.995),
one AS (SELECT *, abs(votes - 1) AS off FROM votes ANTI JOIN asked USING (source, target)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(votes - 1), votes DESC, target) = 1)
SELECT source, target, votes, round(votes / 3.0::DOUBLE, 6) AS sim FROM one ORDER BY off, votes DESC, source LIMIT 100""",
)
def controversy(spark, sf):
    """100 pairs three link sets disagree on; full-price pairs count as asked."""
    a, b, g = (x(spark, sf).select("source", "target") for x in (_a, _b, _gold))
    asked = _b(spark, sf).where(F.col("sim") >= 0.995)
    return _r(learn.controversy(a.unionByName(b).unionByName(g), 3, 100, asked))
