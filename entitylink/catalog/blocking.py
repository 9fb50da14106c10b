"""Blocking, purging, meta-blocking and the blocked link job, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitylink.catalog import query
from entitylink.catalog.data import SQL_DOCUMENTS, documents
from entitylink.operators import blocking as b
from entitylink.plans import linker
from entitylink.session import materialize

THETA = 0.5
KEEP_BLOCKS = 8

SQL_TOKENS = f"""WITH {SQL_DOCUMENTS},
tagged AS (SELECT 's' AS dataset, id, value FROM ds UNION ALL SELECT 't', id, value FROM dt),
tokens AS (
  SELECT DISTINCT dataset, id, token FROM (
    SELECT dataset, id, unnest(string_split(regexp_replace(lower(replace(
      regexp_replace(value, '\\^\\^[^^]*$', ''), '"', '')), '[^a-z0-9 ]', ' ', 'g'), ' ')) AS token FROM tagged)
  WHERE token <> ''),
sizes AS (
  SELECT token, count(*) AS size, count(*) FILTER (WHERE dataset = 's') AS n_s,
         count(*) FILTER (WHERE dataset = 't') AS n_t
  FROM tokens GROUP BY token),
hist AS (SELECT size, count(*) AS blocks FROM sizes GROUP BY size),
run AS (
  SELECT size, CAST(sum(size * blocks) OVER w AS DOUBLE) AS total,
         CAST(sum(2 * size * (size - 1) * blocks) OVER w AS DOUBLE) AS comparisons
  FROM hist WINDOW w AS (ORDER BY size ROWS UNBOUNDED PRECEDING)),
cc AS (SELECT size, CASE WHEN comparisons = 0 THEN CAST('Infinity' AS DOUBLE) ELSE total / comparisons END AS cc FROM run),
steps AS (SELECT size, abs(cc - lag(cc) OVER (ORDER BY size)) AS step FROM cc),
best AS (SELECT coalesce((SELECT size FROM steps WHERE step < 1 ORDER BY step, size DESC LIMIT 1),
                         (SELECT max(size) FROM steps)) AS optimal),
kept AS (SELECT sizes.* FROM sizes, best WHERE size > 1 AND size <= optimal)
"""


def _tagged(spark, sf):
    src, tgt = documents(spark, sf)
    return b.tag(src, tgt, "id", "text")


def _tokens(spark, sf):
    return b.token_blocking(_tagged(spark, sf))


@query("token_blocking", SQL_TOKENS + "SELECT token, dataset, id FROM tokens")
def token_blocking(spark, sf):
    return _tokens(spark, sf)


@query("block_sizes", SQL_TOKENS + "SELECT * FROM sizes")
def block_sizes(spark, sf):
    return b.block_sizes(_tokens(spark, sf))


@query("block_histogram", SQL_TOKENS + "SELECT * FROM hist")
def block_histogram(spark, sf):
    return b.block_histogram(b.block_sizes(_tokens(spark, sf)))


@query("optimal_block_size", SQL_TOKENS + "SELECT optimal FROM best")
def optimal_block_size(spark, sf):
    return b.optimal_block_size(b.block_sizes(_tokens(spark, sf)))


@query("block_purging_off", SQL_TOKENS + "SELECT tokens.*, size, n_s, n_t FROM tokens JOIN sizes USING (token) WHERE size > 1")
def block_purging_off(spark, sf):
    tokens = _tokens(spark, sf)
    return b.purge(tokens, b.block_sizes(tokens), purging=False)


def _kept(spark, sf):
    tokens = materialize(_tokens(spark, sf), "tokens")
    return b.purge(tokens, b.block_sizes(tokens))


@query("block_purging", SQL_TOKENS + "SELECT tokens.*, size, n_s, n_t FROM tokens JOIN kept USING (token)")
def block_purging(spark, sf):
    return _kept(spark, sf)


SQL_CANDIDATES = """, cand AS (
  SELECT DISTINCT a.id AS source, b.id AS target
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.dataset = 's' AND b.dataset = 't'
  JOIN kept ON kept.token = a.token)
"""


@query("block_candidates", SQL_TOKENS + SQL_CANDIDATES + "SELECT * FROM cand")
def block_candidates(spark, sf):
    return b.candidates(_kept(spark, sf))


SQL_FILTERED = f""", filtered AS (
  SELECT * FROM (
    SELECT token, dataset, id, size, n_s, n_t,
           row_number() OVER (PARTITION BY dataset, id ORDER BY size * (size - 1) / 2, token) AS rank
    FROM tokens JOIN kept USING (token)) WHERE rank <= {KEEP_BLOCKS})
"""


@query("block_filtering", SQL_TOKENS + SQL_FILTERED + "SELECT token, dataset, id, size, rank FROM filtered")
def block_filtering(spark, sf):
    return b.block_filtering(_kept(spark, sf), KEEP_BLOCKS).select(
        "token", "dataset", "id", "size", F.col("rank").cast("bigint").alias("rank")
    )


SQL_META = """, lists AS (SELECT dataset, id, count(*) AS k FROM filtered GROUP BY dataset, id),
shared AS (
  SELECT a.dataset AS dataset_a, a.id AS id_a, b.dataset AS dataset_b, b.id AS id_b, count(*) AS shared
  FROM filtered a JOIN filtered b ON a.token = b.token AND (a.dataset < b.dataset OR (a.dataset = b.dataset AND a.id < b.id))
  GROUP BY ALL),
weighted AS (
  SELECT s.*, CAST(shared AS DOUBLE) / (x.k + y.k - shared) AS weight
  FROM shared s JOIN lists x ON x.dataset = dataset_a AND x.id = id_a
  JOIN lists y ON y.dataset = dataset_b AND y.id = id_b),
mean AS (SELECT sum(weight * k) / sum(k) AS m FROM (SELECT weight, sum(shared) AS k FROM weighted GROUP BY weight)),
meta AS (SELECT dataset_a, id_a, dataset_b, id_b, shared, weight FROM weighted, mean WHERE weight >= m - 1e-12)
"""


def _meta(spark, sf):
    return b.meta_blocking(b.block_filtering(_kept(spark, sf), KEEP_BLOCKS))


@query(
    "meta_blocking",
    SQL_TOKENS + SQL_FILTERED + SQL_META
    + "SELECT dataset_a, id_a, dataset_b, id_b, shared, round(weight, 6) AS weight FROM meta",
)
def meta_blocking(spark, sf):
    return _meta(spark, sf).withColumn("weight", F.round("weight", 6))


@query(
    "comparison_pairs",
    SQL_TOKENS + SQL_FILTERED + SQL_META
    + """SELECT dataset_a, id_a, dataset_b, id_b, md5(x.value) AS value_a, md5(y.value) AS value_b
FROM meta JOIN tagged x ON x.dataset = dataset_a AND x.id = id_a JOIN tagged y ON y.dataset = dataset_b AND y.id = id_b""",
)
def comparison_pairs(spark, sf):
    pairs = b.comparison_pairs(_meta(spark, sf), _tagged(spark, sf).withColumn("value", F.md5("value")))
    return pairs.select("dataset_a", "id_a", "dataset_b", "id_b", "value_a", "value_b")


@query("comparison_count", SQL_TOKENS + "SELECT CAST(sum(n_s * n_t) AS DECIMAL(38,0)) AS comparisons FROM sizes")
def comparison_count(spark, sf):
    return b.comparison_count(b.block_sizes(_tokens(spark, sf)))


SQL_LINKS = f""", n AS (SELECT dataset, id, count(*) AS n FROM tokens GROUP BY dataset, id),
common AS (
  SELECT a.id AS source, b.id AS target, count(*) AS o
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.dataset = 's' AND b.dataset = 't'
  GROUP BY a.id, b.id),
links AS (
  SELECT source, target, CAST(o AS DOUBLE) / (x.n + y.n - o) AS sim
  FROM common JOIN cand USING (source, target)
  JOIN n x ON x.dataset = 's' AND x.id = source JOIN n y ON y.dataset = 't' AND y.id = target
  WHERE CAST(o AS DOUBLE) / (x.n + y.n - o) >= {THETA}),
best_target AS (
  SELECT source, target, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS r FROM links) WHERE r = 1)
"""


def _linked(spark, sf):
    src, tgt = documents(spark, sf)
    return linker.link_by_tokens(src, tgt, "id", "text", THETA)


@query(
    "link_blocked",
    SQL_TOKENS + SQL_CANDIDATES + SQL_LINKS + "SELECT source, target, round(sim, 6) AS sim FROM best_target",
)
def link_blocked(spark, sf):
    return _linked(spark, sf).withColumn("sim", F.round("sim", 6))


@query(
    "blocking_report",
    SQL_TOKENS + SQL_CANDIDATES + SQL_LINKS
    + """SELECT metric, CAST(value AS DECIMAL(38,0)) AS value FROM (SELECT 'optimal_size' AS metric, CAST(optimal AS BIGINT) AS value FROM best
UNION ALL SELECT 'blocks_before', count(*) FROM sizes
UNION ALL SELECT 'blocks_after', count(*) FROM kept
UNION ALL SELECT 'source_entities', count(*) FROM ds
UNION ALL SELECT 'target_entities', count(*) FROM dt
UNION ALL SELECT 'all_pairs', (SELECT count(*) FROM ds) * (SELECT count(*) FROM dt)
UNION ALL SELECT 'comparisons_unpurged', CAST(sum(n_s * n_t) AS BIGINT) FROM sizes
UNION ALL SELECT 'comparisons_purged', CAST(sum(n_s * n_t) AS BIGINT) FROM kept
UNION ALL SELECT 'links', count(*) FROM best_target)""",
)
def blocking_report(spark, sf):
    return b.blocking_report(_tagged(spark, sf), _linked(spark, sf))
