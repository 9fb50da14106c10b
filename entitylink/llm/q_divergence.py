from entitylink.llm.catalog import query, table
from entitylink.llm.divergence import audited

SQL = r"""WITH
d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cells AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(v.n), 0) AS nl, coalesce(sum(c), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN cells USING (lang, source) GROUP BY lang, source),
full_ AS (SELECT g.lang, g.source, term, (1 + (1000000000::HUGEINT * (coalesce(cells.c, 0) + 1)) // (g.n + g.v))::BIGINT AS p,
          (1 + (1000000000::HUGEINT * (kept.c + 1)) // (g.nl + g.v))::BIGINT AS q, coalesce(cells.c, 0) AS c
          FROM g JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM full_ WHERE c > 0 AND p > q),
both_ AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM both_ WHERE part = 'pair' OR rank <= 200"""


@query("op12_quadtree_audit", SQL)
def op12(spark, sf):
    return audited(table(spark, sf, "documents"), min_docs=3, ranks=200)
