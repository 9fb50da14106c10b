from entitylink.llm.catalog import query, table
from entitylink.llm.importance import resampled

# crc32 by its table: 8 shift steps make an entry, list_reduce runs the bytes through.
SQL = r"""WITH
crc AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS t
        FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT doc_id, text, 0 AS side FROM documents UNION ALL SELECT NULL, text, 1 FROM benchmark),
w AS (SELECT row_number() OVER () AS r, doc_id, side,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT r, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
d AS (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM (SELECT DISTINCT f FROM f)),
k AS (SELECT f, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM d, crc),
fk AS (SELECT r, side, k FROM f JOIN k USING (f)),
n AS (SELECT k, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fk GROUP BY k),
g AS (SELECT k, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS g FROM n),
e AS (SELECT r, count(*) AS n, sum(g) AS g FROM fk JOIN g USING (k) WHERE side = 0 GROUP BY r),
x AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
      ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN e USING (r) WHERE side = 0),
y AS (SELECT doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) AS place,
      count(*) FILTER (words >= 20 AND doc_id IS NOT NULL) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND doc_id IS NOT NULL AND place <= (25 * able) // 100 THEN place END AS rank FROM z"""


@query("op13_head_tail_resampling", SQL)
def op13(spark, sf):
    rows = resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"), percent=25, min_words=20, seed=7)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
