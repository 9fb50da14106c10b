from pyspark.sql import functions as F

from entitylink.llm.catalog import query, table
from entitylink.llm.shards import sharded

# crc32 by its table: 8 shift steps make an entry, list_reduce runs the bytes through.
SQL = """WITH RECURSIVE
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT doc_id, text, strlen(text)::BIGINT + 16 AS size, ('0x' || substr(md5(text), 1, 4))::INT // 4 AS g, ((doc_id % 64) + 64) % 64 AS part FROM d),
g AS (SELECT g, sum(size)::BIGINT AS b FROM r GROUP BY g),
p AS (SELECT g, sum(b) OVER (ORDER BY g)::BIGINT AS e FROM g),
ends AS (SELECT 0::BIGINT AS e UNION ALL SELECT e FROM p),
all_ AS (SELECT list(b ORDER BY g) AS sizes, sum(b)::BIGINT AS total, greatest(max(b), ((sum(b) + 39) // 40)::BIGINT)::BIGINT AS low FROM g),
search(lo, hi) AS (
  SELECT low, total FROM all_
  UNION ALL
  SELECT CASE WHEN fits THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN fits THEN (lo + hi) // 2 ELSE hi END
  FROM (SELECT lo, hi, list_reduce(sizes, lambda a, x: CASE WHEN a.s + x <= (lo + hi) // 2 THEN {'s': a.s + x, 'n': a.n} ELSE {'s': x, 'n': a.n + 1} END,
        {'s': 0::BIGINT, 'n': 1::BIGINT}).n <= 40 AS fits FROM search, all_ WHERE lo < hi)),
cap AS (SELECT min(hi) AS c FROM search),
early(k, e) AS (SELECT 40, total FROM all_ UNION ALL SELECT k - 1, (SELECT min(x.e) FROM ends x WHERE x.e >= early.e - c) FROM early, cap WHERE k > 1),
cut(k, e) AS (SELECT 0, 0::BIGINT UNION ALL
  SELECT cut.k + 1, greatest(cut.e, early.e, least((SELECT max(x.e) FROM ends x WHERE x.e <= cut.e + c), (SELECT max(x.e) FROM ends x WHERE x.e <= (cut.k + 1) * total // 40)))
  FROM cut JOIN early ON early.k = cut.k + 1, cap, all_ WHERE cut.k < 39),
s AS (SELECT g, (SELECT count(*) FROM cut WHERE k > 0 AND cut.e <= p.e - (SELECT b FROM g WHERE g.g = p.g))::INT AS shard FROM p),
crc AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS t
        FROM (SELECT unnest(range(256)) AS i))),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d),
c32 AS (SELECT doc_id, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc)
SELECT r.doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY r.g, part, r.doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM r JOIN s ON s.g = r.g JOIN c32 ON c32.doc_id = r.doc_id"""


@query("op7_minimax_shards", SQL)
def op7(spark, sf):
    out = sharded(table(spark, sf, "documents"), shards=40)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
