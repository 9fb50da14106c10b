import hashlib

from entitylink.llm.sampling import first_by_hash
from pyspark.sql import functions as F


def test_first_by_hash(spark):
    rows = [(k, f"t{k}") for k in range(3000)] + [(1, "t1")] * 500 + [(9, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    order = sorted({t for _, t in rows if t}, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    for limit in (1, 50, 2999, 5000):
        got = first_by_hash(df, F.col("t"), limit).collect()
        assert [r.t for r in got] == order[:limit]
    copies = spark.createDataFrame([(1, "same")] * 900 + [(2, "other")], "id long, t string")
    assert {r.t for r in first_by_hash(copies, F.col("t"), 10).collect()} == {"same", "other"}
    assert first_by_hash(df.limit(0), F.col("t"), 5).count() == 0
