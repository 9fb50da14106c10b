"""Every registered query on the smallest tables against its SQL, and its plan."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from entitylink import session  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name, monkeypatch):
    monkeypatch.setattr(session, "ON_MATERIALIZE", [no_nested_loop])
    df = entry.queries()[name](spark, sf)
    no_nested_loop(df)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "target", "sim"]
