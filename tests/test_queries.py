"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import os

import pytest

import __spark_entry__
from __spark_entry__ import entry
from workload.oracle import statements as oracle_sql
from workload.queries import registry as queries

DATA = "/root/testdata/sf0.001"
TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
# Plans with an Arrow step: smooths too wide for windows or joins.
BLOCKED = {"sma_all_widths", "gaussian_rows", "gaussian_rows_all_widths", "kernel_gaussian", "kernel_all_bandwidths",
           "kernel_many_series", "kernel_repeated_dates", "series_health_stats", "series_heart_rate", "series_sleep", "series_steps"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    return repr(float(value) + 0.0) if isinstance(value, float) else repr(value)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert set(queries()) <= set(__spark_entry__.queries()) and set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["user_id", "date", "kernel", "bandwidth", "value"] and not df.isEmpty()


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    result = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted([shown(r[columns.index(c)]) for c in order] for r in result.fetchall())
    got = sorted([shown(r[c]) for c in order] for r in df.collect())
    assert got == want
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "EvalPython" not in plan
    assert ("MapInArrow" in plan) == (name in BLOCKED)
    if name == "activity_list":
        assert plan.count("WindowGroupLimit") >= 1
    if name in ("smooth_wide", "smooth_trim"):
        # Mean per day, window per series, one exchange for the whole pivot.
        assert plan.count("Exchange hashpartitioning") == 3
