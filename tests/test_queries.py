"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rulespark.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([tuple(r[i] for i in at) for r in found.fetchall()])


def test_entry_and_names(spark):
    assert entry.entry(spark).columns
    assert set(SQL) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cross_joins_in_plans(spark):
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["required_fields"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(c_acctbal,0.0)" in plan and "c_nationkey" not in plan
