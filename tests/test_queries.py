"""Every query with SQL against DuckDB on the smallest tables; plans and shapes of the headline queries."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from eodlake.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())
    assert got


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_futures_need_no_python_and_one_shuffle(spark):
    plan = plan_of(plans.QUERIES["fut_roman_symbols"](spark, SF))
    assert "Python" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(plans.QUERIES["segment_summary"](spark, SF))
    assert "o_totalprice" not in plan


def test_calendar_joins_are_broadcast(spark):
    for name in ("last_next_trading_day", "add_trading_days", "count_trading_days", "expected_last_date"):
        plan = plan_of(plans.QUERIES[name](spark, SF))
        assert "SortMergeJoin" not in plan, name
