"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "datetime" in str(df[c].dtype):
            df[c] = df[c].astype(str).replace("NaT", "NULL")

    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 9))
        return str(x)

    return df.map(one).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want), pd.concat([got, want]).drop_duplicates(keep=False).head()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert len(QUERIES[name](spark, SF).limit(5).toPandas().columns) > 0


def test_bars_are_hash_aggregates(spark):
    """Both passes over lineitem combine in hash tables, before and after the shuffle, without a sort."""
    from tidemark.plans import tables

    for rows in (tables.bars(spark, SF), tables.market_bars(spark, SF)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2


def test_event_queries_read_their_rows_once(spark):
    """The analysis rows are written once; what follows doesn't scan lineitem again."""
    plan = QUERIES["e9_car_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
