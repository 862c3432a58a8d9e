"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from citeloom import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    # pandas holds longs with nulls as doubles or as nullable integers: whole numbers are written alike
    whole = lambda x: str(int(x)) if math.isfinite(x) and x == int(x) else round(float(x), 9)
    clean = lambda x: None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else whole(x) if isinstance(x, float) else str(x)
    return sorted([tuple(map(clean, r)) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
