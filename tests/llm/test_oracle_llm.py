"""The operators' queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from citeloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours, theirs = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [tuple(r) for r in ours.select(columns).collect()]  # not by way of pandas, which has no null longs
    assert sorted(map(str, rows)) == sorted(map(str, theirs.project(", ".join(columns)).fetchall()))


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
