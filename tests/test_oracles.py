"""Every registered query with SQL against DuckDB, at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from lexiprint.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.5f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]}) as q").df().itertuples(index=False, name=None)
    a = sorted(tuple(map(cell, (r[c] for c in columns))) for r in got.collect())
    b = sorted(tuple(map(cell, (x.item() if hasattr(x, "item") else x for x in r))) for r in want)
    near = lambda x, y: x == y or (x != "null" and y != "null" and x.lstrip("-")[:1].isdigit() and abs(float(x) - float(y)) < 2e-5)
    assert len(a) == len(b) and all(near(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_queries_without_sql_give_rows(spark):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, SF).count() > 0
