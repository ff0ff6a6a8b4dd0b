"""Registered audit queries against DuckDB on the small tables."""

import math
import os

import pytest

import __spark_entry__ as registry
from lectern import queries as audit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as from '{SF}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(audit.SQL))
def test_query(spark, con, name):
    df = audit.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = con.sql(audit.SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert mine == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_registry(spark):
    assert set(audit.QUERIES) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
    if os.path.isdir(SF):
        assert registry.entry(spark).count() == 50
