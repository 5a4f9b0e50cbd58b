"""Each registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from jobs import queries as jobs
from loomgraph.plans import catalog

QUERIES, SQL = catalog.QUERIES | jobs.QUERIES, catalog.SQL | jobs.SQL
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return "0" if x == 0 else f"{x:.{9 - 1 - math.floor(math.log10(abs(x)))}f}" if abs(x) < 1e15 and math.floor(math.log10(abs(x))) < 8 else f"{x:.6g}"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.columns and found.collect() is not None
