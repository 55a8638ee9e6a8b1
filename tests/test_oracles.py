"""Every query with SQL of its own is held against DuckDB on the smallest tables."""

import glob

import duckdb
import pytest

from trajmill.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: (x is None, str(round(x, 6) + 0.0) if isinstance(x, float) else str(x))
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DIR)
    want = db.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
