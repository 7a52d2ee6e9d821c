"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import os

import pytest

from tomospark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "embeddings")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    assert rows == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())
