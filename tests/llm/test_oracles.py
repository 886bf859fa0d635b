"""Queries beside their SQL on the smallest tables."""

import os

import duckdb
import pytest

from waymill.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    tables = duckdb.connect()
    for file in os.listdir(DATA):
        tables.execute(f"CREATE VIEW {file.partition('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    found = tables.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(found.fetchall())
