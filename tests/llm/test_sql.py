"""The queries that SQL can express give the rows of their SQL."""

import os

import duckdb
import pytest

from markloom.llm import queries

DATA = os.environ.get("MARKLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(repr([r[i] for i in at]) for r in want.fetchall())
