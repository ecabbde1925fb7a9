"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from motifstream.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
