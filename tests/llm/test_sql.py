"""Queries that have SQL against DuckDB."""

import os

import duckdb
import pytest

from lexspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    want = con.execute(queries.SQL[name])
    names = sorted(c[0] for c in want.description)
    assert names == sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    at = [[c[0] for c in want.description].index(n) for n in names]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
