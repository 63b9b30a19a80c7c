"""Every query of the catalog against its SQL in DuckDB, or for rows alone."""

import os

import duckdb
import pytest

from lexspark.plans import catalog, reports, runs, stored  # noqa: F401  (they register more queries)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    got = df.collect()
    if name not in catalog.SQL:
        assert got
        return
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    want = con.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, want.fetchall())


def test_whole_text_is_merged_again(spark, data):
    merged = {r.doc_id: r.tokens for r in catalog.overlap_merge(spark, data).collect()}
    whole = {r.doc_id: r.tokens for r in catalog.token_count(spark, data).collect() if r.tokens}
    # texts of repeated words overlap by more than the windows do
    assert merged.keys() == whole.keys() and all(merged[k] <= whole[k] for k in whole)
    assert sum(merged[k] == whole[k] for k in whole) > 0.9 * len(whole)


def test_grounding_finds_added_numbers(spark, data):
    got = catalog.grounding_validate(spark, data).collect()
    assert {g.grounded for g in got} == {True, False}
