"""The queries that SQL can express, against DuckDB; and the tables' hard cases."""

import pytest

from corpusloom.llm import queries

from .. import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, name):
    assert compare.same(spark, queries.QUERIES[name], queries.ORACLE[name]) > 0


@pytest.mark.parametrize("name", ["op7_minhash", "op8_suffix_dedup"])
def test_whole_small_table_against_brute_force(spark, name):
    from . import brute

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.near_duplicates(rows) if name == "op7_minhash" else brute.repeated_bytes(rows)
    got = [tuple(r) for r in queries.QUERIES[name](spark, folder).collect()]
    assert len(got) == len(rows) and set(got) == want
