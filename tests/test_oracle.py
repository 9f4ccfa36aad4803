"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from check import compare

import suite
from suite.fixtures import BASE_TABLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = suite.all_queries(), suite.all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, duck, key):
    ok, note, _ = compare(spark, duck, key, QUERIES[key], ORACLES.get(key), SF_DIR)
    assert ok, note


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert sum(r["rows"] for r in rows) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
