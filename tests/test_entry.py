"""Every registered query against its SQL counterpart in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect
from wardledger.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return connect(SF_DIR)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 100


def test_every_query_of_the_workload_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    outcome = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert outcome.startswith("ok"), outcome
