"""Registered queries next to their SQL, and the rest against brute force, on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tools.check_oracle import compare, connect
from wardledger.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    outcome = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLE_SQL[name])
    assert outcome.startswith("ok"), outcome


def test_jaccard_join_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = QUERIES["op2_jaccard_join"](spark, SF_DIR).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute.jaccard_components(docs)


def test_language_model_beats_base_on_held_out_documents(spark):
    rows = QUERIES["op1_lm_scoring"](spark, SF_DIR).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
