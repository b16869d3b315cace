"""Registered queries against their DuckDB oracles on the smallest tables."""

import pytest

import __spark_entry__ as E
from scripts.oracle_check import duck, rows_canon

NAMES = ["a1_call_stats", "k10_search", "k14_build_context", "j2_call_detail", "t1_next_slots", "k12_keyword_search",
         "k1_chunk_documents", "s7_upsert", "q9_apply_replies", "a17_access_report", "w6_concurrency", "x9_e164"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, name):
    df = E.queries()[name](spark, sf)
    s = rows_canon(df.columns, df.collect())
    cur = duck(sf).execute(E.oracle_sql()[name])
    d = rows_canon([c[0] for c in cur.description], cur.fetchall())
    assert s == d


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "tenant_id", "status", "matches", "context", "sources"]
    assert df.count() > 0
