"""Every record view equals its DuckDB twin (the base of all oracles)."""

import pytest

from scripts.oracle_check import duck, rows_canon
from tessera.plans.oracle_views import VIEWS, with_views
from tessera.sources import views as V
from tessera.sources.tables import Tables

SPARK_VIEWS = {"v_tenants": V.tenants, "v_calls": V.calls, "v_bookings": V.bookings, "v_leads": V.leads,
               "v_availability": V.availability, "v_notifications": V.notifications, "v_turns": V.turns,
               "v_docs": V.docs, "v_chunks": V.chunks, "v_configs": V.configs, "v_eval": V.eval_questions}


def test_all_views_covered():
    assert set(SPARK_VIEWS) == set(VIEWS)


@pytest.mark.parametrize("name", sorted(SPARK_VIEWS))
def test_view_matches_duckdb(spark, sf, name):
    df = SPARK_VIEWS[name](Tables(spark, sf))
    s = rows_canon(df.columns, df.collect())
    cur = duck(sf).execute(with_views(f"SELECT * FROM {name}", name))
    d = rows_canon([c[0] for c in cur.description], cur.fetchall())
    assert s == d
