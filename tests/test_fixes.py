"""Cases beyond the driver tables: repeated keys, moved tenants, gaps, values
with placeholders, nested folders, and the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import kb_text as K
from tessera.operators import reports as RP
from tessera.operators import rules as RU
from tessera.operators import store as ST


def test_repeated_change_rows_update_once(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    ch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "id int, v string, at int")
    assert sorted(map(tuple, ST.update_by_key(base, ch, "id", ["v"], ts_col="at").collect())) == [(1, "y"), (2, "b")]
    assert ST.update_by_key(base, ch, "id", ["v"]).count() == 2


def test_repeated_incoming_rows_upsert_once(spark):
    base = spark.createDataFrame([("c1", 1, "a")], "config_id string, tenant_id int, v string")
    inc = spark.createDataFrame([(1, "x"), (1, "y"), (2, "p"), (2, "q")], "tenant_id int, v string")
    got = ST.upsert(base, inc, "tenant_id", ["v"]).collect()
    assert len(got) == 2 and len({r.config_id for r in got}) == 2
    assert sorted((r.tenant_id, r.v, r.action) for r in got) == [(1, "y", "updated"), (2, "q", "inserted")]


def test_reindex_sees_moved_tenants_and_lost_texts(spark):
    schema = "doc_id long, tenant_id int, content string"
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 1, None), (5, 1, "e")], schema)
    new = spark.createDataFrame([(1, 2, "a"), (2, 1, None), (3, 1, "c"), (4, 1, None), (6, 1, "f")], schema)
    plan, chunks = K.reindex(new, old, K.chunk_documents(old))
    assert {r.doc_id: (r.action, r.tenant_id) for r in plan.collect()} == {
        1: ("changed", 2), 2: ("changed", 1), 3: ("unchanged", 1), 4: ("unchanged", 1), 5: ("removed", 1), 6: ("new", 1)}
    assert sorted((r.doc_id, r.tenant_id, r.chunk) for r in chunks.collect()) == [(1, 2, "a"), (3, 1, "c"), (6, 1, "f")]


def test_history_over_gaps_in_turn_numbers(spark):
    t = spark.createDataFrame([(1, n, "caller", f"t{n}") for n in (1, 3, 9, 700)], "call_id long, turn_no long, role string, content string")
    got = {r.turn_no: r.history for r in RP.recent_history(t, 2).collect()}
    assert got == {1: [], 3: ["caller: t1"], 9: ["caller: t1", "caller: t3"], 700: ["caller: t3", "caller: t9"]}


def test_values_with_placeholders_are_not_expanded(spark):
    df = spark.createDataFrame([("Hi {{name}}, {{agent}} {{other}} {{name}}", "{{agent}}", "Ann $1 \\")], "t string, n string, a string")
    r = RU.render_template(df, "t", {"name": "n", "agent": "a"}).first()
    assert r.text == "Hi {{agent}}, Ann $1 \\ {{other}} {{agent}}"


def test_percentiles_are_exact_and_skip_nulls(spark):
    t = spark.createDataFrame([(1, x) for x in [5, 1, 3, 2, 4, None, 1000, 1000, 1000, 2000]] + [(2, None)], "tenant_id int, latency_ms int")
    got = {r.tenant_id: (r.turns, r.p50_ms, r.p95_ms, r.over_budget) for r in RP.latency_report(t, 900).collect()}
    assert got == {1: (10, 5, 2000, 0.4), 2: (1, None, None, 0.0)}


def test_month_sink_splits_and_prunes(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([(i, dt.datetime(2024, 1 + i % 2, 3)) for i in range(50)], "id int, ts timestamp")
    ST.write_by_month(df, str(tmp_path / "m"), "ts")
    assert ST.read_months(spark, str(tmp_path / "m"), "2024-02", "2024-02").count() == 25


def test_kb_files_in_nested_folders_and_rejects(spark, tmp_path):
    d = tmp_path / "root" / "tenants" / "5" / "menus"
    os.makedirs(d)
    (d / "a.txt").write_text("one\ntwo")
    r = K.read_kb_files(spark, str(tmp_path / "root")).first()
    assert (r.tenant_id, r.title, r.text) == ("5", "a", "one\ntwo")
    j = tmp_path / "json" / "tenants" / "6"
    os.makedirs(j)
    (j / "b.json").write_text('{"dish": "soup", "price": 3}\n{"dish": \nnot json\n')
    got = K.read_kb_files(spark, str(tmp_path / "json"), "json", "dish string, price int").collect()
    assert [(x.tenant_id, x.text) for x in got] == [("6", "dish: soup; price: 3")]
    assert K.kb_rejects(spark, str(tmp_path / "json"), "dish string, price int").count() == 2
    assert K.read_kb_files(spark, str(tmp_path / "json"), "json").count() == 1


def test_page_text_decodes_all_references(spark):
    p = spark.createDataFrame([("<title>caf&eacute; &#8217;</title><p>a&nbsp;&amp;lt; &#x41;</p>",), (None,)], "html string")
    got = sorted(((r.title, r.text) for r in K.extract_pages(p).collect()), key=str)
    assert got[0] == ("café ’", "a &lt; A")


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,512]")

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_scratch_is_released(spark):
    from tessera.operators.common import materialize
    m = materialize(spark.range(3))
    path = m.inputFiles()[0].replace("file://", "")
    assert m.count() == 3 and os.path.exists(path)
    assert session.release_scratch(spark) and not os.path.exists(path)


def test_lsh_keeps_few_candidates_and_finds_neighbours(spark):
    import random

    from tessera.operators import kb_search as S
    rnd = random.Random(1)
    rows = [(i, 0, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(400)]
    ch = spark.createDataFrame(rows, "chunk_id long, tenant_id int, embedding array<double>")
    q = spark.createDataFrame([(i, 0, [x + rnd.gauss(0, 0.1) for x in rows[i][2]]) for i in range(0, 400, 20)],
                              "query_id long, tenant_id int, query_vec array<double>")
    got = S.approx_search(q, ch, 400)
    assert got.count() / (20 * 400) < 0.15
    best = {r.query_id: r.chunk_id for r in got.filter(F.col("rank") == 1).collect()}
    assert sum(best.get(i) == i for i in range(0, 400, 20)) >= 19
