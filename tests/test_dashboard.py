import datetime as dt

from tessera.operators import dashboard as D


def test_recent_calls_ties_and_tenant_limit(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i < 5 else 2, "+1", "completed", 10, "x", "resolved", False, t, t, f"rec/{i}", None) for i in range(8)]
    calls = spark.createDataFrame(rows, "call_id long, tenant_id int, from_number string, status string, "
                                        "duration_sec int, intent string, outcome string, escalated boolean, "
                                        "started_at timestamp_ntz, ended_at timestamp_ntz, recording_url string, summary string")
    got = sorted((r.tenant_id, r.call_id, r.recording_url, r.summary) for r in D.recent_calls(calls, 2).collect())
    assert got == [(1, 3, "rec/3", None), (1, 4, "rec/4", None), (2, 6, "rec/6", None), (2, 7, "rec/7", None)]  # equal times: higher id first


def test_activity_feed_undated_last(spark):
    t = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(1, 7, "+1", "completed", t)],
                                  "call_id long, tenant_id int, from_number string, status string, started_at timestamp_ntz")
    bookings = spark.createDataFrame([(1, 7, 1, 5, "visit", "Guest 5", t - dt.timedelta(days=1))],
                                     "call_id long, tenant_id int, line_no int, part_id long, type string, "
                                     "customer_name string, created_at timestamp_ntz")
    leads = spark.createDataFrame([(9, 7, "Lead")], "lead_id long, tenant_id int, name string")
    notifs = spark.createDataFrame([(3, 7, "email", "sent", "a@b.c", t + dt.timedelta(hours=1))],
                                   "notification_id long, tenant_id int, channel string, status string, "
                                   "recipient string, created_at timestamp_ntz")
    feed = D.activity_feed(calls, bookings, leads, notifs, 10).collect()
    order = [r.kind for r in sorted(feed, key=lambda r: (r.event_at is None, -(r.event_at.timestamp() if r.event_at else 0)))]
    assert order == ["notification", "call", "booking", "lead"]
    assert len(D.activity_feed(calls, bookings, leads, notifs, 2).collect()) == 2


def test_scope_and_unconfigured(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tenant_id int, v string")
    assert sorted(r.v for r in D.scope(df, [1, 3]).collect()) == ["a", "c"]
    allowed = spark.createDataFrame([(2,), (2,)], "tenant_id int")
    assert [r.v for r in D.scope(df, allowed).collect()] == ["b"]
    cfg = spark.createDataFrame([(1,), (1,)], "tenant_id int")
    assert sorted(r.tenant_id for r in D.unconfigured(df, cfg).collect()) == [2, 3]


def _children(spark, n):
    from pyspark.sql import functions as F
    calls = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "call_id long, tenant_id int")
    when = F.timestamp_add("SECOND", (F.col("id") * 7919 % n).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    notifs = spark.range(n).select(F.lit(1).cast("long").alias("call_id"), F.lit(7).alias("tenant_id"), F.col("id").alias("notification_id"),
                                   F.lit("sent").alias("status"), F.when(F.col("id") > 2, when).alias("created_at"))
    turns = spark.createDataFrame([(2, 7, i, "caller", dt.datetime(2024, 1, 1)) for i in (2, 0, 1)] + [(9, 7, 0, "caller", None), (3, 7, 0, "x", None)],
                                  "call_id long, tenant_id int, turn_no long, role string, created_at timestamp_ntz")
    bookings = spark.createDataFrame([], "call_id long, tenant_id int, line_no int, part_id long, type string, scheduled_for timestamp_ntz")
    return calls, turns, bookings, notifs


def test_detail_in_parts_keeps_all_children_in_order_and_bounds_every_row(spark):
    import json
    n = 100_000
    calls, turns, bookings, notifs = _children(spark, n)
    parts = D.call_detail_parts(calls, turns, bookings, notifs, size=1000)
    from pyspark.sql import functions as F
    sizes = parts.groupBy("child").agg(F.max(F.size("items")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("rows")).collect()
    got = {r.child: (r.most, r["all"], r.rows) for r in sizes}
    assert got == {"notifications": (1000, n, 100), "turns": (3, 3, 1)}           # tenant 8's call doesn't take tenant 7's turn
    rows = sorted(parts.filter("child = 'notifications'").collect(), key=lambda r: r.part_no)
    seen = [(x["created_at"] or "", x["notification_id"]) for r in rows for x in map(json.loads, r["items"])]
    assert len(seen) == n and seen == sorted(seen) and [s[1] for s in seen[:3]] == [0, 1, 2]


def test_detail_in_parts_equals_the_nested_detail(spark):
    import json
    calls, turns, bookings, notifs = _children(spark, 300)
    for scoped in (True, False):
        drop = () if scoped else ("tenant_id",)
        kids = [x.drop(*drop) for x in (turns, bookings, notifs)]
        whole = {r.call_id: r for r in D.call_detail(calls, *kids, tenant_scoped=scoped).collect()}
        cut = D.call_detail_parts(calls, *kids, tenant_scoped=scoped, size=7).collect()
        for call, r in whole.items():
            for child, key in (("turns", "turn_no"), ("notifications", "notification_id")):
                mine = sorted((p for p in cut if p.call_id == call and p.child == child), key=lambda p: p.part_no)
                assert [p.part_no for p in mine] == list(range(len(mine)))
                assert [json.loads(x)[key] for p in mine for x in p["items"]] == [c[key] for c in r[child]]
