"""Registered queries: dashboard reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import dashboard as D
from .registry import V, register, tables, with_views

AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"

register("a1_call_stats", with_views("""
SELECT t.tenant_id,
  coalesce(c.total_calls, 0) AS total_calls, coalesce(c.escalated, 0) AS escalated,
  coalesce(c.completed, 0) AS completed,
  CAST(coalesce(round(c.a), 0) AS INTEGER) AS avg_duration_sec,
  coalesce(b.n, 0) AS bookings, coalesce(l.n, 0) AS leads
FROM v_tenants t LEFT JOIN c USING (tenant_id) LEFT JOIN b USING (tenant_id) LEFT JOIN l USING (tenant_id)
""", "v_tenants", "v_calls", "v_bookings", "v_leads", extra={
    "c": """SELECT tenant_id, count(*) AS total_calls, count(*) FILTER (WHERE escalated) AS escalated,
             count(*) FILTER (WHERE status = 'completed') AS completed, avg(duration_sec) AS a
             FROM v_calls GROUP BY tenant_id""",
    "b": "SELECT tenant_id, count(*) AS n FROM v_bookings GROUP BY tenant_id",
    "l": "SELECT tenant_id, count(*) AS n FROM v_leads GROUP BY tenant_id",
}))(lambda spark, sf: (lambda t: D.call_stats(V.tenants(t), V.calls(t), V.bookings(t), V.leads(t)))(tables(spark, sf)))


register("j3_record_counts", with_views("""
SELECT t.tenant_id, coalesce(b.n, 0) AS bookings, coalesce(l.n, 0) AS leads
FROM v_tenants t LEFT JOIN b USING (tenant_id) LEFT JOIN l USING (tenant_id)
""", "v_tenants", "v_bookings", "v_leads", extra={
    "b": "SELECT tenant_id, count(*) AS n FROM v_bookings GROUP BY tenant_id",
    "l": "SELECT tenant_id, count(*) AS n FROM v_leads GROUP BY tenant_id",
}))(lambda spark, sf: (lambda t: D.record_counts(V.tenants(t), V.bookings(t), V.leads(t)))(tables(spark, sf)))


def _j1(spark, sf):
    t = tables(spark, sf)
    n = V.notifications(t).select("notification_id", "call_id", "tenant_id", "channel", "status", "created_at")
    return D.notifications_with_caller(n, V.calls(t))


register("j1_notifications_with_caller", with_views("""
SELECT n.call_id, n.notification_id, n.tenant_id, n.channel, n.status, n.created_at, c.from_number
FROM v_notifications n LEFT JOIN v_calls c ON c.call_id = n.call_id
""", "v_notifications", "v_calls"))(_j1)


def _j2(spark, sf):
    t = tables(spark, sf)
    calls = V.calls(t).select("call_id", "tenant_id", "status", "started_at")
    turns = V.turns(t).select("call_id", "turn_no", "role", "created_at")
    bookings = V.bookings(t).select("call_id", "line_no", "part_id", "type", "scheduled_for")
    notifs = V.notifications(t).select("call_id", "notification_id", "status", "created_at")
    d = D.call_detail(calls, turns, bookings, notifs, tenant_scoped=False)
    return d.select(
        "call_id", "tenant_id", "status", "started_at",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["role"]), ",").alias("turn_roles"),
        F.size("bookings").alias("n_bookings"),
        F.array_join(F.transform("bookings", lambda x: x["type"]), ",").alias("booking_types"),
        F.size("notifications").alias("n_notifications"),
        F.array_join(F.transform("notifications", lambda x: x["notification_id"].cast("string")), ",")
         .alias("notification_ids"))


register("j2_call_detail", with_views("""
SELECT c.call_id, c.tenant_id, c.status, c.started_at,
  coalesce(t.n, 0) AS n_turns, coalesce(t.roles, '') AS turn_roles,
  coalesce(b.n, 0) AS n_bookings, coalesce(b.types, '') AS booking_types,
  coalesce(nn.n, 0) AS n_notifications, coalesce(nn.ids, '') AS notification_ids
FROM v_calls c
LEFT JOIN t ON t.call_id = c.call_id LEFT JOIN b ON b.call_id = c.call_id LEFT JOIN nn ON nn.call_id = c.call_id
""", "v_calls", "v_turns", "v_bookings", "v_notifications", extra={
    "t": """SELECT call_id, count(*) AS n, string_agg(role, ',' ORDER BY created_at, turn_no) AS roles
            FROM v_turns GROUP BY call_id""",
    "b": """SELECT call_id, count(*) AS n,
              string_agg(type, ',' ORDER BY scheduled_for, line_no, part_id, type) AS types
            FROM v_bookings GROUP BY call_id""",
    "nn": """SELECT call_id, count(*) AS n,
               string_agg(CAST(notification_id AS VARCHAR), ',' ORDER BY created_at, notification_id) AS ids
             FROM v_notifications GROUP BY call_id""",
}))(_j2)


def _j2p(spark, sf):
    """The same detail in parts of two children; the ids in a part show its order."""
    t = tables(spark, sf)
    parts = D.call_detail_parts(V.calls(t).select("call_id", "tenant_id"), V.turns(t).select("call_id", "turn_no", "role", "created_at"),
                                V.bookings(t).select("call_id", "line_no", "part_id", "type", "scheduled_for"),
                                V.notifications(t).select("call_id", "notification_id", "status", "created_at"), tenant_scoped=False, size=2)
    ids = F.transform("items", lambda x: F.coalesce(*[F.get_json_object(x, f"$.{c}") for c in ("notification_id", "turn_no", "line_no")]))
    return parts.select("call_id", "tenant_id", "child", "part_no", "n", F.array_join(ids, ",").alias("ids"))


register("j2_call_detail_parts", with_views("""
SELECT k.call_id, c.tenant_id, k.child, CAST((k.i - 1) // 2 AS BIGINT) AS part_no, count(*) AS n, string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.i) AS ids
FROM kids k JOIN v_calls c ON c.call_id = k.call_id GROUP BY ALL
""", "v_calls", "v_turns", "v_bookings", "v_notifications", extra={"kids": """
    SELECT call_id, 'turns' AS child, turn_no AS id, row_number() OVER (PARTITION BY call_id ORDER BY created_at, turn_no) AS i FROM v_turns
    UNION ALL SELECT call_id, 'bookings', line_no, row_number() OVER (PARTITION BY call_id ORDER BY scheduled_for, line_no, part_id) FROM v_bookings
    UNION ALL SELECT call_id, 'notifications', notification_id, row_number() OVER (PARTITION BY call_id ORDER BY created_at, notification_id) FROM v_notifications"""}))(_j2p)


register("j4_unconfigured", with_views("""
SELECT t.* FROM v_tenants t WHERE NOT EXISTS (
  SELECT 1 FROM v_configs c WHERE c.tenant_id = t.tenant_id AND c.template = 'school')
""", "v_tenants", "v_configs"))(      # tenants without a config of the school template
    lambda spark, sf: (lambda t: D.unconfigured(V.tenants(t), V.configs(t).filter(F.col("template") == "school")))(tables(spark, sf)))


register("f1_scope", with_views("""
SELECT c.call_id, c.tenant_id, c.status, c.started_at FROM v_calls c
WHERE c.tenant_id IN (SELECT tenant_id FROM v_tenants WHERE sector = 'hospital')
""", "v_calls", "v_tenants"))(
    lambda spark, sf: (lambda t: D.scope(V.calls(t).select("call_id", "tenant_id", "status", "started_at"),
                                         V.tenants(t).filter(F.col("sector") == "hospital")))(tables(spark, sf)))


register("f3_free_slots", with_views(f"""
SELECT * FROM v_availability WHERE NOT is_booked AND slot > {AS_OF_SQL}
""", "v_availability"))(lambda spark, sf: D.free_slots(V.availability(tables(spark, sf)), V.AS_OF))


register("t1_next_slots", with_views(f"""
SELECT tenant_id, resource_id, resource_name, slot, is_booked, order_key, line_no FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY slot, resource_id, order_key, line_no) AS rn
  FROM v_availability WHERE NOT is_booked AND slot > {AS_OF_SQL}) WHERE rn <= 5
""", "v_availability"))(lambda spark, sf: D.next_slots(V.availability(tables(spark, sf)), V.AS_OF, 5))


register("t2_recent_calls", with_views("""
SELECT call_id, tenant_id, from_number, status, duration_sec, intent, outcome, escalated, started_at, ended_at,
  recording_url, summary FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY started_at DESC, call_id DESC) AS rn FROM v_calls)
WHERE rn <= 100
""", "v_calls"))(lambda spark, sf: D.recent_calls(V.calls(tables(spark, sf)), 100))


register("t3_recent_notifications", with_views("""
SELECT n.call_id, n.notification_id, n.tenant_id, n.channel, n.recipient, n.status, n.provider_message_id,
       n.created_at, c.from_number
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, notification_id DESC) AS rn
      FROM v_notifications) n
LEFT JOIN v_calls c ON c.call_id = n.call_id WHERE n.rn <= 100
""", "v_notifications", "v_calls"))(
    lambda spark, sf: (lambda t: D.recent_notifications(V.notifications(t), V.calls(t), 100))(tables(spark, sf)))


_U1_SQL = """
SELECT tenant_id, 'call' AS kind, CAST(call_id AS VARCHAR) AS record_id, started_at AS event_at,
  concat_ws(' ', 'call from', from_number, status) AS text FROM v_calls
UNION ALL
SELECT tenant_id, 'booking', concat_ws('-', call_id, line_no, part_id), created_at,
  concat_ws(' ', type, 'for', customer_name) FROM v_bookings
UNION ALL
SELECT tenant_id, 'lead', CAST(lead_id AS VARCHAR), CAST(NULL AS TIMESTAMP), concat_ws(' ', 'lead', name) FROM v_leads
UNION ALL
SELECT tenant_id, 'notification', CAST(notification_id AS VARCHAR), created_at,
  concat_ws(' ', channel, status, 'to', recipient) FROM v_notifications
"""


def _u1(spark, sf):
    t = tables(spark, sf)
    return D.union_activity(V.calls(t), V.bookings(t), V.leads(t), V.notifications(t))


register("u1_union_activity", with_views("SELECT * FROM u", "v_calls", "v_bookings", "v_leads", "v_notifications",
                                         extra={"u": _U1_SQL}))(_u1)


def _t4(spark, sf):
    t = tables(spark, sf)
    # messages moved back to the time of the calls, so that all kinds compete
    n = V.notifications(t).withColumn("created_at", F.timestamp_add("DAY", F.lit(-8125), F.col("created_at")))
    return D.activity_feed(V.calls(t), V.bookings(t), V.leads(t), n, 20)


register("t4_activity_feed", with_views("""
SELECT tenant_id, kind, record_id, event_at, text FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY event_at DESC NULLS LAST, kind, record_id) AS rn FROM u)
WHERE rn <= 20
""", "v_calls", "v_bookings", "v_leads", "v_notifications", extra={
    "nb": "SELECT * REPLACE (created_at - INTERVAL 8125 DAY AS created_at) FROM v_notifications",
    "u": _U1_SQL.replace("v_notifications", "nb")}))(_t4)


def _f6(spark, sf):
    t = tables(spark, sf)
    return D.filter_calls(V.calls(t), V.tenants(t), start=dt.datetime(1996, 1, 1), end=dt.datetime(1997, 1, 1),
                          sector="school", status="completed")


register("f6_filter_calls", with_views("""
SELECT c.* FROM v_calls c
WHERE c.started_at >= TIMESTAMP '1996-01-01' AND c.started_at < TIMESTAMP '1997-01-01'
  AND c.status = 'completed'
  AND c.tenant_id IN (SELECT tenant_id FROM v_tenants WHERE sector = 'school')
""", "v_calls", "v_tenants"))(_f6)
