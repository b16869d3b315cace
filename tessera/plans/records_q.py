"""Registered queries: requests (S1, P1-P5, F2) and record keeping."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import requests as R
from ..operators import partitions as PT
from ..operators import store as ST
from ..session import shared_path
from ..sources import landing as L
from . import landing_sql as LS
from .registry import V, register, tables, with_views

CFG_AS_OF = dt.datetime(2024, 6, 1)


def _n(kind_sql, fields):
    return {"lnd": kind_sql, "nrm": LS.normalised("lnd", fields)}


register("p1_normalize_ingest", with_views("SELECT * FROM nrm", "v_docs", extra=_n(LS.INGEST, LS.INGEST_FIELDS)))(
    lambda spark, sf: R.normalize_ingest(L.ingest_requests(tables(spark, sf))))
register("p2_normalize_tool_call", with_views("SELECT * FROM nrm", extra=_n(LS.TOOL, LS.TOOL_FIELDS)))(
    lambda spark, sf: R.normalize_tool_call(L.tool_requests(tables(spark, sf))))
register("p3_normalize_call_end", with_views("SELECT * FROM nrm", "v_calls", extra=_n(LS.CALL_END, LS.CALL_END_FIELDS)))(
    lambda spark, sf: R.normalize_call_end(L.call_end_requests(tables(spark, sf))))
register("p4_normalize_search", with_views("SELECT * FROM nrm", "v_eval", extra=_n(LS.SEARCH, LS.SEARCH_FIELDS)))(
    lambda spark, sf: R.normalize_search(L.search_requests(tables(spark, sf))))

ROUTED = dict(_n(LS.TOOL, LS.TOOL_FIELDS), rt="""
SELECT *, CASE WHEN action IN ('search_knowledge', 'check_availability', 'book_appointment', 'make_reservation',
  'capture_lead') THEN action ELSE 'transfer_or_unknown' END AS route FROM nrm""")


def _routed(spark, sf):
    return R.route_actions(R.normalize_tool_call(L.tool_requests(tables(spark, sf))))


register("f2_route_actions", with_views("SELECT * FROM rt", extra=ROUTED))(_routed)

_CALL = """"tenantId" AS tenant_id, TRY_CAST(NULLIF("callId", '') AS BIGINT) AS call_id,
  (NULLIF("callId", '') IS NOT NULL AND TRY_CAST(NULLIF("callId", '') AS BIGINT) IS NULL) AS bad_call_id"""
_DT = """TRY_CAST(NULLIF(datetime, '') AS TIMESTAMP) AS scheduled_for,
  (NULLIF(datetime, '') IS NOT NULL AND TRY_CAST(NULLIF(datetime, '') AS TIMESTAMP) IS NULL) AS bad_datetime"""
BOOKING_SQL = f"""SELECT request_id, {_CALL}, 'appointment' AS type, name AS customer_name, phone AS customer_phone,
  email AS customer_email, CAST(NULL AS INTEGER) AS party_size, {_DT},
  to_json(struct_pack(doctor := doctor, notes := notes)) AS details FROM rt WHERE route = 'book_appointment'"""


def _split(spark, sf):
    return R.split_routes(R.normalize_tool_call(L.tool_requests(tables(spark, sf))))


register("p5_to_booking", with_views("SELECT * FROM bk", extra=dict(ROUTED, bk=BOOKING_SQL)))(
    lambda spark, sf: R.to_booking(_split(spark, sf)["book_appointment"]))
register("p5_to_reservation", with_views(f"""
SELECT request_id, {_CALL}, 'reservation' AS type, name AS customer_name, phone AS customer_phone,
  CAST(NULL AS VARCHAR) AS customer_email, CASE WHEN "partySize" = 0 THEN NULL ELSE "partySize" END AS party_size, {_DT},
  to_json(struct_pack(notes := notes)) AS details FROM rt WHERE route = 'make_reservation'
""", extra=ROUTED))(lambda spark, sf: R.to_reservation(_split(spark, sf)["make_reservation"]))
register("p5_to_lead", with_views(f"""
SELECT request_id, {_CALL}, name, phone, email, to_json(struct_pack(query := query, notes := notes)) AS data
FROM rt WHERE route = 'capture_lead'
""", extra=ROUTED))(lambda spark, sf: R.to_lead(_split(spark, sf)["capture_lead"]))


def _s1(spark, sf):
    """Lands the tool requests derived from ``events`` as JSON lines in the
    shared scratch folder, then reads them back with the explicit schema."""
    path = shared_path(spark, f"landing-tool-{uuid.uuid4().hex}")
    L.tool_requests(tables(spark, sf)).write.mode("overwrite").json(path)
    return R.normalize_tool_call(R.read_requests(spark, path, "tool"))


register("s1_read_requests", with_views("SELECT * FROM nrm", extra=_n(LS.TOOL, LS.TOOL_FIELDS)))(_s1)


register("s4_scan", with_views("""
SELECT call_id, from_number, status, started_at FROM v_calls WHERE tenant_id = 7
""", "v_calls"))(lambda spark, sf: ST.scan(V.calls(tables(spark, sf)), ["call_id", "from_number", "status", "started_at"], 7))


def _s5(spark, sf):
    b = R.to_booking(_split(spark, sf)["book_appointment"])
    out = ST.append(b, ["request_id", "tenant_id"], {"status": "confirmed"})
    return out.select("id", "request_id", "tenant_id", "type", "status")


register("s5_append", with_views("""
SELECT sha256(concat_ws(chr(31), coalesce(request_id, '\\N'), coalesce(tenant_id, '\\N'))) AS id,
  request_id, tenant_id, type, 'confirmed' AS status FROM bk
""", extra=dict(ROUTED, bk=BOOKING_SQL)))(_s5)


def _s6(spark, sf):
    t = tables(spark, sf)
    base = V.calls(t).select("call_id", "tenant_id", F.lit(None).cast("string").alias("summary"))
    ch = V.turns(t).groupBy("call_id").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" turns, "), F.sum("tokens").cast("string"),
                 F.lit(" words")).alias("summary"))
    return ST.update_by_key(base, ch, "call_id", ["summary"])


register("s6_update_by_key", with_views("""
SELECT c.call_id, c.tenant_id, s.summary FROM v_calls c LEFT JOIN s ON s.call_id = c.call_id
""", "v_calls", "v_turns", extra={"s": """SELECT call_id, CAST(count(*) AS VARCHAR) || ' turns, ' ||
    CAST(sum(tokens) AS VARCHAR) || ' words' AS summary FROM v_turns GROUP BY call_id"""}))(_s6)

CFG_COLS = ["config_id", "tenant_id", "template", "system_prompt", "greeting", "updated_at"]


def _incoming(t):
    tn = V.tenants(t)
    inc = tn.select("tenant_id", F.col("sector").alias("template"),
                    F.concat(F.lit("Prompt for "), F.col("name")).alias("system_prompt"),
                    F.concat(F.lit("Hello from "), F.col("name")).alias("greeting"))
    extra = tn.filter(F.col("region_id") == 0).select(
        (F.col("tenant_id") + 100).alias("tenant_id"), F.col("sector").alias("template"),
        F.concat(F.lit("Prompt for "), F.col("name")).alias("system_prompt"),
        F.concat(F.lit("Hello from "), F.col("name")).alias("greeting"))
    return inc.unionByName(extra)


def _s7(spark, sf):
    t = tables(spark, sf)
    base = V.configs(t).select(*CFG_COLS)
    return ST.upsert(base, _incoming(t), "tenant_id", ["template", "system_prompt", "greeting"],
                     id_col="config_id", ts_col="updated_at", as_of=CFG_AS_OF)


INC_SQL = """
SELECT tenant_id, sector AS template, 'Prompt for ' || name AS system_prompt, 'Hello from ' || name AS greeting
FROM v_tenants
UNION ALL
SELECT tenant_id + 100, sector, 'Prompt for ' || name, 'Hello from ' || name FROM v_tenants WHERE region_id = 0"""

register("s7_upsert", with_views("""
SELECT CAST(c.config_id AS VARCHAR) AS config_id, c.tenant_id,
  CASE WHEN i.tenant_id IS NOT NULL THEN i.template ELSE c.template END AS template,
  CASE WHEN i.tenant_id IS NOT NULL THEN i.system_prompt ELSE c.system_prompt END AS system_prompt,
  CASE WHEN i.tenant_id IS NOT NULL THEN i.greeting ELSE c.greeting END AS greeting,
  CASE WHEN i.tenant_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE c.updated_at END AS updated_at,
  CASE WHEN i.tenant_id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action
FROM v_configs c LEFT JOIN inc i ON i.tenant_id = c.tenant_id
UNION ALL
SELECT sha256(coalesce(CAST(i.tenant_id AS VARCHAR), '\\N')), i.tenant_id, i.template, i.system_prompt, i.greeting,
  TIMESTAMP '2024-06-01 00:00:00', 'inserted'
FROM inc i WHERE NOT EXISTS (SELECT 1 FROM v_configs c WHERE c.tenant_id = i.tenant_id)
""", "v_tenants", "v_configs", extra={"inc": INC_SQL}))(_s7)


def _s8(spark, sf):
    t = tables(spark, sf)
    rows = V.bookings(t).filter(F.col("customer_phone").isNotNull()).select(
        "tenant_id", F.col("customer_phone").alias("phone"), F.col("customer_name").alias("name"))
    return ST.insert_if_absent(V.leads(t), rows, ["tenant_id", "phone"], {"status": "new"})


register("s8_insert_if_absent", with_views("""
SELECT r.tenant_id, r.phone, r.name, 'new' AS status FROM (
  SELECT DISTINCT tenant_id, customer_phone AS phone, customer_name AS name FROM v_bookings
  WHERE customer_phone IS NOT NULL) r
WHERE NOT EXISTS (SELECT 1 FROM v_leads l WHERE l.tenant_id = r.tenant_id AND l.phone = r.phone)
""", "v_bookings", "v_leads"))(_s8)


def _s9(spark, sf):
    path = shared_path(spark, f"calls-by-month-{uuid.uuid4().hex}")
    ST.write_by_month(V.calls(tables(spark, sf)).select("call_id", "tenant_id", "started_at"), path, "started_at")
    return ST.read_months(spark, path, "1996-01", "1996-12")


register("s9_write_by_month", with_views("""
SELECT call_id, tenant_id, started_at, strftime(started_at, '%Y-%m') AS month FROM v_calls
WHERE strftime(started_at, '%Y-%m') BETWEEN '1996-01' AND '1996-12'
""", "v_calls"))(_s9)

POLICY_SQL = """SELECT tenant_id, retention_days FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY updated_at DESC, config_id DESC) AS rn FROM v_configs) WHERE rn = 1"""


def _s10(spark, sf):
    t = tables(spark, sf)
    pol = ST.retention_policies(V.configs(t))
    calls = V.calls(t).select("call_id", "tenant_id", "started_at")
    return ST.apply_retention(calls, pol, dt.datetime(1998, 6, 1), "started_at")


register("s10_apply_retention", with_views("""
SELECT c.call_id, c.tenant_id, c.started_at FROM v_calls c LEFT JOIN pol p ON p.tenant_id = c.tenant_id
WHERE p.retention_days IS NULL OR c.started_at >= TIMESTAMP '1998-06-01 00:00:00' - to_days(p.retention_days)
""", "v_calls", "v_configs", extra={"pol": POLICY_SQL}))(_s10)

def _s10p(spark, sf):
    """The same purge on the stored table by month, in place."""
    t = tables(spark, sf)
    path = shared_path(spark, f"calls-purged-{uuid.uuid4().hex}")
    ST.write_by_month(V.calls(t).select("call_id", "tenant_id", "started_at"), path, "started_at")
    PT.purge_months(spark, path, ST.retention_policies(V.configs(t)), dt.datetime(1998, 6, 1), "started_at")
    return spark.read.parquet(path).select("call_id", "tenant_id", "started_at")


register("s10_purge_months", with_views("""
SELECT c.call_id, c.tenant_id, c.started_at FROM v_calls c LEFT JOIN pol p ON p.tenant_id = c.tenant_id
WHERE p.retention_days IS NULL OR c.started_at >= TIMESTAMP '1998-06-01 00:00:00' - to_days(p.retention_days)
""", "v_calls", "v_configs", extra={"pol": POLICY_SQL}))(_s10p)


def _s11p(spark, sf):
    """The tenants of region 1 go from the stored tables; bookings and notifications of others lose what names their calls."""
    t = tables(spark, sf)
    root = shared_path(spark, f"tenant-tables-{uuid.uuid4().hex}")
    stored = {"calls": V.calls(t).select("call_id", "tenant_id"), "bookings": V.bookings(t).select("call_id", "tenant_id", "line_no", "part_id"),
              "notifications": V.notifications(t).select("notification_id", "call_id", "tenant_id")}
    paths = {n: f"{root}/{n}" for n in stored}
    for n, df in stored.items():
        PT.replace_partitions(df, paths[n], "tenant_id")
    tenants = [r[0] for r in V.tenants(t).filter(F.col("region_id") == 1).select("tenant_id").collect()]
    PT.delete_tenants(spark, paths, tenants, [("bookings", "call_id", "calls"), ("notifications", "call_id", "calls")])
    out = None
    for n in stored:
        part = spark.read.parquet(paths[n]).groupBy(F.col("tenant_id").cast("long").alias("tenant_id")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("call_id").isNull()).alias("null_call_ids"), F.sum("call_id").alias("call_ids"))
        part = part.withColumn("table_name", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


register("s11_delete_tenants", with_views("""
SELECT table_name, CAST(tenant_id AS BIGINT) AS tenant_id, count(*) AS rows, count(*) - count(id) AS null_call_ids, CAST(sum(id) AS BIGINT) AS call_ids FROM (
  SELECT x.table_name, x.tenant_id, CASE WHEN x.table_name <> 'calls' AND x.call_id IN (SELECT call_id FROM v_calls WHERE tenant_id IN (SELECT tenant_id FROM g))
         THEN NULL ELSE x.call_id END AS id
  FROM (SELECT 'calls' AS table_name, tenant_id, call_id FROM v_calls UNION ALL SELECT 'bookings', tenant_id, call_id FROM v_bookings
        UNION ALL SELECT 'notifications', tenant_id, call_id FROM v_notifications) x
  WHERE x.tenant_id NOT IN (SELECT tenant_id FROM g)) GROUP BY ALL
""", "v_tenants", "v_calls", "v_bookings", "v_notifications", extra={"g": "SELECT tenant_id FROM v_tenants WHERE region_id = 1"}))(_s11p)

CASCADE_RULES = [
    ("calls", "tenant_id", "tenants", "CASCADE"),
    ("bookings", "tenant_id", "tenants", "CASCADE"),
    ("leads", "tenant_id", "tenants", "CASCADE"),
    ("notifications", "tenant_id", "tenants", "CASCADE"),
    ("turns", "call_id", "calls", "CASCADE"),
    ("bookings", "call_id", "calls", "SET NULL"),
    ("notifications", "call_id", "calls", "SET NULL"),
]


def _s11(spark, sf):
    t = tables(spark, sf)
    tbl = {"tenants": V.tenants(t).select("tenant_id"),
           "calls": V.calls(t).select("call_id", "tenant_id"),
           "turns": V.turns(t).select("call_id", "turn_no", "tenant_id"),
           "bookings": V.bookings(t).select("call_id", "tenant_id", "line_no"),
           "leads": V.leads(t).select("lead_id", "tenant_id"),
           "notifications": V.notifications(t).select("notification_id", "call_id", "tenant_id")}
    keys = V.tenants(t).filter(F.col("region_id") == 1).select("tenant_id")
    out = ST.cascade_delete(tbl, CASCADE_RULES, "tenants", keys)
    parts = []
    for name, df in out.items():
        nulls = F.count_if(F.col("call_id").isNull()) if "call_id" in df.columns and name != "calls" \
            else F.lit(0).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("remaining"), nulls.alias("null_call_ids"))
                     .select(F.lit(name).alias("table_name"), "remaining", "null_call_ids"))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


register("s11_cascade_delete", with_views("""
SELECT 'tenants' AS table_name, count(*) AS remaining, CAST(0 AS BIGINT) AS null_call_ids
  FROM v_tenants WHERE tenant_id NOT IN (SELECT tenant_id FROM dk)
UNION ALL SELECT 'calls', count(*), 0 FROM v_calls WHERE tenant_id NOT IN (SELECT tenant_id FROM dk)
UNION ALL SELECT 'turns', count(*), count(*) FILTER (WHERE call_id IS NULL) FROM v_turns
  WHERE call_id NOT IN (SELECT call_id FROM dc)
UNION ALL SELECT 'bookings', count(*), count(*) FILTER (WHERE call_id IS NULL OR call_id IN (SELECT call_id FROM dc))
  FROM v_bookings WHERE tenant_id NOT IN (SELECT tenant_id FROM dk)
UNION ALL SELECT 'leads', count(*), 0 FROM v_leads WHERE tenant_id NOT IN (SELECT tenant_id FROM dk)
UNION ALL SELECT 'notifications', count(*), count(*) FILTER (WHERE call_id IS NULL OR call_id IN (SELECT call_id FROM dc))
  FROM v_notifications WHERE tenant_id NOT IN (SELECT tenant_id FROM dk)
""", "v_tenants", "v_calls", "v_turns", "v_bookings", "v_leads", "v_notifications", extra={
    "dk": "SELECT tenant_id FROM v_tenants WHERE region_id = 1",
    "dc": "SELECT call_id FROM v_calls WHERE tenant_id IN (SELECT tenant_id FROM dk)",
}))(_s11)


def _s12(spark, sf):
    t = tables(spark, sf)
    path = shared_path(spark, f"export-{uuid.uuid4().hex}")
    done = ST.export_tenant({"calls": V.calls(t), "bookings": V.bookings(t), "leads": V.leads(t),
                             "notifications": V.notifications(t)}, 3, path)
    res = None
    for name, p in done.items():
        part = spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        res = part if res is None else res.unionByName(part)
    return res


register("s12_export_tenant", with_views("""
SELECT 'calls' AS table_name, count(*) AS rows FROM v_calls WHERE tenant_id = 3
UNION ALL SELECT 'bookings', count(*) FROM v_bookings WHERE tenant_id = 3
UNION ALL SELECT 'leads', count(*) FROM v_leads WHERE tenant_id = 3
UNION ALL SELECT 'notifications', count(*) FROM v_notifications WHERE tenant_id = 3
""", "v_calls", "v_bookings", "v_leads", "v_notifications"))(_s12)



# S2 -----------------------------------------------------------------------
def _kb_folder(spark, name: str) -> str:
    return shared_path(spark, f"kb-{name}-{uuid.uuid4().hex}")


def _s2(spark, sf):
    """Documents as whole text files in one folder per tenant, below a root
    folder; every character comes back under its tenant."""
    from ..operators import kb_text as K

    path = _kb_folder(spark, "text")
    V.docs(tables(spark, sf)).select("tenant_id", "content").write.partitionBy("tenant_id").text(f"{path}/tenants")
    return K.read_kb_files(spark, path, "text").groupBy(F.col("tenant_id").cast("int").alias("tenant_id")) \
        .agg(F.sum(F.length("text")).alias("chars"))


def _kb_json(spark, sf) -> str:
    """Documents as JSON lines by tenant; of some a broken copy of the line."""
    path = _kb_folder(spark, "json")
    d = V.docs(tables(spark, sf)).select("tenant_id", F.to_json(F.struct("doc_id", "content")).alias("line"), "doc_id")
    bad = d.filter(F.col("doc_id") % 10 == 3).withColumn("line", F.concat(F.lit("{broken "), F.col("doc_id").cast("string")))
    d.unionByName(bad).select("tenant_id", "line").write.partitionBy("tenant_id").text(f"{path}/deep/er")
    return path


KB_SCHEMA = "doc_id long, content string"


def _s2j(spark, sf):
    from ..operators import kb_text as K
    return K.read_kb_files(spark, _kb_json(spark, sf), "json", KB_SCHEMA).select(F.col("tenant_id").cast("int").alias("tenant_id"), "text")


def _s2r(spark, sf):
    from ..operators import kb_text as K
    return K.kb_rejects(spark, _kb_json(spark, sf), KB_SCHEMA).select(F.col("tenant_id").cast("int").alias("tenant_id"), "line")


def _s2c(spark, sf):
    from ..operators import kb_text as K

    path = _kb_folder(spark, "csv")
    p = tables(spark, sf).part.select((F.col("p_partkey") % 25).alias("tenant_id"), "p_partkey", "p_name", "p_brand")
    p.write.option("header", True).partitionBy("tenant_id").csv(f"{path}/tables")
    return K.read_kb_files(spark, path, "csv").select(F.col("tenant_id").cast("int").alias("tenant_id"), "text")


register("s2_read_kb_files", with_views("SELECT tenant_id, CAST(sum(length(content) + 1) AS BIGINT) AS chars FROM v_docs GROUP BY tenant_id", "v_docs"))(_s2)
register("s2_read_kb_json", with_views("SELECT tenant_id, 'doc_id: ' || doc_id || '; content: ' || content AS text FROM v_docs", "v_docs"))(_s2j)
register("s2_kb_rejects", with_views("SELECT tenant_id, '{broken ' || doc_id AS line FROM v_docs WHERE doc_id % 10 = 3", "v_docs"))(_s2r)
register("s2_read_kb_csv", """SELECT CAST(p_partkey % 25 AS INTEGER) AS tenant_id,
  'p_partkey: ' || p_partkey || '; p_name: ' || p_name || '; p_brand: ' || p_brand AS text FROM part""")(_s2c)


# X11 ----------------------------------------------------------------------
def _x11(spark, sf):
    from ..operators.dashboard import free_slots

    av = V.availability(tables(spark, sf))
    a = free_slots(av, dt.datetime(1997, 1, 1)).groupBy("tenant_id").count().withColumnRenamed("count", "free_1997")
    b = free_slots(av, dt.datetime(1999, 1, 1)).groupBy("tenant_id").count().withColumnRenamed("count", "free_1999")
    return a.join(b, "tenant_id", "full").select("tenant_id", F.coalesce("free_1997", F.lit(0)).alias("free_1997"),
                                                 F.coalesce("free_1999", F.lit(0)).alias("free_1999"))


register("x11_as_of", with_views("""
SELECT tenant_id, count(*) FILTER (WHERE slot > TIMESTAMP '1997-01-01 00:00:00') AS free_1997,
  count(*) FILTER (WHERE slot > TIMESTAMP '1999-01-01 00:00:00') AS free_1999
FROM v_availability WHERE NOT is_booked AND slot > TIMESTAMP '1997-01-01 00:00:00' GROUP BY tenant_id
""", "v_availability"))(_x11)
