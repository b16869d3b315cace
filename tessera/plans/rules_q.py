"""Registered queries: rules, notifications and follow-up (F4, F5, F7-F10,
J5, J6, P6-P9, Q7-Q9, Q11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import content_key
from ..operators import kb_text as K
from ..operators import passages as P
from ..operators import reports as RP
from ..operators import requests as R
from ..operators import rules as RU
from ..operators.common import latest
from ..sources import landing as L
from .records_q import ROUTED
from .registry import V, register, tables, with_views
from .reports_q import LATEST_CFG, QHITS, QPASSAGES, _questions

NOTIFY_AS_OF = dt.datetime(2024, 1, 15)
REMIND_AS_OF = dt.datetime(1998, 6, 1)
SLOT_AS_OF = dt.datetime(1998, 6, 1)

BKEY_SQL = ("sha256(concat_ws(chr(31), coalesce(CAST(call_id AS VARCHAR), '\\N'), coalesce(CAST(line_no AS VARCHAR), '\\N'), "
            "coalesce(CAST(part_id AS VARCHAR), '\\N'), coalesce(CAST(resource_id AS VARCHAR), '\\N'), "
            "coalesce(CAST(scheduled_for AS VARCHAR), '\\N')))")
BK = {"bk": f"SELECT *, {BKEY_SQL} AS booking_key FROM v_bookings"}


def bookings_keyed(t) -> DataFrame:
    b = V.bookings(t)
    return b.withColumn("booking_key", content_key("call_id", "line_no", "part_id", "resource_id", "scheduled_for"))


def current_config(t) -> DataFrame:
    c = V.configs(t)
    return latest(c, "tenant_id", "updated_at", tie=["config_id"])


# F4 -----------------------------------------------------------------------
def _f4(spark, sf):
    t = tables(spark, sf)
    return RU.flag_business_hours(V.calls(t), V.tenants(t), current_config(t))


register("f4_flag_business_hours", with_views("""
SELECT call_id, tenant_id, local_start,
  (isodow(local_start) - 1 IN (0, 1, 2, 3, 4, 5)) AND hour(local_start) >= open_hour AND hour(local_start) < close_hour
    AS in_hours
FROM (SELECT c.call_id, c.tenant_id, timezone(t.timezone, timezone('UTC', c.started_at)) AS local_start,
        q.open_hour, q.close_hour
      FROM v_calls c LEFT JOIN v_tenants t ON t.tenant_id = c.tenant_id LEFT JOIN lc q ON q.tenant_id = c.tenant_id)
""", "v_calls", "v_tenants", "v_configs", extra={"lc": LATEST_CFG}))(_f4)


# F5 -----------------------------------------------------------------------
# The default rules and two more, whose words the test conversations use.
QUERY_RULES = (*RU.ESCALATION_RULES, ("past", ("was", "were"), 2), ("company", ("with", "und"), 4))
RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', '{r}', {p})" for r, ws, p in QUERY_RULES for w in ws) + ") AS r(term, rule, priority)"
TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"

register("f5_flag_escalations", with_views(f"""
SELECT x.call_id, x.turn_no, x.tenant_id, array_to_string(list_sort(list(DISTINCT r.rule)), ',') AS rules,
  min(r.priority) AS priority
FROM (SELECT DISTINCT call_id, turn_no, tenant_id, term FROM (
        SELECT call_id, turn_no, tenant_id, unnest({TOK.format(c='content')}) AS term FROM v_turns WHERE role = 'caller')) x
JOIN r ON r.term = x.term GROUP BY ALL
""", "v_turns", extra={"r": RULES_SQL}))(
    lambda spark, sf: RU.flag_escalations(V.turns(tables(spark, sf)), RU.escalation_rules(spark, QUERY_RULES)))


# F7 / F8 / P7 / Q8 -------------------------------------------------------------
PLAN_SQL = """
SELECT b.booking_key, b.tenant_id, b.resource_id, b.scheduled_for, b.party_size, b.customer_name, b.type,
  b.customer_phone, b.line_no, ch.channel,
  CASE WHEN ch.channel = 'whatsapp' THEN b.customer_phone ELSE b.customer_email END AS recipient,
  CASE WHEN NOT coalesce(CASE WHEN ch.channel = 'whatsapp' THEN q.whatsapp_enabled ELSE q.email_enabled END, false)
         THEN 'channel disabled'
       WHEN coalesce(CASE WHEN ch.channel = 'whatsapp' THEN b.customer_phone ELSE b.customer_email END, '') = ''
         THEN 'no contact' END AS reason
FROM bk b CROSS JOIN (VALUES ('whatsapp'), ('email')) ch(channel) LEFT JOIN lc q ON q.tenant_id = b.tenant_id"""
PLAN = dict(BK, lc=LATEST_CFG, pl=PLAN_SQL)


def plan(t) -> DataFrame:
    b = bookings_keyed(t).select("booking_key", "tenant_id", "resource_id", "scheduled_for", "party_size",
                                 "customer_name", "type", "customer_phone", "customer_email", "line_no")
    return RU.plan_notifications(b, current_config(t))


register("f7_plan_notifications", with_views("""
SELECT booking_key, tenant_id, channel, recipient, reason, reason IS NULL AS send FROM pl
""", "v_bookings", "v_configs", extra=PLAN))(
    lambda spark, sf: plan(tables(spark, sf)).select("booking_key", "tenant_id", "channel", "recipient", "reason", "send"))


def consents(t) -> DataFrame:
    """Consent log derived from bookings: a reservation's contact said STOP,
    any other booking's contact opted in, at the booking's creation."""
    b = bookings_keyed(t).filter(F.col("customer_phone").isNotNull())
    return b.select(F.col("customer_phone").alias("recipient"),
                    F.when(F.col("type") == "reservation", "stop").otherwise("opt_in").alias("consent"),
                    F.col("created_at").alias("ts"), F.col("booking_key").alias("seq"))


CONSENT = dict(PLAN, cs="""SELECT customer_phone AS recipient,
    CASE WHEN type = 'reservation' THEN 'stop' ELSE 'opt_in' END AS consent, created_at AS ts, booking_key AS seq
  FROM bk WHERE customer_phone IS NOT NULL""", lcs="""SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY recipient ORDER BY ts DESC, seq DESC) AS rn FROM cs) WHERE rn = 1""")


def _f8(spark, sf):
    t = tables(spark, sf)
    sends = plan(t).filter(F.col("send") & (F.col("channel") == "whatsapp"))
    return RU.suppress(sends, consents(t)).select("booking_key", "tenant_id", "recipient")


register("f8_suppress", with_views("""
SELECT p.booking_key, p.tenant_id, p.recipient FROM pl p
WHERE p.reason IS NULL AND p.channel = 'whatsapp'
  AND p.recipient IN (SELECT recipient FROM lcs WHERE consent = 'opt_in')
""", "v_bookings", "v_configs", extra=CONSENT))(_f8)


def _p7(spark, sf):
    t = tables(spark, sf)
    sends = plan(t).filter(F.col("send"))
    return RU.render_confirmations(sends, V.tenants(t), RU.confirmation_templates(spark), department=F.lit("General"),
                                   link=F.lit("https://example.com/brochure"))


TPL_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('{s}', '{c}', '{t}')".format(s=s, c=c, t=txt.replace("'", "''"))
    for s, txt in RU.CONFIRMATIONS.items() for c in ("email", "whatsapp")) + ") AS t(sector, channel, template)"


def _fill(expr: str) -> str:
    var = {"doctor": "CAST(p.resource_id AS VARCHAR)", "date": "strftime(p.scheduled_for, '%Y-%m-%d')",
           "time": "strftime(p.scheduled_for, '%H:%M')", "dept": "'General'", "id": "p.booking_key",
           "link": "'https://example.com/brochure'", "party": "CAST(p.party_size AS VARCHAR)",
           "restaurant": "t.name", "name": "p.customer_name", "summary": "p.type", "phone": "p.customer_phone"}
    for k, v in var.items():
        expr = f"replace({expr}, '{{{k}}}', coalesce({v}, ''))"
    return expr


register("p7_render_confirmations", with_views(f"""
SELECT p.booking_key, p.tenant_id, p.channel, p.recipient,
  {_fill("coalesce(tp.template, g.template)")} AS text
FROM pl p LEFT JOIN v_tenants t ON t.tenant_id = p.tenant_id
LEFT JOIN tpl tp ON tp.sector = t.sector AND tp.channel = p.channel
LEFT JOIN tpl g ON g.sector = 'generic' AND g.channel = p.channel
WHERE p.reason IS NULL
""", "v_bookings", "v_configs", "v_tenants", extra=dict(PLAN, tpl=TPL_SQL)))(_p7)


def _q8(spark, sf):
    t = tables(spark, sf)
    b = bookings_keyed(t)
    sent = b.filter(F.col("line_no") == 1).select("booking_key")
    out = RU.reminder_targets(b, consents(t), sent, REMIND_AS_OF, 24 * 7)
    return out.select("booking_key", "tenant_id", "scheduled_for", "recipient")


register("q8_reminder_targets", with_views("""
SELECT b.booking_key, b.tenant_id, b.scheduled_for, b.customer_phone AS recipient FROM bk b
WHERE b.scheduled_for > TIMESTAMP '1998-06-01 00:00:00' AND b.scheduled_for <= TIMESTAMP '1998-06-08 00:00:00'
  AND b.customer_phone IN (SELECT recipient FROM lcs WHERE consent = 'opt_in')
  AND b.booking_key NOT IN (SELECT booking_key FROM bk WHERE line_no = 1)
""", "v_bookings", "v_configs", extra=CONSENT))(_q8)


# F9 -----------------------------------------------------------------------
def enabled_tools(t) -> DataFrame:
    """Enabled tool lists from the current config: small agents (fewer than 4
    concurrent calls) have lead capture switched off; others keep all."""
    c = current_config(t)
    lst = F.array(*[F.lit(x) for x in ("search_knowledge", "check_availability", "book_appointment",
                                       "make_reservation", "transfer_or_unknown")])
    return c.select("tenant_id", F.when(F.col("max_concurrent") < 4, lst).alias("enabled_tools"))


def _f9(spark, sf):
    t = tables(spark, sf)
    allowed = RU.allowed_tools(V.tenants(t), enabled_tools(t), RU.sector_tools(spark))
    calls = R.route_actions(R.normalize_tool_call(L.tool_requests(t))).select(
        "request_id", F.col("tenantId").cast("int").alias("tenant_id"), "route")
    return RU.flag_tool_calls(calls, allowed)


ST_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('{s}', [{t}])".format(s=s, t=", ".join(f"'{x}'" for x in ts)) for s, ts in RU.SECTOR_TOOLS.items()) + \
    ") AS s(sector, tools)"

register("f9_allowed_tools", with_views("""
SELECT r.request_id, CAST(r."tenantId" AS INTEGER) AS tenant_id, r.route, coalesce(list_contains(a.allowed, r.route), false) AS allowed
FROM rt r LEFT JOIN (
  SELECT t.tenant_id, CASE WHEN q.max_concurrent < 4 THEN list_intersect(s.tools, ['search_knowledge',
      'check_availability', 'book_appointment', 'make_reservation', 'transfer_or_unknown']) ELSE s.tools END AS allowed
  FROM v_tenants t LEFT JOIN st s ON s.sector = t.sector LEFT JOIN lc q ON q.tenant_id = t.tenant_id) a
ON a.tenant_id = CAST(r."tenantId" AS INTEGER)
""", "v_tenants", "v_configs", extra=dict(ROUTED, st=ST_SQL, lc=LATEST_CFG)))(_f9)


# F10 ----------------------------------------------------------------------
FORBIDDEN = ["guarantee", "diagnos", "refund", "with the", " und die "]
REQUIRED = ["thank", " the "]


def _f10(spark, sf):
    bad, miss = RU.check_phrases(V.turns(tables(spark, sf)), FORBIDDEN, REQUIRED)
    a = bad.select(F.lit("forbidden").alias("kind"), "call_id", "turn_no", F.array_join("phrases", ",").alias("phrases"))
    b = miss.select(F.lit("missing").alias("kind"), "call_id", F.lit(None).cast("long").alias("turn_no"),
                    F.array_join("missing", ",").alias("phrases"))
    return a.unionByName(b)


def _has(c, p):
    return f"CASE WHEN contains(lower({c}), '{p}') THEN '{p}' END"


register("f10_check_phrases", with_views(f"""
SELECT 'forbidden' AS kind, call_id, turn_no, array_to_string(ph, ',') AS phrases FROM (
  SELECT call_id, turn_no, list_filter([{', '.join(_has('content', p) for p in FORBIDDEN)}], lambda x: x IS NOT NULL) AS ph
  FROM v_turns WHERE role = 'agent') WHERE len(ph) > 0
UNION ALL
SELECT 'missing', call_id, NULL, array_to_string(ph, ',') FROM (
  SELECT call_id, list_filter([{', '.join(f"CASE WHEN max(CAST(contains(lower(content), '{p}') AS INTEGER)) = 0 THEN '{p}' END" for p in REQUIRED)}],
    lambda x: x IS NOT NULL) AS ph
  FROM v_turns WHERE role = 'agent' GROUP BY call_id) WHERE len(ph) > 0
""", "v_turns"))(_f10)


# J5 -----------------------------------------------------------------------
def _j5(spark, sf):
    t = tables(spark, sf)
    leads = R.to_lead(R.split_routes(R.normalize_tool_call(L.tool_requests(t)))["capture_lead"])
    appts = V.bookings(t).filter(F.col("type") == "appointment")
    calls = V.calls(t).select("call_id", "tenant_id", "status")
    return RU.calls_with_outcome(calls, appts, leads)


register("j5_calls_with_outcome", with_views("""
SELECT c.call_id, c.tenant_id, c.status FROM v_calls c
WHERE c.call_id IN (SELECT call_id FROM v_bookings WHERE type = 'appointment')
   OR c.call_id IN (SELECT TRY_CAST(NULLIF("callId", '') AS BIGINT) FROM rt WHERE route = 'capture_lead'
                    AND TRY_CAST(NULLIF("callId", '') AS BIGINT) IS NOT NULL)
""", "v_calls", "v_bookings", extra=ROUTED))(_j5)


# J6 -----------------------------------------------------------------------
def numbers(t) -> DataFrame:
    """Phone numbers: tenants of regions 0-2 own their toll-free number."""
    return V.tenants(t).filter(F.col("region_id") < 3).select(
        F.concat(F.lit("+1800"), F.lpad(F.col("tenant_id").cast("string"), 7, "0")).alias("e164"),
        "tenant_id", F.concat(F.lit("num-"), F.col("tenant_id").cast("string")).alias("number_id"))


register("j6_resolve_number", with_views("""
SELECT c.call_id, c.tenant_id, c.to_number, n.tenant_id AS number_tenant, n.number_id, q.config_id AS agent_config_id
FROM v_calls c
LEFT JOIN (SELECT '+1800' || lpad(CAST(tenant_id AS VARCHAR), 7, '0') AS e164, tenant_id,
             'num-' || CAST(tenant_id AS VARCHAR) AS number_id FROM v_tenants WHERE region_id < 3) n ON n.e164 = c.to_number
LEFT JOIN lc q ON q.tenant_id = n.tenant_id
""", "v_calls", "v_tenants", "v_configs", extra={"lc": LATEST_CFG}))(
    lambda spark, sf: (lambda t: RU.resolve_number(V.calls(t), numbers(t), V.configs(t)))(tables(spark, sf)))


# P6 -----------------------------------------------------------------------
def _p6(spark, sf):
    t = tables(spark, sf)
    c = V.configs(t).join(V.tenants(t).select("tenant_id", F.col("name").alias("tenant_name")), "tenant_id", "left")
    out = RU.render_template(c, "greeting", {"tenant": "tenant_name", "agent": "agent_name"})
    return out.select("config_id", "tenant_id", "text")


register("p6_render_template", with_views("""
SELECT c.config_id, c.tenant_id,
  replace(replace(c.greeting, '{{tenant}}', coalesce(t.name, '')), '{{agent}}', coalesce(c.agent_name, '')) AS text
FROM v_configs c LEFT JOIN v_tenants t ON t.tenant_id = c.tenant_id
""", "v_configs", "v_tenants"))(_p6)


SEC_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (s, *row)) + ")" for s, row in RU.SECTOR_TEMPLATES.items()) + \
    ") AS s(sector, system_prompt, languages, safety, tone)"


# P8 -----------------------------------------------------------------------
def _p8(spark, sf):
    t = tables(spark, sf)
    q = _questions(t)
    # the chunk that matched best in each of the best documents, with its source
    hits = P.passage_texts(P.search_passages(q, V.docs(t), 3), V.docs(t), keep=("source",))
    line = F.struct("rank", F.concat("chunk", F.lit(" (source: "), "source", F.lit(")")).alias("text"))
    ctx = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("h")).select(
        "query_id", F.array_join(F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"),
                                                                      F.lit("] "), x["text"])), "\n").alias("context"))
    hist = RP.recent_history(V.turns(t).select("call_id", "turn_no", "role", "content"), 3).select(
        (F.col("call_id") * 100 + F.col("turn_no")).alias("query_id"), F.array_join("history", "\n").alias("history"))
    return RU.assemble_prompts(q, ctx, hist, current_config(t), V.tenants(t), RU.sector_templates(spark))


register("p8_assemble_prompts", with_views("""
SELECT q.query_id, q.tenant_id, concat_ws(chr(10) || chr(10),
  'SYSTEM: ' || coalesce(lc.system_prompt, ''),
  'RULES: ' || coalesce(sec.safety, '') || ' Tone: ' || coalesce(sec.tone, '') || '.', 'CONTEXT:' || chr(10) || coalesce(cx.context, ''),
  'HISTORY:' || chr(10) || coalesce(hs.history, ''), 'CALLER: ' || q.query_text) AS prompt
FROM qs q
LEFT JOIN (SELECT k.query_id, string_agg('[' || CAST(k.rank AS VARCHAR) || '] ' || p.chunk
             || ' (source: ' || d.source || ')', chr(10) ORDER BY k.rank)
             AS context FROM pbest k JOIN v_docs d ON d.doc_id = k.doc_id JOIN pch p ON p.doc_id = k.doc_id AND p.chunk_no = k.chunk_no
           GROUP BY k.query_id) cx ON cx.query_id = q.query_id
LEFT JOIN (SELECT call_id * 100 + turn_no AS query_id, array_to_string(coalesce(list(role || ': ' || content) OVER (
             PARTITION BY call_id ORDER BY turn_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), chr(10)) AS history
           FROM v_turns) hs ON hs.query_id = q.query_id
LEFT JOIN lc ON lc.tenant_id = q.tenant_id
LEFT JOIN v_tenants tn ON tn.tenant_id = q.tenant_id LEFT JOIN sec ON sec.sector = tn.sector
""", "v_turns", "v_docs", "v_configs", "v_tenants", extra=dict(QPASSAGES, lc=LATEST_CFG, sec=SEC_SQL)))(_p8)


# P9 -----------------------------------------------------------------------
def _p9(spark, sf):
    t = tables(spark, sf)
    tn = V.tenants(t).select("tenant_id", "sector", "region_id")
    # a new tenant beside each old one; those of region 4 have a sector without a template
    new = tn.unionByName(tn.withColumn("tenant_id", F.col("tenant_id") + 100).withColumn(
        "sector", F.when(F.col("region_id") == 4, "library").otherwise(F.col("sector"))))
    out = RU.seed_configs(new, RU.sector_templates(spark), RU.sector_tools(spark), V.configs(t))
    return out.withColumn("tools", F.array_join("tools", ","))


register("p9_seed_configs", with_views("""
SELECT sha256(coalesce(CAST(n.tenant_id AS VARCHAR), '\\N')) AS config_id, n.tenant_id,
  coalesce(n.sector, 'generic') AS template,
  s.system_prompt, s.languages, s.safety AS safety_rules, s.tone, array_to_string(st.tools, ',') AS tools
FROM (SELECT tenant_id, sector FROM v_tenants
      UNION ALL SELECT tenant_id + 100, CASE WHEN region_id = 4 THEN 'library' ELSE sector END FROM v_tenants) n
LEFT JOIN sec s ON s.sector = CASE WHEN n.sector IN (SELECT sector FROM sec) THEN n.sector ELSE 'generic' END
LEFT JOIN st ON st.sector = s.sector
WHERE NOT EXISTS (SELECT 1 FROM v_configs c WHERE c.tenant_id = n.tenant_id)
""", "v_tenants", "v_configs", extra={"sec": SEC_SQL, "st": ST_SQL}))(_p9)


# Q7 -----------------------------------------------------------------------
register("q7_retry_plan", with_views("""
SELECT notification_id, tenant_id, channel, attempts, nxt AS next_attempt_at,
  (NOT (attempts >= 5)) AND nxt <= TIMESTAMP '2024-01-15 00:00:00' AS due, attempts >= 5 AS give_up
FROM (SELECT *, created_at + to_seconds(CAST(least(CAST(60 AS DOUBLE), CAST(1 AS DOUBLE) * pow(CAST(2 AS DOUBLE), attempts))
        * 60 AS BIGINT)) AS nxt FROM v_notifications WHERE status = 'failed')
""", "v_notifications"))(lambda spark, sf: RU.retry_plan(V.notifications(tables(spark, sf)), NOTIFY_AS_OF))


# Q9 -----------------------------------------------------------------------
def replies(t) -> DataFrame:
    """Inbound replies derived from ``lineitem``: the contact of a line (the
    booking view's phone rule) answers at ship time plus its line number in
    hours, with a word chosen by its discount and tax; phones arrive in the
    00-prefixed form."""
    l = t.lineitem
    phone = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("001"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")))
    txt = (F.when(F.col("l_discount") >= 0.09, F.lit("cancel")).when(F.col("l_discount") <= 0.01, F.lit(" Reschedule please"))
            .when(F.col("l_tax") >= 0.08, F.lit("STOP")).otherwise(F.lit("thanks")))
    key = content_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return l.select(phone.alias("phone"), txt.alias("text"),
                    F.timestamp_add("HOUR", F.col("l_linenumber"), F.col("l_shipdate")).alias("ts"),
                    key.alias("seq")).filter(F.col("phone").isNotNull())


def _q9(spark, sf):
    t = tables(spark, sf)
    b = bookings_keyed(t).select("booking_key", "tenant_id", "customer_phone", "status")
    return RU.apply_replies(b, replies(t))


E164_SQL = """CASE WHEN regexp_full_match({x}, '^\\+[1-9][0-9]{{1,14}}$') THEN {x} END"""
register("q9_apply_replies", with_views(f"""
SELECT b.booking_key, b.tenant_id, b.customer_phone, coalesce(a.new_status, b.status) AS status,
  coalesce(a.word = 'stop', false) AS opted_out
FROM bk b LEFT JOIN (
  SELECT phone, word, CASE word WHEN 'cancel' THEN 'cancelled' WHEN 'reschedule' THEN 'reschedule_requested' END AS new_status
  FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY ts DESC, seq DESC) AS rn FROM (
    SELECT {E164_SQL.format(x='p')} AS phone, ts, seq, {TOK.format(c='text')}[1] AS word FROM (
      SELECT CASE WHEN starts_with(trim(r.phone), '+') THEN '+' || regexp_replace(trim(r.phone), '[^0-9]', '', 'g')
                  WHEN starts_with(regexp_replace(trim(r.phone), '[^0-9]', '', 'g'), '00')
                    THEN '+' || substr(regexp_replace(trim(r.phone), '[^0-9]', '', 'g'), 3)
                  WHEN length(regexp_replace(trim(r.phone), '[^0-9]', '', 'g')) > 10
                    THEN '+' || regexp_replace(trim(r.phone), '[^0-9]', '', 'g')
                  ELSE '+1' || regexp_replace(trim(r.phone), '[^0-9]', '', 'g') END AS p, r.ts, r.seq, r.text
      FROM rp r)) WHERE phone IS NOT NULL) WHERE rn = 1) a ON a.phone = b.customer_phone
""", "v_bookings", extra=dict(BK, rp="""
  SELECT * FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL
      ELSE '001' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') END AS phone,
    CASE WHEN l_discount >= 0.09 THEN 'cancel' WHEN l_discount <= 0.01 THEN ' Reschedule please'
         WHEN l_tax >= 0.08 THEN 'STOP' ELSE 'thanks' END AS text,
    l_shipdate + to_hours(l_linenumber) AS ts,
    sha256(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
      CAST(l_suppkey AS VARCHAR), CAST(l_shipdate AS VARCHAR))) AS seq
  FROM lineitem) WHERE phone IS NOT NULL""")))(_q9)


# Q11 ----------------------------------------------------------------------
def _q11(spark, sf):
    t = tables(spark, sf)
    from ..operators.dashboard import free_slots
    slots = free_slots(V.availability(t), SLOT_AS_OF)
    reqs = bookings_keyed(t).filter(F.col("status") == "pending")
    return RU.fill_waitlist(slots, reqs)


register("q11_fill_waitlist", with_views("""
SELECT r.tenant_id, r.resource_id, r.i, r.booking_key, r.created_at, s.slot FROM
  (SELECT tenant_id, resource_id, booking_key, created_at,
     row_number() OVER (PARTITION BY tenant_id, resource_id ORDER BY created_at, booking_key) AS i
   FROM bk WHERE status = 'pending') r
JOIN (SELECT tenant_id, resource_id, slot,
        row_number() OVER (PARTITION BY tenant_id, resource_id ORDER BY slot, order_key, line_no) AS i
      FROM v_availability WHERE NOT is_booked AND slot > TIMESTAMP '1998-06-01 00:00:00') s
  ON s.tenant_id = r.tenant_id AND s.resource_id = r.resource_id AND s.i = r.i
""", "v_bookings", "v_availability", extra=BK))(_q11)
