"""Rules, routing of notifications and follow-up: F4, F5, F7-F10, J5, J6,
P6-P9, Q7-Q9, Q11.

Rule and template tables are small (a handful of rows per sector or rule)
that Spark broadcasts by their size; the record tables are never shuffled
for them.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import content_key, e164, simple_tokens, ts_lit
from .common import latest, number_rows, lookup

# F4 -----------------------------------------------------------------------
def flag_business_hours(calls: DataFrame, tenants: DataFrame, hours: DataFrame,
                        open_days: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> DataFrame:
    """local start time of each call in its tenant's time zone and whether
    it falls inside the tenant's opening hours (``open_hour`` <= hour <
    ``close_hour`` on ``open_days``, Monday = 0). Tenants without hours: NULL."""
    t = lookup(tenants.select("tenant_id", "timezone"))
    h = lookup(hours.select("tenant_id", "open_hour", "close_hour"))
    j = calls.select("call_id", "tenant_id", "started_at").join(t, "tenant_id", "left").join(h, "tenant_id", "left")
    local = F.convert_timezone(F.lit("UTC"), F.col("timezone"), F.col("started_at"))
    hr = F.hour(local)
    inside = F.weekday(local).isin(*open_days) & (hr >= F.col("open_hour")) & (hr < F.col("close_hour"))
    return j.select("call_id", "tenant_id", local.alias("local_start"), inside.alias("in_hours"))


# F5 -----------------------------------------------------------------------
# Keyword rules (rule, words, priority; 1 is most urgent).
ESCALATION_RULES = (
    ("emergency", ("emergency", "urgent", "ambulance", "bleeding", "pain"), 1),
    ("human_request", ("human", "person", "operator", "someone", "manager"), 2),
    ("abuse", ("idiot", "stupid", "hate", "shut"), 3),
)


def escalation_rules(spark: SparkSession, rules=ESCALATION_RULES) -> DataFrame:
    return spark.createDataFrame([(w, r, p) for r, ws, p in rules for w in ws], "term string, rule string, priority int")


def flag_escalations(turns: DataFrame, rules: DataFrame) -> DataFrame:
    """caller turns with a rule word (token match after X8 tokenising):
    the rules hit and the most urgent priority. Tokens are joined to the
    broadcast rule table where they lie."""
    tok = turns.filter(F.col("role") == "caller").select(
        "call_id", "turn_no", "tenant_id", F.explode(F.array_distinct(simple_tokens("content"))).alias("term"))
    hit = tok.join(lookup(rules), "term", "inner")
    return hit.groupBy("call_id", "turn_no", "tenant_id").agg(
        F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"),
        F.min("priority").alias("priority"))


# F7 -----------------------------------------------------------------------
def plan_notifications(bookings: DataFrame, channels: DataFrame) -> DataFrame:
    """one row per (booking, channel): ``send`` when the tenant has the
    channel enabled and the booking has the contact, else the reason."""
    ch = lookup(channels.select("tenant_id", "email_enabled", "whatsapp_enabled"))
    b = bookings.join(ch, "tenant_id", "left")
    b = b.select("*", F.explode(F.array(F.lit("whatsapp"), F.lit("email"))).alias("channel"))
    contact = F.when(F.col("channel") == "whatsapp", F.col("customer_phone")).otherwise(F.col("customer_email"))
    enabled = F.when(F.col("channel") == "whatsapp", F.col("whatsapp_enabled")).otherwise(F.col("email_enabled"))
    reason = (F.when(~F.coalesce(enabled, F.lit(False)), F.lit("channel disabled"))
               .when(contact.isNull() | (contact == ""), F.lit("no contact")))
    return b.withColumn("recipient", contact).withColumn("reason", reason) \
        .withColumn("send", F.col("reason").isNull()).drop("email_enabled", "whatsapp_enabled")


# F8 -----------------------------------------------------------------------
def latest_consent(consents: DataFrame) -> DataFrame:
    """Newest consent row per recipient."""
    return latest(consents, "recipient", "ts", tie=["seq"])


def suppress(targets: DataFrame, consents: DataFrame) -> DataFrame:
    """F8: keeps targets whose newest consent is an opt-in; recipients without
    consent or whose newest word is STOP are removed."""
    ok = latest_consent(consents).filter(F.col("consent") == "opt_in").select("recipient")
    return targets.join(ok, "recipient", "left_semi")


# F9 -----------------------------------------------------------------------
# Tools each sector template offers.
SECTOR_TOOLS = {
    "hospital": ("search_knowledge", "check_availability", "book_appointment", "transfer_or_unknown"),
    "school": ("search_knowledge", "capture_lead", "transfer_or_unknown"),
    "restaurant": ("search_knowledge", "check_availability", "make_reservation", "transfer_or_unknown"),
    "generic": ("search_knowledge", "capture_lead", "transfer_or_unknown"),
}


def sector_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, list(t)) for s, t in SECTOR_TOOLS.items()], "sector string, tools array<string>")


def allowed_tools(tenants: DataFrame, enabled: DataFrame, tools: DataFrame) -> DataFrame:
    """per tenant, the sector's tools intersected with the tenant's enabled
    list (all of the sector's tools when the tenant has no list)."""
    t = tenants.select("tenant_id", "sector").join(lookup(tools), "sector", "left")
    t = t.join(lookup(enabled.select("tenant_id", "enabled_tools")), "tenant_id", "left")
    allowed = F.when(F.col("enabled_tools").isNull(), F.col("tools")) \
        .otherwise(F.array_intersect("tools", "enabled_tools"))
    return t.select("tenant_id", "sector", F.array_sort(allowed).alias("allowed_tools"))


def flag_tool_calls(calls: DataFrame, allowed: DataFrame) -> DataFrame:
    """tool calls (``tenant_id``, ``route``) to a tool the tenant does not
    allow."""
    a = lookup(allowed.select("tenant_id", "allowed_tools"))
    j = calls.join(a, "tenant_id", "left")
    return j.withColumn("allowed", F.coalesce(F.array_contains("allowed_tools", F.col("route")), F.lit(False))) \
        .drop("allowed_tools")


# F10 ----------------------------------------------------------------------
def check_phrases(turns: DataFrame, forbidden: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """agent turns that use a forbidden phrase (case-insensitive
    substring), and calls whose agent never said a required phrase."""
    agent = turns.filter(F.col("role") == "agent").withColumn("_l", F.lower("content"))
    bad = F.filter(F.array(*[F.when(F.col("_l").contains(p.lower()), F.lit(p)) for p in forbidden]),
                   lambda x: x.isNotNull())
    said_bad = agent.select("call_id", "turn_no", "tenant_id", bad.alias("phrases")).filter(F.size("phrases") > 0)
    per_call = agent.groupBy("call_id", "tenant_id").agg(
        *[F.max(F.col("_l").contains(p.lower()).cast("int")).alias(f"_r{i}") for i, p in enumerate(required)])
    missing = F.filter(F.array(*[F.when(F.col(f"_r{i}") == 0, F.lit(p)) for i, p in enumerate(required)]),
                       lambda x: x.isNotNull())
    miss = per_call.select("call_id", "tenant_id", missing.alias("missing")).filter(F.size("missing") > 0)
    return said_bad, miss


# J5 -----------------------------------------------------------------------
def calls_with_outcome(calls: DataFrame, bookings: DataFrame, leads: DataFrame) -> DataFrame:
    """Calls that produced a booking or a lead (semi join on the union of
    their call ids)."""
    ids = bookings.select("call_id").unionByName(leads.select("call_id")).filter(F.col("call_id").isNotNull())
    return calls.join(ids, "call_id", "left_semi")


# J6 -----------------------------------------------------------------------
def resolve_number(calls: DataFrame, numbers: DataFrame, configs: DataFrame) -> DataFrame:
    """Called number to its tenant and current agent config; calls to an
    unknown number are kept with NULLs."""
    n = lookup(numbers.select(F.col("e164").alias("to_number"), F.col("tenant_id").alias("number_tenant"),
                             "number_id"))
    cur = latest(configs.select("tenant_id", "config_id", "updated_at"), "tenant_id", "updated_at", tie=["config_id"])
    c = lookup(cur.select(F.col("tenant_id").alias("number_tenant"), F.col("config_id").alias("agent_config_id")))
    return calls.select("call_id", "tenant_id", "to_number").join(n, "to_number", "left").join(c, "number_tenant", "left")


# P6 -----------------------------------------------------------------------
def fill(template: Column, variables: dict[str, Column | str], opening: str = "{{", closing: str = "}}") -> Column:
    """A template with its placeholders filled in one pass: the text is split
    at the placeholders and each piece is looked up once, so a value that
    holds a placeholder is not expanded again. Unknown placeholders stay,
    NULL values become ''."""
    names = "|".join(re.escape(k) for k in variables)
    mark = "\x00"
    spot = re.escape(opening) + "(" + names + ")" + re.escape(closing)
    pieces = F.split(F.regexp_replace(F.replace(template, F.lit(mark), F.lit("")), spot, f"{mark}$1{mark}"), mark)
    values = F.create_map(*[x for k, v in variables.items()
                            for x in (F.lit(k), F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")))])
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, values[p]).otherwise(p)), "")


def render_template(df: DataFrame, template_col: str, variables: dict[str, Column | str], out: str = "text") -> DataFrame:
    """Replaces ``{{name}}`` placeholders of a per-row template with the
    row's values (NULL values become ''; see ``fill``)."""
    return df.withColumn(out, fill(F.col(template_col), variables))


# P7 -----------------------------------------------------------------------
# Default confirmation texts by sector (the same for e-mail and WhatsApp);
# a caller passes its own table to ``render_confirmations``.
CONFIRMATIONS = {
    "hospital": "Your visit is set: {doctor}, {dept}, {date} at {time} (no. {id}). To move it, answer RESCHEDULE.",
    "school": "We look forward to seeing you on {date} at {time}. Read more before you come: {link}",
    "restaurant": "{restaurant} keeps a table for {party} on {date}, {time}. Code {id}; answer CANCEL to free it.",
    "generic": "Hello {name}, your message ({summary}) has reached us and we will call {phone}.",
}


def confirmation_templates(spark: SparkSession) -> DataFrame:
    rows = [(s, ch, txt) for s, txt in CONFIRMATIONS.items() for ch in ("email", "whatsapp")]
    return spark.createDataFrame(rows, "sector string, channel string, template string")


def render_confirmations(sends: DataFrame, tenants: DataFrame, templates: DataFrame, department: Column | str | None = None,
                         link: Column | str | None = None) -> DataFrame:
    """Message text per planned send: the template of the tenant's sector
    and channel (generic when the sector has none), variables filled in one
    pass. ``department`` and ``link`` are columns of the joined rows or
    expressions; left out they are empty."""
    given = lambda c: F.lit("") if c is None else F.col(c) if isinstance(c, str) else c
    t = lookup(tenants.select("tenant_id", "sector", F.col("name").alias("tenant_name")))
    tp = lookup(templates)
    g = lookup(templates.filter(F.col("sector") == "generic").select("channel", F.col("template").alias("_generic")))
    j = sends.join(t, "tenant_id", "left").join(tp, ["sector", "channel"], "left").join(g, "channel", "left")
    j = j.withColumn("template", F.coalesce("template", "_generic"))
    var = {
        "doctor": F.col("resource_id"), "date": F.date_format("scheduled_for", "yyyy-MM-dd"),
        "time": F.date_format("scheduled_for", "HH:mm"), "dept": given(department), "id": F.col("booking_key"),
        "link": given(link), "party": F.col("party_size"),
        "restaurant": F.col("tenant_name"), "name": F.col("customer_name"), "summary": F.col("type"),
        "phone": F.col("customer_phone"),
    }
    return j.select("booking_key", "tenant_id", "channel", "recipient", fill(F.col("template"), var, "{", "}").alias("text"))


# P8 -----------------------------------------------------------------------
def assemble_prompts(questions: DataFrame, context: DataFrame, history: DataFrame, prompts: DataFrame,
                     tenants: DataFrame, templates: DataFrame) -> DataFrame:
    """Grounded prompt per caller turn: the tenant's system prompt, its
    sector's safety rules and tone, the numbered context, the recent history
    and the utterance, one block each."""
    sector = tenants.select("tenant_id", "sector").join(templates.select("sector", "safety", "tone"), "sector", "left")
    j = questions.join(context.select("query_id", "context"), "query_id", "left") \
        .join(history.select("query_id", "history"), "query_id", "left") \
        .join(lookup(prompts.select("tenant_id", "system_prompt")), "tenant_id", "left") \
        .join(lookup(sector.select("tenant_id", "safety", "tone")), "tenant_id", "left")
    text = F.concat_ws("\n\n",
                       F.concat(F.lit("SYSTEM: "), F.coalesce("system_prompt", F.lit(""))),
                       F.concat(F.lit("RULES: "), F.coalesce("safety", F.lit("")), F.lit(" Tone: "),
                                F.coalesce("tone", F.lit("")), F.lit(".")),
                       F.concat(F.lit("CONTEXT:\n"), F.coalesce("context", F.lit(""))),
                       F.concat(F.lit("HISTORY:\n"), F.coalesce("history", F.lit(""))),
                       F.concat(F.lit("CALLER: "), F.col("query_text")))
    return j.select("query_id", "tenant_id", text.alias("prompt"))


# P9 -----------------------------------------------------------------------
# What a new tenant's config starts with, by sector: system prompt,
# languages, safety rules, tone.
SECTOR_TEMPLATES = {
    "hospital": ("You answer for a hospital: visiting hours, departments and appointments.", "en,hi",
                 "Never give a diagnosis or a dose; pass emergencies on at once.", "calm"),
    "school": ("You answer for a school: admissions, fees and campus visits.", "en",
               "Give no data about pupils; promise no place.", "friendly"),
    "restaurant": ("You answer for a restaurant: menu, hours and table reservations.", "en",
                   "Name allergens only from the menu; take no card numbers.", "cheerful"),
    "generic": ("You answer questions about the business and take messages.", "en",
                "Say so when you do not know; pass complaints on.", "polite"),
}


def sector_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *row) for s, row in SECTOR_TEMPLATES.items()],
                                 "sector string, system_prompt string, languages string, safety string, tone string")


def seed_configs(tenants: DataFrame, templates: DataFrame, tools: DataFrame, configs: DataFrame) -> DataFrame:
    """Config rows for tenants that have none, from their sector's template
    and tools (generic when the sector has no template); ids are content
    keys."""
    new = tenants.select("tenant_id", "sector").join(configs.select("tenant_id"), "tenant_id", "left_anti")
    known = templates.select(F.col("sector").alias("_known")).distinct()
    new = new.join(known, F.col("sector") == F.col("_known"), "left") \
             .withColumn("_use", F.coalesce("_known", F.lit("generic")))
    full = templates.join(tools, "sector", "left").withColumnRenamed("sector", "_use")
    return new.join(full, "_use", "left").select(
        content_key("tenant_id").alias("config_id"), "tenant_id", F.coalesce("sector", F.lit("generic")).alias("template"),
        "system_prompt", "languages", F.col("safety").alias("safety_rules"), "tone", "tools")


# Q7 -----------------------------------------------------------------------
def retry_plan(notifs: DataFrame, as_of: dt.datetime, base_minutes: int = 1, cap_minutes: int = 60,
               max_attempts: int = 5) -> DataFrame:
    """Q7: failed sends: next attempt at created_at + min(cap, base * 2^attempts)
    minutes; ``due`` when that is not after ``as_of``; ``give_up`` once the
    attempts reach the maximum."""
    f = notifs.filter(F.col("status") == "failed")
    delay = F.least(F.lit(float(cap_minutes)), F.lit(float(base_minutes)) * F.pow(F.lit(2.0), F.col("attempts")))
    nxt = F.timestamp_add("SECOND", (delay * 60).cast("long"), F.col("created_at"))
    give_up = F.col("attempts") >= max_attempts
    return f.select("notification_id", "tenant_id", "channel", "attempts", nxt.alias("next_attempt_at"),
                    ((~give_up) & (nxt <= ts_lit(as_of))).alias("due"), give_up.alias("give_up"))


# Q8 -----------------------------------------------------------------------
def reminder_targets(bookings: DataFrame, consents: DataFrame, sent: DataFrame, as_of: dt.datetime,
                     hours: int = 24) -> DataFrame:
    """Q8: bookings in (as_of, as_of + hours] whose contact's newest consent is
    an opt-in and that were not reminded yet."""
    lo = ts_lit(as_of)
    hi = F.timestamp_add("HOUR", F.lit(hours), lo)
    b = bookings.filter((F.col("scheduled_for") > lo) & (F.col("scheduled_for") <= hi))
    b = b.withColumn("recipient", F.col("customer_phone"))
    b = suppress(b, consents)
    return b.join(sent.select("booking_key"), "booking_key", "left_anti")


# Q9 -----------------------------------------------------------------------
# Reply words and the booking status they lead to.
REPLY_ACTIONS = {"cancel": "cancelled", "reschedule": "reschedule_requested", "stop": None}


def apply_replies(bookings: DataFrame, replies: DataFrame) -> DataFrame:
    """Q9: the newest reply of each phone (normalised to E.164) decides:
    CANCEL cancels and RESCHEDULE marks the contact's bookings, STOP opts the
    contact out; other replies change nothing."""
    r = replies.select(e164("phone").alias("phone"), "ts", "seq", F.try_element_at(simple_tokens("text"), F.lit(1)).alias("word"))
    # Numbers that do not normalise fall into one NULL group, which joins
    # nothing; filtering them first would evaluate the normalisation twice.
    r = latest(r, "phone", "ts", tie=["seq"])
    m = F.create_map(*[x for k, v in REPLY_ACTIONS.items() if v for x in (F.lit(k), F.lit(v))])
    r = r.select("phone", "word", F.element_at(m, F.col("word")).alias("_new"), (F.col("word") == "stop").alias("opt_out"))
    # Bookings without a phone match nothing; in the join they would all meet in one task.
    known = bookings.filter(F.col("customer_phone").isNotNull()).join(r.withColumnRenamed("phone", "customer_phone"), "customer_phone", "left")
    j = known.unionByName(bookings.filter(F.col("customer_phone").isNull()), allowMissingColumns=True)
    return j.select(*[c for c in bookings.columns if c != "status"],
                    F.coalesce("_new", "status").alias("status"),
                    F.coalesce("opt_out", F.lit(False)).alias("opted_out"))


# Q11 ----------------------------------------------------------------------
def fill_waitlist(slots: DataFrame, requests: DataFrame) -> DataFrame:
    """Q11: the i-th waiting request of a (tenant, resource) gets the i-th free
    slot of it (both in time order); equi join on (tenant, resource, i). The
    numbering is two-level (per resource and day, then offsets per
    resource), so a resource with a third of all rows is not one task."""
    keys = ["tenant_id", "resource_id"]
    s = number_rows(slots, keys, [F.col("slot"), F.col("order_key"), F.col("line_no")],
                    F.date_trunc("day", "slot"))
    r = number_rows(requests, keys, [F.col("created_at"), F.col("booking_key")], F.date_trunc("day", "created_at"))
    return r.select("tenant_id", "resource_id", "i", "booking_key", "created_at") \
        .join(s.select("tenant_id", "resource_id", "i", "slot"), ["tenant_id", "resource_id", "i"], "inner")
