"""Operating reports: A2-A17 and the window operators W3-W6.

Every aggregate is a hash aggregate with a map-side partial step, so a
tenant holding a third of all rows is combined per partition before the
shuffle. Window operators partition by the natural entity (call, message,
tenant); where a window's group could be huge the docstring says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import normalise_text
from .common import latest, lookup, number_rows, top_k_per


# A2 -----------------------------------------------------------------------
def assemble_transcripts(turns: DataFrame) -> DataFrame:
    """A2: one text per call, ``role: content`` lines in turn order. The
    ordered list is bounded by the turns of one call."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    g = turns.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("turn_no", line.alias("line")))).alias("l"))
    return g.select("call_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"),
                    F.size("l").alias("n_turns"))


def transcript_parts(turns: DataFrame, size: int = 200) -> DataFrame:
    """A2 for calls of any length: the transcript in numbered parts of at most
    ``size`` turns, so no row gathers a whole long call. Turns are numbered
    in two levels (``number_rows``); the parts of a call in order, joined by
    a line end, are its transcript."""
    n = number_rows(turns.select("call_id", "turn_no", "role", "content"), "call_id", [F.col("turn_no")],
                    F.floor(F.col("turn_no") / 256), "place")
    line = F.struct("place", F.concat(F.col("role"), F.lit(": "), F.col("content")).alias("line"))
    g = n.groupBy("call_id", F.floor((F.col("place") - 1) / size).cast("long").alias("part")) \
        .agg(F.sort_array(F.collect_list(line)).alias("l"))
    return g.select("call_id", "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"),
                    F.size("l").alias("n_turns"))


# A3 -----------------------------------------------------------------------
def kpi_tiles(calls: DataFrame, rates: DataFrame, day=None) -> DataFrame:
    """A3: per tenant and day: calls, mean duration, resolution rate,
    escalations and telephony cost (minutes x the provider's rate).
    ``day`` restricts to one day (the dashboard tile)."""
    c = calls.withColumn("day", F.to_date("started_at"))
    if day is not None:
        c = c.filter(F.col("day") == F.to_date(F.lit(str(day))))
    c = c.join(lookup(rates), "provider", "left")
    return c.groupBy("tenant_id", "day").agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.avg("duration_sec"), 2).alias("avg_duration_sec"),
        F.round(F.count_if(F.col("outcome") == "resolved") / F.count(F.lit(1)), 4).alias("resolution_rate"),
        F.count_if("escalated").alias("escalations"),
        # 6 places: removes summation-order noise; the rates keep 7th+
        # digits off an exact half, so rounding is the same everywhere
        F.round(F.sum(F.col("duration_sec") * F.col("rate_per_min") / 60.0), 6).alias("cost"))


# A4 -----------------------------------------------------------------------
def call_volume(calls: DataFrame, unit: str = "month") -> DataFrame:
    """A4: calls per tenant per ``unit`` (hour, day, week, month), empty
    buckets included: a per-tenant spine from its first to its last bucket is
    generated with ``sequence`` (bounded by the time range, not the data) and
    left-joined to the counts."""
    b = calls.select("tenant_id", F.date_trunc(unit, "started_at").cast("timestamp_ntz").alias("bucket"))
    counts = b.groupBy("tenant_id", "bucket").agg(F.count(F.lit(1)).alias("calls"))
    rng = counts.groupBy("tenant_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    spine = rng.select("tenant_id", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {unit.upper()}"))).alias("bucket"))
    return spine.join(counts, ["tenant_id", "bucket"], "left").select(
        "tenant_id", "bucket", F.coalesce("calls", F.lit(0)).alias("calls"))


# A5 -----------------------------------------------------------------------
def peak_hours(calls: DataFrame) -> DataFrame:
    """A5: calls by (tenant, weekday Monday=0, hour), with ``is_peak`` on the
    busiest slot of each tenant (ties: earliest weekday, then hour)."""
    g = calls.groupBy("tenant_id", F.weekday("started_at").alias("weekday"), F.hour("started_at").alias("hour")) \
        .agg(F.count(F.lit(1)).alias("calls"))
    peak = top_k_per(g, "tenant_id", [F.col("calls").desc(), F.col("weekday"), F.col("hour")], 1) \
        .select("tenant_id", "weekday", "hour", F.lit(True).alias("is_peak"))
    return g.join(peak, ["tenant_id", "weekday", "hour"], "left").withColumn(
        "is_peak", F.coalesce("is_peak", F.lit(False)))


# A6 -----------------------------------------------------------------------
def intent_breakdown(calls: DataFrame) -> DataFrame:
    """Calls and share per (tenant, intent). The window runs over the
    already-aggregated rows (a handful per tenant)."""
    g = calls.groupBy("tenant_id", "intent").agg(F.count(F.lit(1)).alias("calls"))
    tot = F.sum("calls").over(Window.partitionBy("tenant_id"))
    return g.withColumn("share", F.round(F.col("calls") / tot, 4))


# A7 -----------------------------------------------------------------------
def resolution_rates(calls: DataFrame, tenants: DataFrame) -> DataFrame:
    """Resolution and escalation rates per tenant, per sector and overall
    (ROLLUP); ``level`` is the grouping id (0 tenant, 1 sector, 3 total)."""
    c = calls.join(lookup(tenants.select("tenant_id", "sector")), "tenant_id", "left")
    return c.rollup("sector", "tenant_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.count_if(F.col("outcome") == "resolved") / F.count(F.lit(1)), 4).alias("resolution_rate"),
        F.round(F.count_if("escalated") / F.count(F.lit(1)), 4).alias("escalation_rate"),
        F.grouping_id().alias("level"))


# A8 / A9 / A16 ----------------------------------------------------------------
def knowledge_gap(questions: DataFrame, hits: DataFrame, calls: DataFrame, threshold: float) -> DataFrame:
    """Per tenant, caller questions whose retrieval found no hit at or
    above ``threshold`` or whose call was escalated; count and share.
    ``hits`` are search results keyed by ``query_id`` (the question id)."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    esc = calls.select("call_id", "escalated")
    q = questions.join(best, "query_id", "left").join(esc, "call_id", "left")
    gap = (F.coalesce(F.col("best") < F.lit(threshold), F.lit(True))) | F.coalesce(F.col("escalated"), F.lit(False))
    return q.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(gap).alias("gaps"),
        F.round(F.count_if(gap) / F.count(F.lit(1)), 4).alias("gap_rate"))


def gap_questions(questions: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    q = questions.join(best, "query_id", "left")
    return q.filter(F.coalesce(F.col("best") < F.lit(threshold), F.lit(True)))


def gap_topics(gaps: DataFrame, k: int = 10, text_col: str = "query_text") -> DataFrame:
    """The k most frequent unanswered questions per tenant after
    normalising (lower case, letters and digits only); ties by text."""
    g = gaps.groupBy("tenant_id", normalise_text(text_col).alias("topic")).agg(F.count(F.lit(1)).alias("asked"))
    return top_k_per(g, "tenant_id", [F.col("asked").desc(), F.col("topic")], k, rank_col="rank")


def citation_usage(citations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How often each cited item was cited and in how many calls.
    ``citations`` has one row per (call_id, turn, cited id); a per-turn array
    is exploded first with ``explode``."""
    return citations.groupBy("tenant_id", id_col).agg(
        F.count(F.lit(1)).alias("citations"), F.countDistinct("call_id").alias("calls"))


# A10 ----------------------------------------------------------------------
def cost_per_call(calls: DataFrame, turns: DataFrame, notifs: DataFrame, rates: DataFrame,
                  token_rate: float, message_rate: float) -> DataFrame:
    """A10: per call: telephony minutes x provider rate + model tokens x
    ``token_rate`` + messages x ``message_rate``. Turns and notifications are
    reduced to one row per call before the joins."""
    t = turns.groupBy("call_id").agg(F.sum("tokens").alias("tokens"))
    n = notifs.groupBy("call_id").agg(F.count(F.lit(1)).alias("messages"))
    c = calls.select("call_id", "tenant_id", "provider", "duration_sec").join(lookup(rates), "provider", "left")
    j = c.join(t, "call_id", "left").join(n, "call_id", "left")
    minutes = F.coalesce(F.col("duration_sec"), F.lit(0)) / 60.0
    tok = F.coalesce("tokens", F.lit(0))
    msg = F.coalesce("messages", F.lit(0))
    cost = minutes * F.coalesce("rate_per_min", F.lit(0.0)) + tok * F.lit(token_rate) + msg * F.lit(message_rate)
    return j.select("call_id", "tenant_id", minutes.alias("minutes"), tok.alias("tokens"),
                    msg.alias("messages"), cost.alias("cost"))


# A11 ----------------------------------------------------------------------
def usage(calls: DataFrame, turns: DataFrame, notifs: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per tenant and month: call minutes, model tokens, messages; flag
    when minutes exceed the tenant's monthly quota."""
    m = lambda c: F.date_format(c, "yyyy-MM")
    a = calls.groupBy("tenant_id", m("started_at").alias("month")).agg(
        F.round(F.sum(F.coalesce("duration_sec", F.lit(0))) / 60.0, 4).alias("minutes"))
    b = turns.groupBy("tenant_id", m("created_at").alias("month")).agg(F.sum("tokens").alias("tokens"))
    c = notifs.groupBy("tenant_id", m("created_at").alias("month")).agg(F.count(F.lit(1)).alias("messages"))
    j = a.join(b, ["tenant_id", "month"], "full").join(c, ["tenant_id", "month"], "full")
    j = j.join(lookup(quotas.select("tenant_id", "quota_minutes")), "tenant_id", "left")
    return j.select("tenant_id", "month", F.coalesce("minutes", F.lit(0.0)).alias("minutes"),
                    F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("messages", F.lit(0)).alias("messages"),
                    "quota_minutes",
                    F.coalesce(F.col("minutes") > F.col("quota_minutes"), F.lit(False)).alias("over_quota"))


# W4 / A12 -------------------------------------------------------------------
# Status order of a message (failed only when nothing better).
STATUS_RANK = {"failed": 0, "queued": 1, "sent": 2, "delivered": 3, "read": 4}


def status_rank(col: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))]), col)


def notification_state(events: DataFrame, key: list[str]) -> DataFrame:
    """Furthest status per message (``key``) from its status callbacks,
    when it was reached, and the number of callbacks that went back below the
    furthest status already seen (out of order or illegal)."""
    e = events.withColumn("rank", status_rank(F.col("status")))
    # The highest rank seen before each callback, in two levels (per day of
    # the message, then a running maximum over its days), so a message with
    # a third of all callbacks is not one task.
    e = e.withColumn("_day", F.date_trunc("day", "ts"))
    w = Window.partitionBy(*key, "_day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_in_day", F.max("rank").over(w))
    days = e.groupBy(*key, "_day").agg(F.max("rank").alias("_day_max"))
    before = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_prior", F.max("_day_max").over(before)).drop("_day_max")
    e = e.join(days, [*key, "_day"], "inner")
    prev = F.greatest(F.col("_in_day"), F.col("_prior"))          # greatest skips NULLs
    e = e.withColumn("back", F.coalesce(prev > F.col("rank"), F.lit(False))).drop("_day", "_in_day", "_prior")
    return e.groupBy(*key).agg(
        F.max_by("status", F.struct("rank", "ts", "event_id")).alias("status"),
        F.max_by("ts", F.struct("rank", "ts", "event_id")).alias("status_at"),
        F.count_if("back").alias("steps_back"),
        F.count(F.lit(1)).alias("callbacks"))


def delivery_rates(state: DataFrame) -> DataFrame:
    """Per tenant and channel, the share of messages whose furthest
    status reached sent, delivered, read, or that failed."""
    r = status_rank(F.col("status"))
    n = F.count(F.lit(1))
    return state.groupBy("tenant_id", "channel").agg(
        n.alias("messages"),
        F.round(F.count_if(r >= 2) / n, 4).alias("sent_rate"),
        F.round(F.count_if(r >= 3) / n, 4).alias("delivered_rate"),
        F.round(F.count_if(r >= 4) / n, 4).alias("read_rate"),
        F.round(F.count_if(r == 0) / n, 4).alias("failed_rate"))


# A13 ----------------------------------------------------------------------
def latency_report(turns: DataFrame, budget_ms: int = 1500) -> DataFrame:
    """Exact p50 / p95 turn latency (the smallest latency that at least
    that share of the turns does not exceed) and the share over budget per
    tenant. Turns are counted per (tenant, latency) with a map-side step; a
    running sum over a tenant's distinct latencies gives their ranks. No
    group's turns are held together."""
    per = turns.groupBy("tenant_id", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("tenant_id").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    known = per.filter(F.col("latency_ms").isNotNull()).withColumn("upto", F.sum("n").over(order))
    total = per.groupBy("tenant_id").agg(
        F.sum("n").alias("turns"), F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("n"))).alias("_known"),
        F.sum(F.when(F.col("latency_ms") > budget_ms, F.col("n")).otherwise(0)).alias("_over"))

    def value(percent: int):
        return F.min(F.when(F.col("upto") * 100 >= F.col("_known") * percent, F.col("latency_ms")))

    found = known.join(total, "tenant_id").groupBy("tenant_id").agg(value(50).alias("p50_ms"), value(95).alias("p95_ms"))
    return total.join(found, "tenant_id", "left").select(
        "tenant_id", "turns", "p50_ms", "p95_ms", F.round(F.col("_over") / F.col("turns"), 4).alias("over_budget"))


# A14 ----------------------------------------------------------------------
def run_monitor(runs: DataFrame) -> DataFrame:
    """Workflow runs per (workflow, tenant, status) rolled up to
    (workflow, tenant): runs, errors, error rate, mean duration."""
    return runs.groupBy("workflow", "tenant_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.count_if(F.col("status") == "error") / F.count(F.lit(1)), 4).alias("error_rate"),
        F.round(F.avg("duration_s"), 4).alias("avg_duration_s"))


# A15 ----------------------------------------------------------------------
DOC_STATUSES = ("pending", "indexing", "indexed", "failed")


def index_status(documents: DataFrame) -> DataFrame:
    """Documents per tenant and status as columns (pivot with the value
    list given, so no extra pass is needed to find the values)."""
    p = documents.groupBy("tenant_id").pivot("status", list(DOC_STATUSES)).agg(F.count(F.lit(1)))
    return p.select("tenant_id", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in DOC_STATUSES])


# A17 ----------------------------------------------------------------------
def access_report(audit: DataFrame, window: str = "1 day", z: float = 2.0) -> DataFrame:
    """Accesses per user and tumbling window, with the user's own mean
    and standard deviation over their windows; ``spike`` when a window is
    more than ``z`` deviations above the mean. The audit is read once; a user's
    windows (one row each) meet in one task."""
    known = audit.filter(F.col("user_id").isNotNull())
    g = known.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("accesses"))
    own = Window.partitionBy("user_id")
    j = g.select("user_id", F.col("w.start").alias("window_start"), "accesses",
                 F.avg("accesses").over(own).alias("mean"), F.stddev("accesses").over(own).alias("sd"))
    return j.select("user_id", "window_start", "accesses", F.round("mean", 4).alias("mean"),
                    F.round("sd", 4).alias("sd"),
                    F.coalesce(F.col("accesses") > F.col("mean") + F.lit(z) * F.col("sd"), F.lit(False)).alias("spike"))


def record_access(audit: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Who opened which record: per user, action and record the number
    of accesses, the first and the last time. A grouped count with a
    map-side step."""
    return audit.filter(F.col("action").isin(list(actions))).groupBy("user_id", "action", "record_id").agg(
        F.count(F.lit(1)).alias("accesses"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


# W3 -----------------------------------------------------------------------
def recent_history(turns: DataFrame, n: int = 4) -> DataFrame:
    """For each turn the previous ``n`` turns of its call, oldest first.

    Turn numbers may have gaps, so turns are first numbered within their call
    in two levels (``number_rows``: inside blocks of 256 turn numbers, then
    offsets). The history is an equi join of (call, place - j) for j = 1..n:
    the key includes the place, so even a call with a third of all turns
    spreads over all tasks, and each turn collects at most ``n`` lines."""
    placed = number_rows(turns.select("call_id", "turn_no", "role", "content"), "call_id", [F.col("turn_no")],
                         F.floor(F.col("turn_no") / 256), "place")
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    prev = placed.select("call_id", F.col("place").alias("prev_no"), line.alias("line"))
    want = placed.select("call_id", "turn_no", "place", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j")) \
        .withColumn("prev_no", F.col("place") - F.col("j"))
    hist = want.join(prev, ["call_id", "prev_no"], "inner").groupBy("call_id", "turn_no").agg(
        F.sort_array(F.collect_list(F.struct("prev_no", "line"))).alias("h"))
    out = turns.join(hist, ["call_id", "turn_no"], "left")
    return out.withColumn("history", F.coalesce(F.transform("h", lambda x: x["line"]), F.array().cast("array<string>"))) \
        .drop("h")


# W5 -----------------------------------------------------------------------
def double_bookings(bookings: DataFrame) -> DataFrame:
    """(tenant, resource, slot) keys booked more than once, with the
    count (an aggregate, so a hot key is combined map-side)."""
    g = bookings.groupBy("tenant_id", "resource_id", "scheduled_for").agg(F.count(F.lit(1)).alias("bookings"))
    return g.filter(F.col("bookings") > 1)


def bookings_outside_slots(bookings: DataFrame, avail: DataFrame) -> DataFrame:
    """Bookings whose (tenant, resource, time) is not a free slot of
    ``avail`` (a caller passes F3's slots, or all slots that exist)."""
    s = avail.select("tenant_id", "resource_id", F.col("slot").alias("scheduled_for")).distinct()
    return bookings.join(s, ["tenant_id", "resource_id", "scheduled_for"], "left_anti")


# W6 -----------------------------------------------------------------------
def concurrency(calls: DataFrame, caps: DataFrame, bucket: str = "hour") -> DataFrame:
    """Peak number of simultaneous calls per tenant (+1 at start, -1 at
    end, ends first at equal times; open calls stay active), against the
    tenant's cap.

    A two-level prefix maximum, so no task sorts a whole tenant: events are
    reduced to one net change per (tenant, instant); running sums are taken
    inside each (tenant, ``bucket``) only, giving the bucket's net change and
    its highest running value; a running sum over the (few) buckets of a
    tenant gives each bucket's starting level; the peak is the largest
    starting level + bucket maximum."""
    starts = calls.select("tenant_id", F.col("started_at").alias("t"), F.lit(1).alias("d"))
    ends = calls.filter(F.col("ended_at").isNotNull()).select("tenant_id", F.col("ended_at").alias("t"), F.lit(-1).alias("d"))
    ev = starts.unionByName(ends).groupBy("tenant_id", "t", "d").agg(F.sum("d").alias("delta")) \
        .withColumn("bucket", F.date_trunc(bucket, "t"))
    w = Window.partitionBy("tenant_id", "bucket").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    per = ev.withColumn("run", F.sum("delta").over(w)).groupBy("tenant_id", "bucket").agg(
        F.sum("delta").alias("net"), F.max("run").alias("top"))
    wb = Window.partitionBy("tenant_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start_level", F.coalesce(F.sum("net").over(wb), F.lit(0)))
    peak = per.groupBy("tenant_id").agg(F.max(F.col("start_level") + F.col("top")).alias("peak"))
    j = peak.join(lookup(caps.select("tenant_id", "max_concurrent")), "tenant_id", "left")
    return j.select("tenant_id", "peak", "max_concurrent",
                    F.coalesce(F.col("peak") > F.col("max_concurrent"), F.lit(False)).alias("over_cap"))


def current_caps(configs: DataFrame) -> DataFrame:
    return latest(configs.select("tenant_id", "updated_at", "config_id", "max_concurrent"), "tenant_id",
                  "updated_at", tie=["config_id"]).select("tenant_id", "max_concurrent")
