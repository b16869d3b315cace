"""Dashboard reads: A1, J1-J4, T1-T4, U1, F1, F3, F6.

Every operator answers for all tenants at once; the reference's one-tenant
request is the same call followed by a tenant filter (F1), which Catalyst
pushes into the Parquet scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ts_lit
from .common import lookup, number_rows, top_k_per


# F1 -----------------------------------------------------------------------
def scope(df: DataFrame, tenants, tenant_col: str = "tenant_id") -> DataFrame:
    """Rows of the allowed tenants only. ``tenants`` is a list of ids or a
    DataFrame with a ``tenant_id`` column (semi join)."""
    if isinstance(tenants, DataFrame):
        allowed = tenants.select(F.col("tenant_id").alias(tenant_col)).distinct()
        return df.join(lookup(allowed), tenant_col, "left_semi")
    return df.filter(F.col(tenant_col).isin(list(tenants)))


# A1 / J3 ------------------------------------------------------------------
def record_counts(tenants: DataFrame, bookings: DataFrame, leads: DataFrame) -> DataFrame:
    """Booking and lead counts per tenant, 0 when none."""
    b = bookings.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("bookings"))
    l = leads.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("leads"))
    return (tenants.select("tenant_id")
            .join(b, "tenant_id", "left").join(l, "tenant_id", "left")
            .select("tenant_id",
                    F.coalesce("bookings", F.lit(0)).alias("bookings"),
                    F.coalesce("leads", F.lit(0)).alias("leads")))


def call_stats(tenants: DataFrame, calls: DataFrame, bookings: DataFrame, leads: DataFrame) -> DataFrame:
    """A1: total, escalated, completed, rounded mean duration (half away from
    zero, NULL durations ignored, 0 when no calls), bookings, leads; one row per
    tenant, tenants without calls included.

    The three child tables are reduced to one row per tenant (partial
    aggregation before the shuffle), then joined to the tenant list."""
    c = calls.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(F.col("escalated")).alias("escalated"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.avg("duration_sec").alias("_avg"))
    out = (tenants.select("tenant_id").join(c, "tenant_id", "left")
           .join(record_counts(tenants, bookings, leads), "tenant_id", "left"))
    return out.select(
        "tenant_id",
        F.coalesce("total_calls", F.lit(0)).alias("total_calls"),
        F.coalesce("escalated", F.lit(0)).alias("escalated"),
        F.coalesce("completed", F.lit(0)).alias("completed"),
        F.coalesce(F.round("_avg"), F.lit(0)).cast("int").alias("avg_duration_sec"),
        "bookings", "leads")


# J1 -----------------------------------------------------------------------
def notifications_with_caller(notifs: DataFrame, calls: DataFrame) -> DataFrame:
    """Every notification with its call's caller number; notifications
    whose call is gone are kept with a NULL number."""
    c = calls.select(F.col("call_id"), F.col("from_number"))
    return notifs.join(c, "call_id", "left")


# J2 -----------------------------------------------------------------------
def call_detail(calls: DataFrame, turns: DataFrame, bookings: DataFrame, notifs: DataFrame,
                tenant_scoped: bool = True) -> DataFrame:
    """Each call with arrays of its turns (time order), bookings and
    notifications; empty arrays when none.

    ``tenant_scoped`` (default) attaches only children of the call's own
    tenant (key: tenant and call id); ``False`` keys on the call id alone, as
    the reference's detail route does (children of another tenant then show
    up; Q4 reports them). Children are grouped once per table (not one
    subquery per call) and the arrays are bounded by what one call produces."""
    key = ["tenant_id", "call_id"] if tenant_scoped else ["call_id"]

    def nest(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        cols = [c for c in df.columns if c not in key]
        # sort key first in the struct so sort_array gives the wanted order
        st = F.struct(*[F.col(o).alias(f"_k{i}") for i, o in enumerate(order)], *[F.col(c) for c in cols])
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(st)).alias(name))

    t = nest(turns, "turns", ["created_at", "turn_no"])
    b = nest(bookings, "bookings", ["scheduled_for", "line_no", "part_id"])
    n = nest(notifs, "notifications", ["created_at", "notification_id"])
    out = calls.join(t, key, "left").join(b, key, "left").join(n, key, "left")
    for name in ("turns", "bookings", "notifications"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.array()))
    return out


DETAIL_PART = 500        # children in one row of the detail in parts


def call_detail_parts(calls: DataFrame, turns: DataFrame, bookings: DataFrame, notifs: DataFrame,
                      tenant_scoped: bool = True, size: int = DETAIL_PART) -> DataFrame:
    """J2 for calls with any number of children: (call_id, tenant_id, child, part_no, n, items), at most ``size``
    children of one table in a row, each as JSON, in the order of ``call_detail``. Part numbers run 0, 1, ..
    per call and table; a call without children of a table has no row for it.

    Children are numbered in two levels (inside an hour, then by the hours' sizes), so neither a
    call's children nor their array ever meet in one row or in one window of all of them."""
    key = ["tenant_id", "call_id"] if tenant_scoped else ["call_id"]

    def parts(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        cols = [c for c in df.columns if c not in key]
        rows = df.join(calls.select("call_id", "tenant_id") if tenant_scoped else calls.select("call_id"), key, "left_semi")
        rows = rows.select(*key, *[F.col(o).alias(f"_k{i}") for i, o in enumerate(order)],
                           F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("_item"))
        keys = [f"_k{i}" for i in range(len(order))]
        hour = F.coalesce(F.date_trunc("hour", "_k0"), F.lit("0001-01-01").cast("timestamp"))
        numbered = number_rows(rows, key, [F.col(k).asc_nulls_first() for k in (*keys, "_item")], hour, "_i")
        cut = numbered.groupBy(*key, F.floor((F.col("_i") - 1) / size).cast("long").alias("part_no")) \
            .agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_i", "_item"))), lambda x: x["_item"]).alias("items"))
        return cut.withColumn("child", F.lit(name))

    out = parts(turns, "turns", ["created_at", "turn_no"]) \
        .unionByName(parts(bookings, "bookings", ["scheduled_for", "line_no", "part_id"])) \
        .unionByName(parts(notifs, "notifications", ["created_at", "notification_id"]))
    if not tenant_scoped:
        out = out.join(calls.select("call_id", "tenant_id"), "call_id")
    return out.select("call_id", "tenant_id", "child", "part_no", "n", "items")


# J4 -----------------------------------------------------------------------
def unconfigured(tenants: DataFrame, configs: DataFrame) -> DataFrame:
    """Tenants that have no agent config row."""
    return tenants.join(configs.select("tenant_id"), "tenant_id", "left_anti")


# F3 -----------------------------------------------------------------------
def free_slots(avail: DataFrame, as_of: dt.datetime) -> DataFrame:
    """slots not booked and after ``as_of`` (pushed into the scan)."""
    return avail.filter((~F.col("is_booked")) & (F.col("slot") > ts_lit(as_of)))


# T1 -----------------------------------------------------------------------
def next_slots(avail: DataFrame, as_of: dt.datetime, k: int = 5) -> DataFrame:
    """Earliest k free slots per tenant (ties by resource and row)."""
    return top_k_per(free_slots(avail, as_of), "tenant_id",
                     [F.col("slot"), F.col("resource_id"), F.col("order_key"), F.col("line_no")], k)


# T2 -----------------------------------------------------------------------
CALL_LIST_COLS = ["call_id", "tenant_id", "from_number", "status", "duration_sec", "intent",
                  "outcome", "escalated", "started_at", "ended_at", "recording_url", "summary"]


def recent_calls(calls: DataFrame, k: int = 100) -> DataFrame:
    """Newest k calls per tenant (ties: higher id first)."""
    return top_k_per(calls.select(*CALL_LIST_COLS), "tenant_id",
                     [F.col("started_at").desc(), F.col("call_id").desc()], k)


# T3 -----------------------------------------------------------------------
def recent_notifications(notifs: DataFrame, calls: DataFrame, k: int = 100) -> DataFrame:
    """Newest k notifications per tenant with the caller number. The
    per-tenant limit runs before the join, so only k rows per tenant are
    joined."""
    n = notifs.select("notification_id", "tenant_id", "call_id", "channel", "recipient", "status",
                      "provider_message_id", "created_at")
    top = top_k_per(n, "tenant_id", [F.col("created_at").desc(), F.col("notification_id").desc()], k)
    return notifications_with_caller(top, calls)


# U1 / T4 ------------------------------------------------------------------
def union_activity(calls: DataFrame, bookings: DataFrame, leads: DataFrame, notifs: DataFrame) -> DataFrame:
    """One shape (tenant_id, kind, record_id, event_at, text) for all records."""
    c = calls.select("tenant_id", F.lit("call").alias("kind"), F.col("call_id").cast("string").alias("record_id"),
                     F.col("started_at").alias("event_at"),
                     F.concat_ws(" ", F.lit("call from"), "from_number", "status").alias("text"))
    b = bookings.select("tenant_id", F.lit("booking").alias("kind"),
                        F.concat_ws("-", "call_id", "line_no", "part_id").alias("record_id"),
                        F.col("created_at").alias("event_at"),
                        F.concat_ws(" ", "type", F.lit("for"), "customer_name").alias("text"))
    l = leads.select("tenant_id", F.lit("lead").alias("kind"), F.col("lead_id").cast("string").alias("record_id"),
                     F.lit(None).cast("timestamp_ntz").alias("event_at"),
                     F.concat_ws(" ", F.lit("lead"), "name").alias("text"))
    n = notifs.select("tenant_id", F.lit("notification").alias("kind"),
                      F.col("notification_id").cast("string").alias("record_id"),
                      F.col("created_at").alias("event_at"),
                      F.concat_ws(" ", "channel", "status", F.lit("to"), "recipient").alias("text"))
    return c.unionByName(b).unionByName(l).unionByName(n)


def activity_feed(calls, bookings, leads, notifs, k: int = 20) -> DataFrame:
    """T4: newest k activity items per tenant (undated items last)."""
    u = union_activity(calls, bookings, leads, notifs)
    return top_k_per(u, "tenant_id", [F.col("event_at").desc_nulls_last(), F.col("kind"), F.col("record_id")], k)


# F6 -----------------------------------------------------------------------
def filter_calls(calls: DataFrame, tenants: DataFrame, start=None, end=None, sector=None, status=None,
                 outcome=None, escalated=None, sentiment=None) -> DataFrame:
    """the dashboard's call-list filters, composed into one predicate.
    The sector filter is a semi join against the (small) tenant list."""
    out = calls
    if start is not None:
        out = out.filter(F.col("started_at") >= ts_lit(start))
    if end is not None:
        out = out.filter(F.col("started_at") < ts_lit(end))
    for name, v in (("status", status), ("outcome", outcome), ("sentiment", sentiment)):
        if v is not None:
            out = out.filter(F.col(name).isin(v if isinstance(v, (list, tuple)) else [v]))
    if escalated is not None:
        out = out.filter(F.col("escalated") == F.lit(bool(escalated)))
    if sector is not None:
        t = tenants.filter(F.col("sector") == sector).select("tenant_id")
        out = out.join(lookup(t), "tenant_id", "left_semi")
    return out
