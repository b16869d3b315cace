"""Live event streams (M1-M10) with Structured Streaming.

Every stateful operator takes its watermark delay / gap / time-out as a
required argument, so state is bounded. Aggregates run in update mode and
are written with ``foreachBatch`` as an append-only change log keyed by
the batch id (``upsert_log``); readers take the newest row per key
(``read_latest``). A replayed batch rewrites its own folder, so a retry
after a lost executor or driver restart gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import materialize

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


# M1 -----------------------------------------------------------------------
def read_events(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = EVENT_SCHEMA,
                max_files: int | None = None) -> DataFrame:
    """M1: typed event stream from landed files. JSON lines that do not fit
    the schema keep their text in ``_corrupt_record`` (``split_events`` writes
    them to a reject table); event time is a ``timestamp`` (needed by
    watermarks). ``max_files`` bounds a micro-batch where the caller wants
    that; by default a batch takes all files that are there."""
    r = spark.readStream
    if max_files is not None:
        r = r.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        s = schema if "_corrupt_record" in schema.names else \
            T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
        return r.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return r.schema(schema).format(fmt).load(path)


def good_events(stream: DataFrame) -> DataFrame:
    if "_corrupt_record" not in stream.columns:
        return stream
    return stream.filter(F.col("_corrupt_record").isNull() & F.col("ts").isNotNull()).drop("_corrupt_record")


def rejects(stream: DataFrame) -> DataFrame:
    return stream.filter(F.col("_corrupt_record").isNotNull() | F.col("ts").isNull())


# M2 -----------------------------------------------------------------------
def dedupe_events(stream: DataFrame, delay: str, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """M2: one row per event id; state for an id is kept until the watermark
    (event time minus ``delay``) passes it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_new(path: str, key: str = "event_id", ts: str = "ts"):
    """M2, foreachBatch writer: events whose id is not yet written, also when the id's state
    has expired long ago. A micro-batch is reduced to one row per id (the
    earliest) and compared with the written ids of the days it touches, by
    an anti join that reads the id column of those days' folders only; a repeated event
    has the time of the first. Rows go to ``path/day=<d>/batch=<id>``; a replay finds its own rows left out of the comparison and
    replaces them."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_r")) \
                .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
        batch = materialize(one.withColumn("day", F.to_date(ts)))
        days = [r["day"] for r in batch.select("day").distinct().collect()]         # as many as days in a micro-batch
        new = batch
        if folder_exists(spark, path):
            schema = T.StructType([*df.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
            touched = F.col("day").isin([d for d in days if d is not None])
            if None in days:
                touched = touched | F.col("day").isNull()
            known = spark.read.schema(schema).parquet(path).filter((F.col("batch") != batch_id) & touched).select(key)
            new = batch.join(known, key, "left_anti")
        # a replay may write fewer days than its first try
        drop_batch(spark, path, batch_id)
        new.withColumn("batch", F.lit(batch_id)).write.mode("append").partitionBy("day", "batch").parquet(path)
    return write


# M3 -----------------------------------------------------------------------
def live_kpis(stream: DataFrame, size: str, delay: str) -> DataFrame:
    """M3: calls started, turns, errors and events per tenant per tumbling
    window of ``size``. The stream has tenant_id, ts and kind."""
    s = stream.withWatermark("ts", delay)
    return s.groupBy(F.window("ts", size).alias("w"), "tenant_id").agg(
        F.count_if(F.col("kind") == "call.started").alias("calls"),
        F.count_if(F.col("kind") == "turn.transcript").alias("turns"),
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.count(F.lit(1)).alias("events"))


# M4 -----------------------------------------------------------------------
def rate_limits(stream: DataFrame, size: str, step: str, delay: str, quotas: DataFrame) -> DataFrame:
    """M4: requests per tenant per sliding window against the tenant's quota
    (a static table with one row per tenant; Spark picks the join). The
    stream has tenant_id and ts."""
    s = stream.withWatermark("ts", delay)
    g = s.groupBy(F.window("ts", size, step).alias("w"), "tenant_id").agg(F.count(F.lit(1)).alias("requests"))
    return g.join(quotas.select("tenant_id", "quota"), "tenant_id", "left") \
        .withColumn("over_quota", F.coalesce(F.col("requests") > F.col("quota"), F.lit(False)))


# M5 -----------------------------------------------------------------------
def sessions(stream: DataFrame, gap: str, delay: str, key: str = "user_id") -> DataFrame:
    """M5: events of a caller grouped into sessions by an inactivity ``gap``;
    events and duration per session."""
    s = stream.withWatermark("ts", delay)
    return s.groupBy(key, F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@contextmanager
def merged_before_shuffle(spark: SparkSession):
    """Session aggregations started inside merge the sessions of each task's own rows before the
    shuffle, so a user with a third of all events sends one row per session and task."""
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


# M6 -----------------------------------------------------------------------
_CALL_OUT = "call_id long, state string, turns long, last_us long"
_CALL_STATE = "state string, turns long, last_us long"


def call_states(stream: DataFrame, timeout: str, delay: str) -> DataFrame:
    """M6: state per call (ringing, active, escalated, ended) from its events;
    a call without events for ``timeout`` of event time ends as timed_out.
    The stream has call_id, event_id, ts and kind.

    ``applyInPandasWithState`` with an event-time time-out; the state per call
    is three values. An ended call keeps its state until the time-out, so
    events that come after the end change nothing. Times travel as
    microseconds since the epoch, so no time zone shifts them."""
    wait_us = int(pd.Timedelta(timeout).total_seconds() * 1_000_000)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            st, turns, last = state.get
            state.remove()
            if st != "ended":
                yield pd.DataFrame({"call_id": [key[0]], "state": ["timed_out"], "turns": [turns], "last_us": [last]})
            return
        st, turns, last = state.get if state.exists else ("ringing", 0, None)
        if st == "ended":
            return
        events = pd.concat(list(pdfs)).sort_values(["us", "event_id"])
        ends = (events["kind"] == "call.ended").to_numpy().nonzero()[0]
        if len(ends):
            events = events.iloc[:ends[0] + 1]
        turns += int((events["kind"] == "turn.transcript").sum())
        last = max(int(events["us"].max()), last if last is not None else int(events["us"].max()))
        if len(ends):
            st = "ended"
        elif st == "escalated" or (events["kind"] == "error").any():
            st = "escalated"
        elif events["kind"].isin(["turn.transcript", "tool.call"]).any():
            st = "active"
        state.update((st, turns, last))
        state.setTimeoutTimestamp(max((last + wait_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"call_id": [key[0]], "state": [st], "turns": [turns], "last_us": [last]})

    s = stream.withWatermark("ts", delay).select("call_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "kind")
    out = s.groupBy("call_id").applyInPandasWithState(step, _CALL_OUT, _CALL_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("call_id", "state", "turns", F.timestamp_micros("last_us").alias("last_ts"))


class CallStates:
    """M6 without Python per call: a foreachBatch writer that folds each micro-batch into a table of open calls.

    A batch becomes one row per call by map-side aggregates (turns, last
    event and whether it started, escalated or ended, all up to the call's first end), and is
    joined with the calls of the batch before. The state table of batch n lies under
    ``path/state/batch=<n>`` and is made from that of the batch before, so a replayed batch
    gives the same table; what changed goes to ``path/log/batch=<n>`` (``read_latest``).

    The rules are those of ``call_states``: an ended call keeps its state until the time-out and
    later events change nothing; events older than the watermark are left out; a call
    without events for ``timeout`` of event time ends as timed_out. The watermark, the latest event
    time of the batches so far less ``delay``, is kept in the state table."""

    FIELDS = "call_id long, state string, turns long, last_us long"

    def __init__(self, path: str, timeout: str, delay: str):
        self.path = path.rstrip("/")
        self.wait_us, self.delay_us = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (timeout, delay))

    def _before(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, int | None]:
        """Open calls and the latest event time as the batch before left them."""
        root = f"{self.path}/state"
        old = None
        if batch_id and folder_exists(spark, root):
            rows = spark.read.schema(self.FIELDS + ", seen_us long, batch long").parquet(root).filter(F.col("batch") < batch_id)
            newest = rows.agg(F.max("batch")).first()[0]
            old = rows.filter(F.col("batch") == newest) if newest is not None else None
        if old is None:
            return spark.createDataFrame([], self.FIELDS), None
        # the latest time stands in a row of its own, without a call
        seen = old.filter("call_id is null").select("seen_us").first()
        return old.filter("call_id is not null").select("call_id", "state", "turns", "last_us"), seen[0] if seen else None

    def _folded(self, events: DataFrame) -> DataFrame:
        """One row per call of a batch."""
        at = F.struct("us", "event_id")
        ends = events.filter(F.col("kind") == "call.ended").groupBy("call_id").agg(F.min(at).alias("_end"))
        upto = events.join(ends, "call_id", "left").filter(F.col("_end").isNull() | (at <= F.col("_end")))
        return upto.groupBy("call_id").agg(
            F.count_if(F.col("kind") == "turn.transcript").alias("n_turns"), F.max("us").alias("n_last"), F.max(F.col("_end").isNotNull()).alias("n_ended"),
            F.max(F.col("kind") == "error").alias("n_error"), F.max(F.col("kind").isin("turn.transcript", "tool.call")).alias("n_active"))

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        old, seen = self._before(spark, batch_id)
        events = df.select("call_id", "event_id", F.unix_micros("ts").alias("us"), "kind")
        mark = None if seen is None else seen - self.delay_us
        if mark is not None:
            events = events.filter(F.col("us") >= mark // 1000 * 1000)
        events = materialize(events)
        latest_us = events.agg(F.max("us")).first()[0]
        seen = max((x for x in (seen, latest_us) if x is not None), default=None)
        both = old.withColumn("_old", F.lit(True)).join(self._folded(events), "call_id", "full")
        was_ended = F.coalesce(F.col("state") == "ended", F.lit(False))
        touched = F.col("n_last").isNotNull() & ~was_ended
        state = (F.when(F.col("n_ended"), "ended").when((F.col("state") == "escalated") | F.col("n_error"), "escalated")
                  .when(F.col("n_active"), "active").otherwise(F.coalesce("state", F.lit("ringing"))))
        now = both.select("call_id", F.when(touched, state).otherwise(F.col("state")).alias("state"),
                          F.when(touched, F.coalesce("turns", F.lit(0)) + F.col("n_turns")).otherwise(F.col("turns")).cast("long").alias("turns"),
                          F.when(touched, F.greatest("last_us", "n_last")).otherwise(F.col("last_us")).alias("last_us"), touched.alias("_touched"))
        limit = -(1 << 62) if seen is None else seen - self.delay_us - self.wait_us
        expired = F.col("last_us") < F.lit(limit)
        now = materialize(now.withColumn("_expired", expired))
        keep = now.filter(~F.col("_expired")).select("call_id", "state", "turns", "last_us", F.lit(None).cast("long").alias("seen_us"))
        clock = spark.createDataFrame([(None, None, None, None, seen)], self.FIELDS + ", seen_us long")
        keep.unionByName(clock).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
        timed_out = F.col("_expired") & (F.col("state") != "ended")
        log = now.filter(F.col("_touched") | timed_out).select(
            "call_id", F.when(timed_out, "timed_out").otherwise(F.col("state")).alias("state"), "turns", F.timestamp_micros("last_us").alias("last_ts"))
        log.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}")
        fs, p = _fs(spark, f"{self.path}/state/batch={batch_id - 2}")       # a replay needs the batch before only
        fs.delete(p, True)

    def read(self, spark: SparkSession) -> DataFrame:
        """(call_id, state, turns, last_ts): every call's newest state, ended and timed-out ones included."""
        return read_latest(spark, f"{self.path}/log", ["call_id"])


# M7 -----------------------------------------------------------------------
STATUS_RANK = {"failed": 0, "queued": 1, "sent": 2, "delivered": 3, "read": 4}


def fold_status(stream: DataFrame, key: list[str], delay: str) -> DataFrame:
    """M7: furthest status per notification from out-of-order callbacks
    (failed only when nothing better arrived)."""
    m = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    s = stream.withWatermark("ts", delay).withColumn("rnk", m[F.col("status")])
    return s.groupBy(*key).agg(F.max_by("status", F.struct("rnk", "ts", "event_id")).alias("status"),
                               F.count(F.lit(1)).alias("callbacks"))


# M10 ----------------------------------------------------------------------
def access_spikes(stream: DataFrame, size: str, limit: int, delay: str, actions=("login_failed", "export")) -> DataFrame:
    """Failed logins or exports per user per window over ``limit``. The
    stream has user_id, ts and action."""
    s = stream.filter(F.col("action").isin(*actions)).withWatermark("ts", delay)
    g = s.groupBy("user_id", "action", F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("attempts"))
    return g.filter(F.col("attempts") > limit)


# Sinks ------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Removes what an earlier try of a micro-batch has written under ``path/*/batch=<id>``."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/*/batch={batch_id}")
    for found in fs.globStatus(p) or []:
        fs.delete(found.getPath(), True)


def upsert_log(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch writer: each micro-batch's rows go to ``path/batch=<id>``
    (overwrite, so a replayed batch id replaces its own rows)."""
    def write(df: DataFrame, batch_id: int) -> None:
        out = transform(df) if transform else df
        out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def split_events(path: str, reject_path: str):
    """M1, foreachBatch writer: typed events to ``path/batch=<id>``, lines
    that do not fit the schema to ``reject_path/batch=<id>``. A batch without
    rejects writes an empty folder, so a replay replaces an earlier try."""
    good, bad = upsert_log(path, good_events), upsert_log(reject_path, rejects)

    def write(df: DataFrame, batch_id: int) -> None:
        good(df, batch_id)
        bad(df, batch_id)
    return write


def read_latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Newest row per key over the change log written by ``upsert_log``."""
    df = spark.read.parquet(path)
    w = Window.partitionBy(*key).orderBy(F.col("batch").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch")


def run_available_now(stream_df: DataFrame, sink: Callable, checkpoint: str, mode: str = "update") -> dict:
    """Processes everything available now in micro-batches, then stops.
    Returns the number of micro-batches and of rows the stateful operators
    dropped as late (older than the watermark), from the query progress (for
    aggregations these are rows after the map-side partial aggregation)."""
    q = (stream_df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    progress = q.recentProgress
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in progress
               for op in (p.get("stateOperators") or []))
    return {"batches": len(progress), "late_rows_dropped": late}


# M8 -----------------------------------------------------------------------
def ingest_stream(path: str, chunker: Callable[[DataFrame], DataFrame], embedder: Callable[[DataFrame], DataFrame],
                  id_col: str = "doc_id"):
    """M8, foreachBatch writer: the documents of a micro-batch are chunked and
    embedded and written under ``path/batch=<id>`` (overwrite, so a replay is
    idempotent). A document without a chunk leaves one row without a
    ``chunk_id``, so ``current_chunks`` knows that its earlier chunks are
    gone."""
    def write(df: DataFrame, batch_id: int) -> None:
        vec = embedder(chunker(df))
        df.select(id_col).distinct().join(vec, id_col, "left") \
            .write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def current_chunks(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """M8: the chunks of the newest version of each document; those of
    versions that a later batch replaced are left out."""
    df = spark.read.parquet(path)
    newest = df.groupBy(id_col).agg(F.max("batch").alias("batch"))
    return df.join(newest, [id_col, "batch"], "left_semi").filter(F.col("chunk_id").isNotNull()).drop("batch")


# M9 -----------------------------------------------------------------------
def route_stream(path: str, router: Callable[[DataFrame], DataFrame], targets: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
    """M9, foreachBatch writer: requests are normalised and routed, and
    written in one job to ``path/requests/batch=<id>/route=<r>``; the target
    rows of each route (P5, ``targets``: route -> row builder) go to
    ``path/<route>/batch=<id>``, read from the written requests."""
    root = path.rstrip("/")

    def write(df: DataFrame, batch_id: int) -> None:
        requests = f"{root}/requests/batch={batch_id}"
        routed = router(df)
        routed.write.mode("overwrite").partitionBy("route").parquet(requests)
        stored = df.sparkSession.read.schema(routed.schema).parquet(requests)
        for route, build in (targets or {}).items():
            build(stored.filter(F.col("route") == route)).write.mode("overwrite").parquet(f"{root}/{route}/batch={batch_id}")
    return write
