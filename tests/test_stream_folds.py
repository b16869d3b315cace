"""M2 after expiry, M5 merged before the shuffle, M6 folded without Python per call."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans.streams_q import with_kind
from tessera.streaming import streams as ST


def ev(i, minutes, user=1, kind="view"):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes), user, kind, 1.0, "{}")


def feed(spark, src, rows):
    spark.createDataFrame(rows, ST.EVENT_SCHEMA).write.mode("append").parquet(src)
    return ST.read_events(spark, src, "parquet")


# M2 -------------------------------------------------------------------------------
def test_a_replay_after_expiry_adds_no_row(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    first = [ev(i, 7 * i) for i in range(300)]
    for rows in (first + first[:50], [ev(9000, 60 * 24 * 400)], first, [ev(301, 3), ev(301, 3), ev(5, 35)]):
        ST.run_available_now(feed(spark, src, rows), ST.append_new(sink), ck, "append")
    got = sorted(r.event_id for r in spark.read.parquet(sink).collect())
    assert got == sorted([*range(300), 301, 9000])


def test_a_replayed_batch_replaces_its_own_rows(spark, tmp_path):
    sink = str(tmp_path / "sink")
    write = ST.append_new(sink)
    a, b = (spark.createDataFrame(rows, ST.EVENT_SCHEMA) for rows in ([ev(1, 0), ev(2, 3000)], [ev(2, 3000), ev(3, 3001)]))
    write(a, 0)
    write(b, 1)
    write(b.filter("event_id <> 3"), 1)                    # the second try sees fewer rows
    write(b, 1)
    assert sorted((r.event_id, r.batch) for r in spark.read.parquet(sink).collect()) == [(1, 0), (2, 0), (3, 1)]


# M5 -------------------------------------------------------------------------------
def test_sessions_are_merged_before_the_shuffle(spark, tmp_path):
    rnd = random.Random(1)
    rows = [ev(i, rnd.randrange(5000), user=1 if i % 3 == 0 else rnd.randrange(2, 40)) for i in range(3000)]
    out = {}
    for merged in (False, True):
        src, sink, ck = (str(tmp_path / f"{x}-{merged}") for x in ("src", "sink", "ck"))
        for part in (rows, [ev(-1, 10 ** 6, user=-1)]):
            x = ST.sessions(feed(spark, src, part), "30 minutes", "1 hour").select("user_id", F.col("s.start").alias("at"), "events", "last_ts")
            plans = []
            if merged:
                with ST.merged_before_shuffle(spark):
                    q = x.writeStream.outputMode("append").foreachBatch(ST.upsert_log(sink)).option("checkpointLocation", ck).trigger(availableNow=True).start()
                    q.awaitTermination()
                    plans.append(q._jsq.explainInternal(False))
            else:
                ST.run_available_now(x, ST.upsert_log(sink), ck, "append")
        if merged:
            before = plans[-1].split("Exchange", 1)[1]      # the plan prints its leaves last
            assert "MergingSessions" in before
        out[merged] = sorted(map(tuple, spark.read.parquet(sink).drop("batch").collect()))
    assert out[True] == out[False] and sum(r[2] for r in out[True] if r[0] == 1) == 1000
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "false"


# M6 -------------------------------------------------------------------------------
def folded(spark, tmp_path, batches, name="f"):
    src, path, ck = (str(tmp_path / f"{name}-{x}") for x in ("src", "out", "ck"))
    states = ST.CallStates(path, "1 hour", "10 minutes")
    for rows in batches:
        ST.run_available_now(with_kind(feed(spark, src, rows)).withColumn("call_id", F.col("user_id")), states, ck, "append")
    return {r.call_id: (r.state, r.turns, r.last_ts) for r in states.read(spark).collect()}


def kept(spark, tmp_path, batches, name="k"):
    src, sink, ck = (str(tmp_path / f"{name}-{x}") for x in ("src", "out", "ck"))
    for rows in batches:
        s = with_kind(feed(spark, src, rows)).withColumn("call_id", F.col("user_id"))
        ST.run_available_now(ST.call_states(s, "1 hour", "10 minutes"), ST.upsert_log(sink), ck, "update")
    return {r.call_id: (r.state, r.turns, r.last_ts) for r in ST.read_latest(spark, sink, ["call_id"]).collect()}


CASES = {
    "time-out": [[ev(1, 0, 7, "signup"), ev(2, 1, 7), ev(3, 0, 8, "signup"), ev(4, 2, 8, "purchase")], [ev(5, 600, 9, "signup")]],
    "late after the end": [[ev(1, 0, 7, "signup"), ev(2, 1, 7), ev(3, 2, 7), ev(4, 3, 7, "purchase")], [ev(5, 4, 7), ev(8, 4, 7, "error")], [ev(6, 600, 9, "signup")]],
    "escalated stays": [[ev(1, 0, 7, "error"), ev(2, 1, 8, "signup")], [ev(3, 2, 7), ev(4, 3, 8, "click")], [ev(5, 4, 7, "purchase")]],
    "after the end in a batch": [[ev(4, 3, 7, "purchase"), ev(2, 1, 7), ev(9, 3, 7), ev(10, 5, 7), ev(1, 3, 7)]],
    "a new call under an old id": [[ev(1, 0, 7, "purchase")], [ev(2, 600, 9)], [ev(3, 700, 7)]],
}


@pytest.mark.parametrize("case, zone", [*((c, "UTC") for c in CASES), ("time-out", "America/New_York")])
def test_fold_gives_the_same_states(spark, tmp_path, case, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert folded(spark, tmp_path, CASES[case]) == kept(spark, tmp_path, CASES[case])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_a_replayed_batch_gives_the_same_state_and_no_python(spark, tmp_path):
    states = ST.CallStates(str(tmp_path / "s"), "1 hour", "10 minutes")
    frames = [with_kind(spark.createDataFrame(rows, ST.EVENT_SCHEMA)).withColumn("call_id", F.col("user_id")) for rows in CASES["escalated stays"]]
    for i in (0, 1, 1, 2, 2):
        states(frames[i], i)
    assert {r.call_id: r.state for r in states.read(spark).collect()} == {7: "ended", 8: "active"}
    plan = states._folded(frames[0].select("call_id", "event_id", F.unix_micros("ts").alias("us"), "kind"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
