import datetime as dt
import os

from pyspark.sql import functions as F

from tessera.plans.streams_q import with_kind
from tessera.streaming import streams as ST


def write_files(spark, rows, path, order):
    """One parquet file per group, modification times in ``order``."""
    seen: set[str] = set()
    for i, grp in enumerate(order):
        df = spark.createDataFrame(rows[grp], ST.EVENT_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            full = os.path.join(path, f)
            if f.endswith(".parquet") and not f.startswith(".") and f not in seen:
                seen.add(f)
                os.utime(full, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))


def ev(i, minutes, user=1, kind="view"):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes), user, kind, 1.0, "{}")


def run_dedupe(spark, tmp_path, order):
    rows = {"early": [ev(1, 0), ev(2, 5)], "late": [ev(3, 600), ev(1, 0)]}
    src = str(tmp_path / f"src-{'-'.join(order)}")
    write_files(spark, rows, src, order)
    s = ST.dedupe_events(ST.read_events(spark, src, "parquet", max_files=1), "1 hour")
    sink = str(tmp_path / f"sink-{'-'.join(order)}")
    ST.run_available_now(s, ST.upsert_log(sink), str(tmp_path / f"ck-{'-'.join(order)}"), "append")
    return sorted(r.event_id for r in spark.read.parquet(sink).collect())


def test_dedupe_is_order_free(spark, tmp_path):
    assert run_dedupe(spark, tmp_path, ["early", "late"]) == [1, 2, 3]
    assert run_dedupe(spark, tmp_path, ["late", "early"]) == [1, 2, 3]


def test_late_rows_dropped_by_window_aggregate(spark, tmp_path):
    rows = {"early": [ev(1, 0), ev(2, 5)], "late": [ev(3, 600)], "mid": [ev(4, 630)]}
    out = {}
    # A batch drops rows older than the watermark of the batch before it, so
    # the early file comes third when replayed out of order.
    for order in (["early", "late", "mid"], ["late", "mid", "early"]):
        tag = "-".join(order)
        src = str(tmp_path / f"w-src-{tag}")
        write_files(spark, rows, src, order)
        k = ST.live_kpis(with_kind(ST.read_events(spark, src, "parquet", max_files=1)), "1 hour", "1 hour").select(
            F.col("w.start").alias("ws"), "events")
        sink = str(tmp_path / f"w-sink-{tag}")
        info = ST.run_available_now(k, ST.upsert_log(sink), str(tmp_path / f"w-ck-{tag}"), "update")
        out[tag] = sorted((r.ws.hour, r.events) for r in ST.read_latest(spark, sink, ["ws"]).collect())
        out[tag + "-late"] = info["late_rows_dropped"]
    assert out["early-late-mid"] == [(0, 2), (10, 2)]
    # out of order: the early file comes after the watermark moved to 9:00,
    # so its rows are late and not counted
    assert out["late-mid-early"] == [(10, 2)]
    # dropped and counted (rows reaching the state operator, i.e. after the
    # partial aggregation: the two late events of one window count once)
    assert out["early-late-mid-late"] == 0 and out["late-mid-early-late"] == 1


def test_kpis_match_batch(spark, tmp_path):
    rows = {"a": [ev(i, i * 7, user=i % 3, kind="signup" if i % 4 == 0 else "view") for i in range(20)],
            "b": [ev(100 + i, 200 + i * 7, user=i % 3) for i in range(20)]}
    src = str(tmp_path / "kpi-src")
    write_files(spark, rows, src, ["a", "b"])
    s = with_kind(ST.read_events(spark, src, "parquet", max_files=1))
    k = ST.live_kpis(s, "1 hour", "1 hour").select(F.col("w.start").alias("ws"), "tenant_id", "calls", "events")
    sink = str(tmp_path / "kpi-sink")
    ST.run_available_now(k, ST.upsert_log(sink), str(tmp_path / "kpi-ck"), "update")
    got = sorted(tuple(r) for r in ST.read_latest(spark, sink, ["ws", "tenant_id"]).collect())
    b = spark.read.parquet(src)
    exp = with_kind(b).groupBy(F.window("ts", "1 hour").start.alias("ws"), "tenant_id").agg(
        F.count_if(F.col("kind") == "call.started").alias("calls"), F.count(F.lit(1)).alias("events"))
    assert got == sorted(tuple(r) for r in exp.collect())


def run_calls(spark, tmp_path, batches):
    src, sink, ck = (str(tmp_path / x) for x in ("cs-src", "cs-sink", "cs-ck"))
    for rows in batches:
        spark.createDataFrame(rows, ST.EVENT_SCHEMA).write.mode("append").parquet(src)
        s = with_kind(ST.read_events(spark, src, "parquet")).withColumn("call_id", F.col("user_id"))
        ST.run_available_now(ST.call_states(s, "1 hour", "10 minutes"), ST.upsert_log(sink), ck, "update")
    return {r.call_id: (r.state, r.turns, r.last_ts) for r in ST.read_latest(spark, sink, ["call_id"]).collect()}


def test_call_state_timeout(spark, tmp_path):
    got = run_calls(spark, tmp_path, [
        [ev(1, 0, user=7, kind="signup"), ev(2, 1, user=7), ev(3, 0, user=8, kind="signup"), ev(4, 2, user=8, kind="purchase")],
        [ev(5, 600, user=9, kind="signup")]])
    assert [got[k][0] for k in (7, 8, 9)] == ["timed_out", "ended", "ringing"]


def test_an_ended_call_stays_ended(spark, tmp_path):
    """An event inside the watermark delay comes after the end, in a later batch."""
    got = run_calls(spark, tmp_path, [
        [ev(1, 0, user=7, kind="signup"), ev(2, 1, user=7), ev(3, 2, user=7), ev(4, 3, user=7, kind="purchase")],
        [ev(5, 4, user=7)], [ev(6, 600, user=9, kind="signup")]])
    assert got[7][:2] == ("ended", 2)


def test_call_states_in_another_time_zone(spark, tmp_path):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = run_calls(spark, tmp_path, [[ev(1, 0, user=7, kind="signup"), ev(2, 1, user=7)], [ev(5, 600, user=9, kind="signup")]])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got[7][:2] == ("timed_out", 1) and got[9][0] == "ringing"


def test_rejects_and_changed_documents(spark, tmp_path):
    src, good, bad = (str(tmp_path / x) for x in ("ev-src", "good", "bad"))
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        f.write('{"event_id": 1, "ts": "2024-01-01T00:00:00", "user_id": 1, "event_type": "view", "value": 1.0, "props": "{}"}\n')
        f.write('{"event_id": 2, "ts": "soon"}\nnot json\n')
    ST.run_available_now(ST.read_events(spark, src), ST.split_events(good, bad), str(tmp_path / "ev-ck"), "append")
    assert [r.event_id for r in spark.read.parquet(good).collect()] == [1]
    assert spark.read.parquet(bad).count() == 2

    docs, sink, ck = (str(tmp_path / x) for x in ("docs", "chunks", "doc-ck"))
    for batch in ([(1, "aa bb cc"), (2, "dd"), (3, "ee")], [(1, "aa"), (3, None)]):
        df = spark.createDataFrame(batch, "doc_id long, content string")
        df.write.mode("append").parquet(docs)
        cut = lambda d: d.filter("content is not null").select("doc_id", F.posexplode(F.split("content", " ")).alias("n", "chunk")) \
            .withColumn("chunk_id", F.concat_ws("-", "doc_id", "n"))
        ST.run_available_now(spark.readStream.schema(df.schema).parquet(docs), ST.ingest_stream(sink, cut, lambda d: d), ck, "append")
    assert sorted((r.doc_id, r.chunk) for r in ST.current_chunks(spark, sink).collect()) == [(1, "aa"), (2, "dd")]


def test_replay_is_idempotent(spark, tmp_path):
    """Running the same replay twice into the same sink (fresh checkpoints,
    so batch ids restart) gives the same table: each batch id rewrites its
    own folder."""
    rows = {"a": [ev(i, i * 11, user=i % 4) for i in range(15)], "b": [ev(50 + i, 300 + i * 11, user=i % 4) for i in range(15)]}
    src = str(tmp_path / "idem-src")
    write_files(spark, rows, src, ["a", "b"])
    sink = str(tmp_path / "idem-sink")
    snaps = []
    for run in range(2):
        k = ST.live_kpis(with_kind(ST.read_events(spark, src, "parquet", max_files=1)), "1 hour", "1 hour").select(
            F.col("w.start").alias("ws"), "tenant_id", "events")
        ST.run_available_now(k, ST.upsert_log(sink), str(tmp_path / f"idem-ck-{run}"), "update")
        snaps.append(sorted(tuple(r) for r in ST.read_latest(spark, sink, ["ws", "tenant_id"]).collect()))
    assert snaps[0] == snaps[1] and sum(r[2] for r in snaps[0]) == 30
