"""S9 to S11 in place: only the partitions that change are written."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tessera.operators import partitions as PT
from tessera.operators import store as ST


def files(path):
    return {os.path.join(os.path.relpath(d, path), n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def months(names, *wanted):
    return {n for n in names if any(f"month={m}" in n for m in wanted)}


def table(spark, path):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 180).cast("int")).cast("timestamp_ntz")
    rows = spark.range(1800).select(F.col("id").alias("call_id"), (F.col("id") % 3).cast("int").alias("tenant_id"), day.alias("ts"))
    ST.write_by_month(rows, path, "ts")
    return rows


def test_purge_writes_only_months_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "calls")
    rows = table(spark, path)
    before = files(path)
    policies = spark.createDataFrame([(0, 60), (1, 150), (2, None)], "tenant_id int, retention_days int")
    as_of = dt.datetime(2024, 6, 10)
    hit = PT.purge_months(spark, path, policies, as_of, "ts")
    assert hit == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert months(files(path), "2024-05", "2024-06") == months(before, "2024-05", "2024-06") != set()
    assert not months(files(path), *hit) & before
    want = ST.apply_retention(rows, policies, as_of, "ts")
    assert sorted(r.call_id for r in spark.read.parquet(path).collect()) == sorted(r.call_id for r in want.collect())
    after = files(path)
    assert PT.purge_months(spark, path, policies, as_of, "ts") == [] and files(path) == after       # a second run finds nothing


def test_a_month_without_rows_loses_its_folder(spark, tmp_path):
    path = str(tmp_path / "calls")
    table(spark, path)
    PT.purge_months(spark, path, spark.createDataFrame([(i, 100) for i in range(3)], "tenant_id int, retention_days int"), dt.datetime(2024, 6, 10), "ts")
    assert sorted(x for x in os.listdir(path) if x.startswith("month=")) == ["month=2024-03", "month=2024-04", "month=2024-05", "month=2024-06"]


def test_replaced_months_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "calls")
    table(spark, path)
    before = files(path)
    new = spark.createDataFrame([(9, 1, dt.datetime(2024, 2, 3)), (10, 1, dt.datetime(2025, 1, 1))], "call_id long, tenant_id int, ts timestamp_ntz")
    PT.replace_months(new, path, "ts")
    now = files(path)
    assert before - now == months(before, "2024-02") and months(now, "2025-01")
    got = spark.read.parquet(path).filter("month in ('2024-02', '2025-01')").collect()
    assert sorted(r.call_id for r in got) == [9, 10]


def test_deleted_tenants_lose_their_folders_and_references_are_cleared(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("calls", "notes")}
    calls = spark.createDataFrame([(i, i % 4) for i in range(40)], "call_id long, tenant_id int")
    notes = spark.createDataFrame([(i, i, i % 4) for i in range(40)] + [(100, 1, 0), (101, None, 2)], "note_id long, call_id long, tenant_id int")
    PT.replace_partitions(calls, paths["calls"], "tenant_id")
    PT.replace_partitions(notes, paths["notes"], "tenant_id")
    before = {n: files(p) for n, p in paths.items()}
    written = PT.delete_tenants(spark, paths, [1], [("notes", "call_id", "calls")])
    assert written == {"notes": [0]}                            # only tenant 0's note named a call of tenant 1
    for n, keep in (("calls", (0, 2, 3)), ("notes", (2, 3))):
        for t in keep:
            assert {f for f in files(paths[n]) if f"tenant_id={t}" in f} == {f for f in before[n] if f"tenant_id={t}" in f}
    got = {r.note_id: r.call_id for r in spark.read.parquet(paths["notes"]).collect()}
    assert len(got) == 32 and got[100] is None and got[4] == 4 and not any(r.tenant_id == 1 for r in spark.read.parquet(paths["calls"]).collect())
