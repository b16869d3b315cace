import datetime as dt

from tessera.operators import dashboard as D
from tessera.operators import reports as RP
from tessera.operators import rules as RU


def test_call_stats_rounding_and_empty_tenant(spark):
    tenants = spark.createDataFrame([(1,), (2,)], "tenant_id int")
    calls = spark.createDataFrame([(1, True, "completed", 2), (1, False, "failed", 3), (1, False, "completed", None)],
                                  "tenant_id int, escalated boolean, status string, duration_sec int")
    bookings = spark.createDataFrame([(1,)], "tenant_id int")
    leads = spark.createDataFrame([(2,)], "tenant_id int")
    got = {r.tenant_id: r for r in D.call_stats(tenants, calls, bookings, leads).collect()}
    assert (got[1].total_calls, got[1].escalated, got[1].completed, got[1].avg_duration_sec) == (3, 1, 2, 3)  # 2.5 -> 3
    assert (got[2].total_calls, got[2].avg_duration_sec, got[2].bookings, got[2].leads) == (0, 0, 0, 1)


def test_next_slots_and_recent(spark):
    av = spark.createDataFrame([(1, 5, "R5", dt.datetime(2024, 1, d), d % 2 == 0, d, 1) for d in range(1, 20)],
                               "tenant_id int, resource_id long, resource_name string, slot timestamp_ntz, "
                               "is_booked boolean, order_key long, line_no int")
    got = [r.slot.day for r in D.next_slots(av, dt.datetime(2024, 1, 4), 5).orderBy("slot").collect()]
    assert got == [5, 7, 9, 11, 13]


def test_concurrency(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    calls = spark.createDataFrame([(1, t(1), t(3)), (1, t(2), t(4)), (1, t(3), t(5)), (1, t(6), None)],
                                  "tenant_id int, started_at timestamp_ntz, ended_at timestamp_ntz")
    caps = spark.createDataFrame([(1, 1)], "tenant_id int, max_concurrent int")
    r = RP.concurrency(calls, caps).first()
    assert r.peak == 2 and r.over_cap        # the call ending at 3 frees its line before the next starts


def test_notification_state_steps_back(spark):
    ev = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 0, 1), "sent"), (1, 2, dt.datetime(2024, 1, 1, 0, 2), "read"),
                                (1, 3, dt.datetime(2024, 1, 1, 0, 3), "delivered")],
                               "msg long, event_id long, ts timestamp_ntz, status string")
    r = RP.notification_state(ev, ["msg"]).first()
    assert r.status == "read" and r.steps_back == 1 and r.callbacks == 3


def test_fill_waitlist_pairs_in_order(spark):
    slots = spark.createDataFrame([(1, 9, dt.datetime(2024, 1, d), d, 1) for d in (3, 1, 2)],
                                  "tenant_id int, resource_id long, slot timestamp_ntz, order_key long, line_no int")
    req = spark.createDataFrame([(1, 9, dt.datetime(2023, 12, d), f"b{d}") for d in (5, 4)],
                                "tenant_id int, resource_id long, created_at timestamp_ntz, booking_key string")
    got = sorted((r.booking_key, r.slot.day) for r in RU.fill_waitlist(slots, req).collect())
    assert got == [("b4", 1), ("b5", 2)]


def test_apply_replies_latest_wins(spark):
    b = spark.createDataFrame([("k1", "+15550001111", "confirmed"), ("k2", "+15550002222", "confirmed")],
                              "booking_key string, customer_phone string, status string")
    rp = spark.createDataFrame([("0015550001111", "STOP", dt.datetime(2024, 1, 1), "a"),
                                ("+1 555 000 1111", "Cancel please", dt.datetime(2024, 1, 2), "b")],
                               "phone string, text string, ts timestamp_ntz, seq string")
    got = {r.booking_key: (r.status, r.opted_out) for r in RU.apply_replies(b, rp).collect()}
    assert got == {"k1": ("cancelled", False), "k2": ("confirmed", False)}


def test_plan_notifications_and_suppress(spark):
    b = spark.createDataFrame([("k1", 1, "+1555", None), ("k2", 2, None, "a@b.c")],
                              "booking_key string, tenant_id int, customer_phone string, customer_email string")
    ch = spark.createDataFrame([(1, True, False), (2, True, True)], "tenant_id int, email_enabled boolean, whatsapp_enabled boolean")
    got = {(r.booking_key, r.channel): r.reason for r in RU.plan_notifications(b, ch).collect()}
    assert got == {("k1", "whatsapp"): "channel disabled", ("k1", "email"): "no contact",
                   ("k2", "whatsapp"): "no contact", ("k2", "email"): None}
    cons = spark.createDataFrame([("+1555", "opt_in", dt.datetime(2024, 1, 1), "a"),
                                  ("+1555", "stop", dt.datetime(2024, 2, 1), "b"),
                                  ("+1666", "opt_in", dt.datetime(2024, 1, 1), "c")],
                                 "recipient string, consent string, ts timestamp_ntz, seq string")
    t = spark.createDataFrame([("+1555",), ("+1666",), ("+1777",)], "recipient string")
    assert sorted(r.recipient for r in RU.suppress(t, cons).collect()) == ["+1666"]


def test_quality_checks(spark):
    from tessera.operators import quality as Q
    df = spark.createDataFrame([(1, "twilio", "a"), (2, "exotel", "a"), (2, None, "b")], "id int, provider string, k string")
    got = {r.id: r.failed for r in Q.check_domains(df, {"provider": Q.DOMAINS["provider"]}).collect() if r.id == 1}
    assert got == {1: []}
    assert sorted(r.failed for r in Q.check_domains(df, {"provider": Q.DOMAINS["provider"]}).collect()) == \
        [[], ["provider"], ["provider"]]
    keys = {(r.id, r.problem) for r in Q.check_keys(df, ["id"]).collect()}
    assert keys == {(2, "duplicate_key")}
    red = spark.createDataFrame([("mail a.b@x.org or +91 90000 00000 now",)], "t string")
    r = Q.redact(red, "t").first()
    assert (r.n_emails, r.n_phones, r.t) == (1, 1, "mail [email] or [phone] now")


def test_access_report_reads_the_audit_once(spark):
    import datetime as dt

    days = [dt.datetime(2024, 1, 1 + i, 5) for i in range(9)]
    rows = [(1, d) for d in days] + [(1, days[0])] * 8 + [(2, days[0]), (None, days[0])]
    out = RP.access_report(spark.createDataFrame(rows, "user_id long, ts timestamp"), "1 day")
    got = {(r.user_id, r.window_start): (r.accesses, r["mean"], r.sd, r.spike) for r in out.collect()}
    assert got[1, days[0].replace(hour=0)] == (9, 1.8889, 2.6667, True) and got[1, days[1].replace(hour=0)] == (1, 1.8889, 2.6667, False)
    assert got[2, days[0].replace(hour=0)] == (1, 1.0, None, False) and len(got) == 10
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()        # before: a join of two readings


def test_bookings_without_a_phone_do_not_meet_in_one_task(spark):
    b = spark.createDataFrame([("a", None, "pending"), ("b", None, "pending"), ("c", "+15550001111", "pending"), ("d", "+15550002222", "pending")],
                              "booking_key string, customer_phone string, status string")
    r = spark.createDataFrame([("0015550001111", "cancel", dt.datetime(2024, 1, 1), "1"), ("x", "stop", dt.datetime(2024, 1, 1), "2")],
                              "phone string, text string, ts timestamp, seq string")
    out = RU.apply_replies(b, r)
    assert sorted((x.booking_key, x.status, x.opted_out) for x in out.collect()) == [
        ("a", "pending", False), ("b", "pending", False), ("c", "cancelled", False), ("d", "pending", False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("isnull(customer_phone") >= 1                # joined only where there is a phone
