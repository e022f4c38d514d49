"""Writes, leases, deliveries and robots.txt attempts, on rows whose answers are written out."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import codec
from tidewatch.functions.robots import acquired
from tidewatch.operators import operations, writes

NOW = dt.datetime(2026, 1, 5)


def _now():
    return F.lit("2026-01-05").cast("timestamp_ntz")


def test_robots_attempts(spark):
    ok, lost = "HTTP_RESPONSE", "TIMEOUT"
    cases = {  # https answers in turn, then http's
        "rules": ([(ok, 503, False), (ok, 200, True)], None, "RULES"),
        "empty": ([(ok, 200, False)], None, "UNAVAILABLE"),
        "denied": ([(ok, 404, True), (ok, 403, True)], None, "DENIED"),
        "missing": ([(ok, 404, True)] * 3, (ok, 404, True), "ALLOW_ALL"),
        "plain": ([(lost, None, False)] * 3, (ok, 200, True), "RULES"),
        "answered before": ([(ok, 503, False), (ok, 404, True), (ok, 404, True)], (ok, 200, True), "UNAVAILABLE"),
        "under way": ([(ok, 404, True), (lost, None, False)], None, "RETRY"),
        "nobody": ([(lost, None, False)] * 3, (lost, None, False), "UNAVAILABLE"),
        "blocked": ([("SECURITY_BLOCKED", None, False)], None, "UNAVAILABLE"),
    }
    rows = [(k, "https", i + 1, *a) for k, (tries, _, _) in cases.items() for i, a in enumerate(tries)]
    rows += [(k, "http", 1, *a) for k, (_, a, _) in cases.items() if a]
    df = spark.createDataFrame(rows, "k string, scheme string, attempt int, outcome string, status int, has_body boolean")
    assert {r.k: r.robots for r in acquired(df, "k").collect()} == {k: c[2] for k, c in cases.items()}
    assert acquired(df.limit(0), "k").count() == 0


def test_lease_that_ends_now_is_free(spark):
    later = NOW + dt.timedelta(seconds=1)
    rows = [("now", "RUNNING", 3, NOW), ("live", "RUNNING", 3, later), ("none", "FINALIZING", 0, None), ("over", "FAILED", 1, None), ("queued", "QUEUED", 0, later), ("gone", "CANCELLED", 1, None)]
    runs = spark.createDataFrame(rows, "run_id string, status string, lease_token int, lease_expires_at timestamp_ntz")
    got = {r.run_id: (r.acquired, r.status, r.lease_token) for r in operations.acquire_leases(runs, _now(), 60).collect()}
    assert got == {"now": (True, "RUNNING", 4), "live": (False, "RUNNING", 3), "none": (True, "FINALIZING", 1), "over": (False, "FAILED", 1), "queued": (False, "QUEUED", 0), "gone": (False, "CANCELLED", 1)}
    cancelled = runs.select("run_id", operations.cancel(F.col("status"), F.col("lease_expires_at"), _now()).alias("c"))
    assert {r.run_id: r.c for r in cancelled.collect()} == {"now": "IMMEDIATE", "live": "COOPERATIVE", "none": "IMMEDIATE", "over": "CONFLICT", "queued": "IMMEDIATE", "gone": "ALREADY_FINISHED"}
    held = spark.createDataFrame([("now", 2), ("live", 3), ("over", 1)], "run_id string, token int")
    renewed = {r.run_id: (r.renewed, r.lease_expires_at) for r in operations.renew_leases(runs, held, _now(), 60).collect()}
    assert renewed["live"] == (True, NOW + dt.timedelta(seconds=60)) and renewed["now"] == (False, NOW) and not renewed["over"][0] and not renewed["none"][0]


def test_ack_by_the_holder_only(spark):
    rows = [(1, "a", NOW, None, NOW), (2, "a", NOW, None, NOW), (3, None, None, None, NOW), (4, "a", NOW, None, NOW)]
    events = spark.createDataFrame(rows, "event_id int, claim_token string, claim_until timestamp_ntz, delivered_at timestamp_ntz, available_at timestamp_ntz")
    answers = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", None), (4, "a", 90)], "event_id int, claim_token string, delay_s int")
    got = {r.event_id: tuple(r)[1:] for r in writes.ack(events, answers, _now()).collect()}
    assert got[1] == (None, None, NOW, NOW) and got[4] == (None, None, None, NOW + dt.timedelta(seconds=90))
    assert got[2] == ("a", NOW, None, NOW) and got[3] == (None, None, None, NOW)


def test_fifth_delivery_is_tried(spark):
    df = spark.createDataFrame([(5, True), (5, False), (6, True)], "n int, ok boolean").select(operations.delivery(F.col("n"), F.col("ok")).alias("d"))
    assert [r.d.status for r in df.collect()] == ["DELIVERED", "PENDING", "FAILED"]


def test_policy_numbers_and_clients(spark):
    df = spark.createDataFrame([('{"n": 2.5}',), ('{"n": "5"}',), ('{"n": -1}',), ('{"n": null}',), ("{}",), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(codec.positive_number(F.col("j"), "n", 20)).collect()] == [2.5] + [20.0] * 6
    sent = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "p"), ("", "p"), (None, None)], "f string, p string")
    assert [r[0] for r in sent.select(codec.client_key(F.col("f"), F.col("p"))).collect()] == ["1.1.1.1", "p", "unknown"]
