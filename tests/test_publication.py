"""Scope and suppression of issues, the overview's runs, folds over long keys."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import operations, publish, reports
from tidewatch.sources.crawl import observations
from tidewatch.sources.tables import load, stored

SF = "/root/testdata/sf0.001"


def seen(spark, rows):
    """Observations (run_no, page_id, policy, scope, title) of one project, complete runs, on consecutive days."""
    base = observations(spark, SF).limit(0)
    known = {f: "KNOWN" for f in ("title", "metaDescription", "canonical", "robots", "internalLinksCount")}
    full = [
        ("p", n, f"p#{n}", policy, scope, 1, page, f"https://p/{page}", "HTTP_RESPONSE", 200, title, None, 1, ([], []), ([], "ALLOWED"), known, dt.datetime(2026, 1, n))
        for n, page, policy, scope, title in rows
    ]
    return spark.createDataFrame(full, base.schema)


def test_scope_and_suppression(spark):
    o = seen(spark, [(1, 1, "a", 1, None), (1, 2, "a", 1, None), (2, 1, "b", 1, None), (2, 2, "b", 1, "t"), (3, 1, "c", 2, None), (3, 2, "c", 2, "t")])
    until = spark.createDataFrame([("p", 1, "missing_title", dt.datetime(2026, 1, 2))], "project_id string, page_id long, rule_key string, suppressed_until timestamp_ntz")
    p = publish.publish(o)
    tables = runs, events, issue_states = stored(p.runs), stored(p.events), stored(p.states)
    states = {(r.run_no, r.page_id): (r.old_state, r.state, r.occurrence) for r in issue_states.collect() if r.rule_key == "missing_title"}
    # a new policy of the same scope goes on with the issues, a new scope begins anew
    assert states == {(1, 1): (None, "OPEN", 1), (1, 2): (None, "OPEN", 1), (2, 1): ("OPEN", "OPEN", 1), (2, 2): ("OPEN", "RESOLVED", 1), (3, 1): (None, "OPEN", 1)}
    # suppressed while until is not before the run's publication
    assert {r.run_no: r.issues_open for r in publish.summarise(*tables, until).collect()} == {1: 1, 2: 0, 3: 1}
    assert {r.run_no: r.issues_open for r in publish.summarise(*tables).collect()} == {1: 2, 2: 1, 3: 1}
    issues = reports.current_issues(issue_states, runs).filter("state = 'OPEN'")
    at = lambda d: F.lit(dt.datetime(2026, 1, d)).cast("timestamp_ntz")
    assert [reports.unsuppressed(issues, until, at(d), inclusive=i).count() for d, i in ((1, False), (2, False), (2, True), (3, False))] == [0, 0, 1, 1]


def test_overview_takes_runs_by_status(spark):
    o = seen(spark, [(1, 1, "a", 1, "t")])
    p = publish.publish(o)
    summary, states = stored(p.summary), stored(p.states)
    issues = reports.current_issues(states, stored(p.runs))
    schema = "project_id string, run_no long, run_id string, status string, failure_code string, pages_done long, pages_known long"
    runs = spark.createDataFrame([("p", 1, "p#1", "COMPLETED", "LIMIT_REACHED", 1, 1), ("p", 2, "p#2", "CANCELLED", None, 0, 1), ("p", 3, "p#3", "CRAWLING", None, 4, 9)], schema)
    pages = o.select("project_id", "page_id")
    row = reports.overview(summary, runs, pages, issues).collect()[0]
    assert (row.run_id, row.failed_run_id, row.failed_status, row.active_run_id, row.active_done) == ("p#1", "p#2", "CANCELLED", "p#3", 4)
    partial = reports.overview(summary, runs.filter("run_no = 1"), pages, issues).collect()[0]
    assert partial.failed_run_id is None and partial.active_run_id is None  # an incomplete run has not failed


def test_folds_are_linear_in_a_long_key(spark):
    n = 60_000
    tries = spark.range(n).select(F.lit("u").alias("subject"), F.timestamp_seconds(F.col("id")).alias("ts"), "id")
    assert operations.rate_limit(tries, 3, 10).filter("allowed").count() == 3 * (n // 10)
    requests = tries.select(F.lit(None).cast("string").alias("k"), "ts", F.lit("h").alias("request_hash"), "id")
    got = operations.idempotency(requests, 100, ("k",)).groupBy("outcome").count()
    assert {r.outcome: r["count"] for r in got.collect()} == {"RUN": n // 100, "REPLAY": n - n // 100}


def test_a_tick_claims_the_first_due_schedules(spark):
    s = load(spark, SF, "customer").select(F.col("c_custkey").alias("project_id"), F.lit(True).alias("enabled"), F.lit(dt.datetime(2026, 1, 1)).alias("next_run_at"))
    due = operations.due_schedules(s, F.lit(dt.datetime(2026, 1, 1)))
    assert [r.project_id for r in due.collect()] == sorted(r.project_id for r in s.collect())[:20]
