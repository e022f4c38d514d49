"""Publication batch by batch: the same tables as in one plan, two writers, lost leases, replays, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import ledger as books
from tidewatch.operators import publish, rules
from tidewatch.operators.ledger import Ledger
from tidewatch.sources.crawl import observations, suppressions
from tidewatch.sources.tables import stored
from tidewatch.streaming.state import ledger_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seen(spark):
    every = observations(spark, SF)
    few = every.select("project_id").distinct().orderBy("project_id").limit(9)
    return stored(every.join(few, "project_id", "left_semi"))


@pytest.fixture(scope="module")
def muted(seen):
    return stored(suppressions(seen))


def plain(rows, *drop):
    return sorted(repr({k: v for k, v in r.asDict(recursive=True).items() if k not in drop}) for r in rows)


@pytest.fixture(scope="module")
def whole(seen, muted):
    """What one plan over all runs gives."""
    p = publish.publish(seen, muted)
    states = stored(p.states)
    return {
        "summary": plain(p.summary.drop("components").collect()), "events": plain(p.events.collect()),
        "transitions": plain(rules.transitions(states).collect()),
        "open": sorted((r.project_id, r.page_id, r.rule_key, r.occurrence, r.state) for r in states.withColumn("top", F.max("run_no").over(books_window())).filter("run_no = top").collect()),
    }


def books_window():
    from pyspark.sql import Window

    return Window.partitionBy("project_id", "scope_generation", "page_id", "rule_key")


def tables(book):
    return {
        "summary": plain(book.table("summary").collect()), "events": plain(book.table("events").collect()), "transitions": plain(book.table("transitions").drop("run_no", "occurrence").collect()),
        "open": sorted((r.project_id, r.page_id, r.rule_key, r.occurrence, r.state) for r in book.issues().collect()),
    }


def test_four_batches_equal_one_plan(spark, tmp_path, seen, muted, whole):
    ends = seen.select("project_id", "run_id", "run_no").distinct()
    into = str(tmp_path / "ends")
    for n in range(1, 5):
        ends.filter(F.col("run_no") == n).coalesce(1).write.mode("append").parquet(into)
        stream = spark.readStream.schema(ends.schema).parquet(into)
        q = ledger_stream(stream, lambda: seen, f"file://{tmp_path}/book", str(tmp_path / "cp"), lambda: muted)
        assert q.awaitTermination(300)
    book = Ledger(spark, f"file://{tmp_path}/book")
    got = tables(book)
    assert set(got) == set(whole)
    for name in got:
        assert got[name] == whole[name], name
    assert book.commits().count() == len(whole["summary"]) == book.commits().select("run_id").distinct().count()
    # again: nothing but replays, and nothing changes
    again = book.publish(ends, seen, muted)
    assert set(again.values()) <= {"REPLAY", "PARTIAL"} and "REPLAY" in again.values()
    assert tables(book) == got
    # issues carry the run that looked at them last
    last = {r.project_id: r.run_id for r in book.commits().groupBy("project_id").agg(F.max_by("run_id", "n").alias("run_id")).collect()}
    now = book.issues().collect()
    assert now and all(i.last_evaluated_run_id == last[i.project_id] or i.scope_generation == 1 for i in now)
    assert all(i.evidence for i in now)


def test_all_runs_in_one_batch(spark, tmp_path, seen, muted, whole):
    book = Ledger(spark, f"file://{tmp_path}/book")
    out = book.publish(seen.select("project_id", "run_id").distinct(), seen, muted)
    assert sorted(set(out.values())) == ["PARTIAL", "PUBLISHED"]
    got = tables(book)
    assert got["summary"] == whole["summary"] and got["open"] == whole["open"]


def one(spark, seen, n):
    p = seen.filter("run_no <= 2").groupBy("project_id").agg(F.countDistinct("run_id").alias("n")).orderBy("project_id").first().project_id
    full = {r.run_id for r in publish.run_table(seen.filter(F.col("project_id") == p)).filter("completeness = 'FULL'").collect()}
    return p, sorted(full)[:n]


def test_two_writers_of_one_run(spark, tmp_path, seen):
    """The second writer commits between the first one's tables and its commit: the first finds the entry taken."""
    p, (run, *_) = one(spark, seen, 1)
    ended = spark.createDataFrame([(p, run)], "project_id string, run_id string")
    a, b = Ledger(spark, f"file://{tmp_path}/book"), Ledger(spark, f"file://{tmp_path}/book")
    inner = []
    assert a.publish(ended, seen, between=lambda: inner.append(b.publish(ended, seen)) if not inner else None) == {run: "REPLAY"}
    assert inner == [{run: "PUBLISHED"}]
    assert a.table("summary").count() == 1 and a.rows("summary").select("attempt").distinct().count() == 2
    assert len(a.sweep()) == 1 and a.rows("summary").count() == 1 and a.table("issues").count() == a.rows("issues").count()


def test_a_moved_baseline_is_computed_anew(spark, tmp_path, seen):
    p, (one_, two) = one(spark, seen, 2)
    e = lambda r: spark.createDataFrame([(p, r)], "project_id string, run_id string")
    a, done = Ledger(spark, f"file://{tmp_path}/book"), []
    assert a.publish(e(two), seen, between=lambda: done.append(a.publish(e(one_), seen)) if not done else None) == {two: "PUBLISHED"}
    assert [x["run_id"] for x in a.entries(p)] == [one_, two]
    (row,) = a.table("summary").filter(F.col("run_id") == two).collect()
    policies = {x["run_id"]: x["policy_id"] for x in a.entries(p)}
    assert row.base_run_id == (one_ if policies[one_] == policies[two] else None)


def test_leases_and_refusals(spark, tmp_path, seen):
    p, (one_, two) = one(spark, seen, 2)
    book = Ledger(spark, f"file://{tmp_path}/book")
    old = book.acquire(one_)
    new = book.acquire(one_)
    assert (old, new) == (1, 2)
    schema = "project_id string, run_id string, token long, status string, cancel_requested boolean"
    ask = lambda run, token, status="FINALIZING", cancel=False: book.publish(spark.createDataFrame([(p, run, token, status, cancel)], schema), seen)[run]
    assert ask(one_, old) == "LEASE_LOST" and book.table("summary").count() == 0
    assert ask(one_, new, cancel=True) == "CANCEL_REQUESTED" and ask(one_, new, "CRAWLING") == "NOT_FINALIZING"
    lost = lambda: book.acquire(one_) if book.token(one_) == new else None
    run = spark.createDataFrame([(p, one_, new, "FINALIZING", False)], schema)
    assert book.publish(run, seen, between=lost) == {one_: "LEASE_LOST"}  # lost while the tables were written
    assert book.table("summary").count() == 0 and book.rows("summary").count() > 0
    assert ask(one_, new + 1) == "PUBLISHED" and ask(one_, old) == "REPLAY"
    assert book.publish(run.limit(0), seen) == {}


def test_published_out_of_order(spark, tmp_path):
    """The baseline is what was published last, whatever its number."""
    from tests.test_publication import seen as made

    o = made(spark, [(n, 1, "a", 1, f"t{n}") for n in (1, 2, 3)])
    book = Ledger(spark, f"file://{tmp_path}/book")
    for n in (2, 1, 3):
        book.publish(spark.createDataFrame([("p", f"p#{n}")], "project_id string, run_id string"), o)
    assert {r.run_no: r.base_run_id for r in book.table("summary").collect()} == {2: None, 1: "p#2", 3: "p#1"}
    assert isinstance(book.table("summary").first().finished_at, dt.datetime)
