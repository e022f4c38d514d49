"""From observations to published runs: completeness, baseline, changes, issues, score, summary.

All runs of all projects are published by one plan. It is idempotent by run: publishing again yields the same rows, and
writes.insert_new() keeps what is there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import diff, rules
from tidewatch.operators.health import health

UNRECOVERED = ("NETWORK_ERROR", "TIMEOUT", "BODY_TOO_LARGE", "REDIRECT_LIMIT")


def completeness(facts: DataFrame) -> DataFrame:
    """Adds status, completeness, failure_code to runs with the facts forced_failure (code or null), cancelled, http_count,
    security_blocked, body_exceeded, limit_reached, unrecovered: the first that applies decides."""
    verdict = lambda status, done, code: F.struct(F.lit(status).alias("status"), F.lit(done).alias("completeness"), (F.lit(code) if not isinstance(code, Column) else code).cast("string").alias("failure_code"))  # noqa: E731, E501
    return facts.withColumn(
        "__v",
        F.when(F.col("forced_failure").isNotNull(), verdict("FAILED", "NONE", F.col("forced_failure")))
        .when(F.col("cancelled"), verdict("CANCELLED", "NONE", None))
        .when(F.col("http_count") == 0, verdict("FAILED", "NONE", "NO_OBSERVATIONS"))
        .when(F.col("security_blocked"), verdict("COMPLETED", "PARTIAL", "SECURITY_BLOCKED"))
        .when(F.col("body_exceeded"), verdict("COMPLETED", "PARTIAL", "BODY_BUDGET_EXCEEDED"))
        .when(F.col("limit_reached"), verdict("COMPLETED", "PARTIAL", "LIMIT_REACHED"))
        .when(F.col("unrecovered"), verdict("COMPLETED", "PARTIAL", "UNRECOVERED_FETCH_ERRORS"))
        .otherwise(verdict("COMPLETED", "FULL", None)),
    ).select(*facts.columns, "__v.*")


def scoped(df: DataFrame) -> DataFrame:
    """The scope's columns, 1 where a table has none."""
    return df.withColumns({c: F.lit(1).cast("bigint") for c in rules.SCOPE if c not in df.columns})


def run_facts(observations: DataFrame) -> DataFrame:
    """Facts of completeness() per run, from observations alone."""
    o = F.col("fetch_outcome")
    return scoped(observations).groupBy("project_id", "run_id", "run_no", "policy_id", "scope_generation", "rule_version").agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(o == "HTTP_RESPONSE").alias("http_count"), F.bool_or(o == "SECURITY_BLOCKED").alias("security_blocked"),
        F.bool_or(o.isin(*UNRECOVERED)).alias("unrecovered"), F.max("fetched_at").alias("finished_at"),
        F.first(F.lit(None).cast("string")).alias("forced_failure"), F.first(F.lit(False)).alias("cancelled"), F.first(F.lit(False)).alias("body_exceeded"), F.first(F.lit(False)).alias("limit_reached"),
    )


def baselines(runs: DataFrame) -> DataFrame:
    """Adds base_run_id: the latest earlier FULL run of the same project and policy."""
    w = Window.partitionBy("project_id", "policy_id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("completeness") == "FULL", F.col("run_id"))
    return runs.withColumn("base_run_id", F.last(full, ignorenulls=True).over(w))


def run_table(observations: DataFrame) -> DataFrame:
    return baselines(completeness(run_facts(observations)))


@dataclass
class Publication:
    runs: DataFrame
    events: DataFrame
    verdicts: DataFrame
    states: DataFrame
    summary: DataFrame


def open_counts(published: DataFrame, states: DataFrame) -> DataFrame:
    """run_id, rule_key, open: issues open after each published run, also those whose pages it did not observe.

    Counts run forward over each rule's state changes, so nothing is joined page by page.
    """
    change = F.when(F.col("state") == "OPEN", 1).otherwise(F.when(F.col("old_state") == "OPEN", -1).otherwise(0))
    deltas = states.filter("changed").groupBy("run_id", "rule_key").agg(F.sum(change).alias("delta"))
    grid = published.select(*rules.SCOPE, "run_no", "run_id", F.explode(F.array(*[F.lit(k) for k in rules.registry()])).alias("rule_key"))
    w = Window.partitionBy(*rules.SCOPE, "rule_key").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(deltas, ["run_id", "rule_key"], "left").select("run_id", "rule_key", F.sum(F.coalesce("delta", F.lit(0))).over(w).alias("open"))


def muted_counts(published: DataFrame, states: DataFrame, suppressed: DataFrame) -> DataFrame:
    """run_id, rule_key, muted: open issues that are suppressed when the run is published (until not before that time).

    Only the state changes of suppressed issues are read: each holds from its run to the next one's.
    """
    own = [*rules.SCOPE, "page_id", "rule_key"]
    hit = states.filter("changed").join(suppressed, ["project_id", "page_id", "rule_key"])
    until_run = F.lead("run_no").over(Window.partitionBy(*own).orderBy("run_no"))
    held = hit.select(*own, "state", F.col("run_no").alias("from_run"), until_run.alias("to_run"), "suppressed_until").filter("state = 'OPEN'")
    runs = published.select(*rules.SCOPE, "run_no", "run_id", "finished_at")
    seen = (F.col("run_no") >= F.col("from_run")) & (F.col("to_run").isNull() | (F.col("run_no") < F.col("to_run")))
    both = held.join(runs, list(rules.SCOPE)).filter(seen & (F.col("suppressed_until") >= F.col("finished_at")))
    return both.groupBy("run_id", "rule_key").agg(F.count(F.lit(1)).alias("muted"))


def publish(observations: DataFrame, suppressed: DataFrame | None = None) -> Publication:
    """All published runs. suppressed: project_id, page_id, rule_key, suppressed_until, one row per suppressed issue; these
    are left out of open counts and score while they last."""
    observations = scoped(observations)
    runs = run_table(observations)
    published = runs.filter("completeness = 'FULL'")
    current = observations.join(published.select("run_id", "base_run_id"), "run_id")
    events = diff.observation_diff(current, observations)
    verdicts = rules.evaluate(rules.rule_input(current), keys=("project_id", "policy_id", "scope_generation", "rule_version", "run_id", "run_no", "page_id"))
    states = rules.history(verdicts)
    return Publication(runs, events, verdicts, states, summarise(runs, events, states, suppressed))


def summarise(runs: DataFrame, events: DataFrame, states: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """One row per published run, from the publication's tables."""
    published = runs.filter("completeness = 'FULL'")
    changes = diff.summarize(events, "run_id")
    opened = open_counts(published, states)
    if suppressed is not None:
        muted = muted_counts(published, states, suppressed)
        opened = opened.join(muted, ["run_id", "rule_key"], "left").select("run_id", "rule_key", (F.col("open") - F.coalesce("muted", F.lit(0))).alias("open"))
    by_rule = opened.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rule_key", F.col("open").cast("double").alias("open")))).alias("open_by_rule"), F.sum("open").alias("issues_open")
    )
    resolved = states.filter("changed and state = 'RESOLVED' and old_state = 'OPEN'").groupBy("run_id").agg(F.count(F.lit(1)).alias("issues_resolved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = published.join(changes, "run_id", "left").join(by_rule, "run_id", "left").join(resolved, "run_id", "left")
    scored = health(joined, "http_count", "observed", "open_by_rule")
    return scored.select(
        "project_id", "run_id", "run_no", "policy_id", "finished_at", F.when(F.col("base_run_id").isNull(), "BASELINE").otherwise("DIFF").alias("comparison_mode"), "base_run_id",
        F.col("http_count").alias("urls_crawled"), *map(zero, ("total", "critical", "warning", "info", "affected_pages", "issues_open", "issues_resolved")),
        F.col("score").alias("health_score"), F.col("score_version").cast("bigint").alias("health_score_version"), F.col("coverage").alias("health_coverage"), "reason", "components",
    )


def publish_gate(runs: DataFrame) -> DataFrame:
    """Adds decision to requests with status, cancel_requested, published, same_project, token_matches: REPLAY for a published run, else the first refusal, else PUBLISH."""
    return runs.withColumn(
        "decision",
        F.when(~F.col("same_project"), "NOT_FOUND").when(F.col("published"), "REPLAY").when(F.col("status") != "FINALIZING", "NOT_FINALIZING")
        .when(F.col("cancel_requested"), "CANCEL_REQUESTED").when(~F.col("token_matches"), "LEASE_LOST").otherwise("PUBLISH"),
    )
