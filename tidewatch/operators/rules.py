"""Issue rules with three-valued verdicts, and the issue life cycle over runs.

A rule is one entry of registry(): key, verdict and evidence as Columns over an observation. UNKNOWN is a value of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE_VERSION = 1
PRESENT, ABSENT, UNKNOWN = "PRESENT", "ABSENT", "UNKNOWN"
_NO_MAP = "map<string,string>"


def evidence(key: str, value: Column, *more: tuple[str, Column]) -> Column:
    pairs = [x for k, v in ((key, value), *more) for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return F.create_map(*pairs)


def valid(field: str) -> Column:
    return F.coalesce(F.col("field_validity")[field], F.lit("UNKNOWN"))


def _http() -> tuple[Column, Column]:
    s = F.col("final_status")
    unsure = (F.col("fetch_outcome") != "HTTP_RESPONSE") | s.isNull()
    return (
        F.when(unsure, UNKNOWN).when(s.isin(404, 410) | (s >= 500), PRESENT).otherwise(ABSENT),
        F.when(unsure, evidence("fetchOutcome", F.col("fetch_outcome"))).otherwise(evidence("status", s)),
    )


def _noindex() -> tuple[Column, Column]:
    r = F.col("robots")
    invalid, silent = valid("robots") != "KNOWN", (F.col("fetch_outcome") != "HTTP_RESPONSE") | r.isNull() | (r["index"] == "UNKNOWN")
    return (
        F.when(invalid | silent, UNKNOWN).when(r["index"] == "DISALLOWED", PRESENT).otherwise(ABSENT),
        F.when(invalid, evidence("fieldValidity", valid("robots"))).when(silent, evidence("fetchOutcome", F.col("fetch_outcome"))).otherwise(evidence("robots", F.array_join(r["raw"], ", "))),
    )


def _title() -> tuple[Column, Column]:
    t, invalid = F.col("title"), valid("title") != "KNOWN"
    return F.when(invalid, UNKNOWN).when(t.isNull() | (t == ""), PRESENT).otherwise(ABSENT), F.when(invalid, evidence("fieldValidity", valid("title"))).otherwise(evidence("title", t))


def _canonical() -> tuple[Column, Column]:
    c = F.col("canonical")
    raw, resolved = c["raw"], c["resolved"]
    unsure = (valid("canonical") != "KNOWN") | c.isNull()
    shown = F.array_join(raw, ", ")
    invalid, conflict, none = F.size(resolved) < F.size(raw), F.size(F.array_distinct(resolved)) > 1, F.size(raw) == 0
    return (
        F.when(unsure, UNKNOWN).when(none, ABSENT).when(invalid | conflict, PRESENT).otherwise(ABSENT),
        F.when(unsure, evidence("fieldValidity", valid("canonical"))).when(none, evidence("canonicalCount", F.lit(0)))
        .when(invalid, evidence("problem", F.lit("invalid"), ("raw", shown))).when(conflict, evidence("problem", F.lit("conflict"), ("raw", shown)))
        .otherwise(evidence("canonical", F.get(resolved, F.lit(0)))),
    )


def registry() -> dict[str, tuple[Column, Column]]:
    """All rules by key; adding one is adding an entry."""
    return {"http_4xx_5xx": _http(), "noindex_on_indexable": _noindex(), "missing_title": _title(), "canonical_conflict": _canonical()}


def rule_input(observations: DataFrame) -> DataFrame:
    """As the publication feeds the rules: the final status is the initial one."""
    return observations.withColumn("final_status", F.col("initial_status"))


def evaluate(observations: DataFrame, keys: tuple[str, ...] = ("project_id", "run_id", "run_no", "page_id"), only: tuple[str, ...] | None = None) -> DataFrame:
    """keys, rule_key, verdict, evidence (map): all rules in one projection, exploded."""
    rows = [F.struct(F.lit(k).alias("rule_key"), v.alias("verdict"), e.cast(_NO_MAP).alias("evidence")) for k, (v, e) in registry().items() if only is None or k in only]
    return observations.select(*keys, F.inline(F.array(*rows)))


def next_state(current: Column, verdict: Column) -> Column:
    """The state after a verdict; null: no issue."""
    return F.when(verdict == PRESENT, "OPEN").when((verdict == ABSENT) & current.isNotNull(), "RESOLVED").otherwise(current)


def reopens(current: Column, verdict: Column) -> Column:
    return F.coalesce((current == "RESOLVED") & (verdict == PRESENT), F.lit(False))


def step(verdicts: DataFrame, issues: DataFrame, keys: tuple[str, ...] = ("page_id", "rule_key")) -> DataFrame:
    """One run's verdicts against the present issues (state, occurrence): keys, old_state, new_state, occurrence, changed."""
    both = verdicts.join(issues.select(*keys, F.col("state").alias("old_state"), F.col("occurrence").alias("__o")), list(keys), "left")
    new = next_state(F.col("old_state"), F.col("verdict"))
    out = both.select(
        *keys, "verdict", "old_state", new.alias("new_state"),
        F.when(new.isNotNull(), F.coalesce("__o", F.lit(0)) + F.when(F.col("old_state").isNull() | reopens(F.col("old_state"), F.col("verdict")), 1).otherwise(0)).alias("occurrence"),
    )
    return out.withColumn("changed", ~F.col("old_state").eqNullSafe(F.col("new_state")))


def stale(issues: DataFrame, evaluated_pages: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Issues of pages that this run did not observe: only their last evaluation is touched."""
    return issues.join(evaluated_pages.select(*keys).distinct(), list(keys), "left_anti")


#: What an issue belongs to: a new policy that keeps scope and rules goes on with its issues.
SCOPE = ("project_id", "scope_generation", "rule_version")


def history(verdicts: DataFrame, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """State of every issue after every published run that observed its page, from the verdicts alone.

    verdicts: scope, run_no, page_id, rule_key, verdict, of published runs. UNKNOWN keeps the state, so it is the last
    decisive verdict up to the run; nothing exists before the first PRESENT. One window per (scope, page, rule).
    """
    w = Window.partitionBy(*scope, "page_id", "rule_key").orderBy("run_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    decisive = F.when(F.col("verdict") != UNKNOWN, F.col("verdict"))
    began = F.max(F.when(F.col("verdict") == PRESENT, 1).otherwise(0)).over(upto) == 1
    last = F.last(decisive, ignorenulls=True).over(upto)
    state = F.when(began, F.when(last == PRESENT, "OPEN").otherwise("RESOLVED"))
    one = verdicts.withColumn("state", state)
    two = one.withColumn("old_state", F.lag("state").over(w))
    opened = F.when((F.col("state") == "OPEN") & ~F.col("old_state").eqNullSafe(F.lit("OPEN")), 1).otherwise(0)
    return two.withColumn("occurrence", F.sum(opened).over(upto)).filter(F.col("state").isNotNull()).withColumn("changed", ~F.col("old_state").eqNullSafe(F.col("state")))


def transitions(states: DataFrame) -> DataFrame:
    """The append-only list of state changes with their idempotency keys."""
    issue = F.concat_ws(":", "page_id", "rule_key")
    key = F.when(F.col("old_state").isNull(), F.concat_ws(":", "run_id", "page_id", "rule_key", F.lit("open"))).otherwise(F.concat_ws(":", F.col("run_id"), issue, F.col("state")))
    return states.filter("changed").select("project_id", "run_id", "page_id", "rule_key", F.col("old_state").alias("from_state"), F.col("state").alias("to_state"), key.alias("idempotency_key"))
