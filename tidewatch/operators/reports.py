"""Read models: overview, changes, issues, pages, runs; keyset pages. Every one starts from the workspace's projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.codec import clamp_page_size, encode_cursor
from tidewatch.operators.operations import TERMINAL
from tidewatch.operators.rules import SCOPE

DEFAULT_STATE = "OPEN"


def tenant(df: DataFrame, projects: DataFrame, workspace: str) -> DataFrame:
    """Rows of the workspace's projects only."""
    return df.join(projects.filter(F.col("workspace_id") == workspace).select("project_id"), "project_id", "left_semi")


def not_suppressed(until: Column, now: Column, inclusive: bool = False) -> Column:
    """Counted at publication with <, in the overview with <=."""
    return until.isNull() | ((until <= now) if inclusive else (until < now))


def keyset(created: Column, id_: Column, cursor: tuple | None) -> Column:
    """Rows behind the cursor in (created desc, id desc) order."""
    if cursor is None:
        return F.lit(True)
    at, last = (c if isinstance(c, Column) else F.lit(c) for c in cursor)
    return (created < at) | ((created == at) & (id_ < last))


def page(df: DataFrame, size: int | None, cursor: tuple | None = None, created: str = "created_at", id_: str = "id") -> DataFrame:
    """One page and has_more, next_cursor on every row. One row more than the page is read (a top-k, never a full sort)."""
    n = clamp_page_size(size)
    top = df.filter(keyset(F.col(created), F.col(id_), cursor)).orderBy(F.col(created).desc(), F.col(id_).desc()).limit(n + 1)
    w = Window.orderBy(F.col(created).desc(), F.col(id_).desc())  # over n + 1 rows at most
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shown = top.withColumn("__n", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(whole) > n).filter(F.col("__n") <= n)
    last = F.last(F.struct(created, id_)).over(whole)
    return shown.withColumn("next_cursor", F.when(F.col("has_more"), encode_cursor(last[created], last[id_]))).drop("__n")


def page_numbers(df: DataFrame, size: int, created: str, id_: str, *scope: str) -> DataFrame:
    """Page number of every row, per scope."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(F.col(created).desc(), F.col(id_).desc()))
    return df.withColumn("page_no", F.floor((n - 1) / clamp_page_size(size)))


def change_filter(severity: str | None = None, change_type: str | None = None) -> Column:
    """An unknown severity is no filter; a type filters as it is."""
    out = F.lit(True)
    if severity in ("CRITICAL", "WARNING", "INFO"):
        out &= F.col("severity") == severity
    if change_type:
        out &= F.col("change_type") == change_type
    return out


def issue_filter(state: str | None = None) -> Column:
    s = state or DEFAULT_STATE
    return F.lit(True) if s == "ALL" else F.col("state") == (s if s in ("OPEN", "RESOLVED") else DEFAULT_STATE)


def latest_published(summary: DataFrame) -> DataFrame:
    """project_id, run_id of each project's last published run."""
    return summary.groupBy("project_id").agg(F.max_by("run_id", "run_no").alias("run_id"))


def changes(events: DataFrame, pages: DataFrame, summary: DataFrame, severity: str | None = None, change_type: str | None = None) -> DataFrame:
    """Changes of each project's last published run, with the page's URL."""
    shown = events.filter(change_filter(severity, change_type)).join(latest_published(summary), ["project_id", "run_id"], "left_semi")
    return shown.join(pages.select("project_id", "page_id", "identity_url"), ["project_id", "page_id"])


def current_issues(states: DataFrame, runs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """The present row of every issue in its project's current scope: that of its current policy (policies: project_id,
    scope_generation, rule_version, one row a project; one without has no issues), by default that of its last run's policy."""
    if policies is not None:
        scope = policies.select(*SCOPE)
    else:
        scope = runs.groupBy("project_id").agg(F.max_by(F.struct("scope_generation", "rule_version"), "run_no").alias("s")).select("project_id", "s.*")
    last = states.groupBy(*SCOPE, "page_id", "rule_key").agg(
        F.max_by(F.struct("state", "occurrence", "evidence"), "run_no").alias("s"), F.max("run_no").alias("last_run_no"), F.min("run_no").alias("first_run_no")
    )
    return last.join(scope, list(SCOPE), "left_semi").select(*SCOPE, "page_id", "rule_key", "s.*", "first_run_no", "last_run_no")


def pages_report(pages: DataFrame, observations: DataFrame) -> DataFrame:
    """Every known page with what its last run saw of it."""
    seen = observations.select("project_id", "page_id", F.col("run_id").alias("last_seen_run_id"), "fetch_outcome", "initial_status", "title")
    return pages.join(seen, ["project_id", "page_id", "last_seen_run_id"], "left")


def unsuppressed(issues: DataFrame, suppressed: DataFrame, now: Column, inclusive: bool = False) -> DataFrame:
    """issues without those that are suppressed now. suppressed: project_id, page_id, rule_key, suppressed_until."""
    muted = suppressed.filter(~not_suppressed(F.col("suppressed_until"), now, inclusive))
    return issues.join(muted, ["project_id", "page_id", "rule_key"], "left_anti")


def overview(summary: DataFrame, runs: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per project: last published summary, the run under way, the last one that failed or was cancelled, known pages,
    open issues. runs: project_id, run_no, run_id, status, failure_code, pages_done, pages_known; issues: those to count."""
    last = summary.groupBy("project_id").agg(F.max_by(F.struct("run_id", "health_score", "total", "critical", "urls_crawled", "issues_open"), "run_no").alias("s"))
    active = ~F.col("status").isin(*TERMINAL)
    ended = F.col("status").isin("FAILED", "CANCELLED")
    latest = runs.groupBy("project_id").agg(
        F.max_by(F.when(active, F.struct("run_id", "status", "pages_done", "pages_known")), F.when(active, F.col("run_no"))).alias("a"),
        F.max_by(F.when(ended, F.struct("run_id", "status", "failure_code")), F.when(ended, F.col("run_no"))).alias("f"),
    )
    known = pages.groupBy("project_id").agg(F.count(F.lit(1)).alias("pages_known"))
    opened = issues.filter("state = 'OPEN'").groupBy("project_id").agg(F.count(F.lit(1)).alias("open_now"))
    out = known.join(last, "project_id", "left").join(latest, "project_id", "left").join(opened, "project_id", "left")
    return out.select(
        "project_id", "pages_known", F.col("s.run_id").alias("run_id"), F.col("s.health_score").alias("health_score"), F.col("s.total").alias("changes"), F.col("s.critical").alias("critical"),
        F.col("s.urls_crawled").alias("urls_crawled"), F.coalesce("open_now", F.lit(0)).alias("open_issues"),
        F.col("a.run_id").alias("active_run_id"), F.col("a.status").alias("active_status"), F.col("a.pages_done").alias("active_done"),
        F.col("f.run_id").alias("failed_run_id"), F.col("f.status").alias("failed_status"), F.col("f.failure_code").alias("failed_code"),
    )


#: Rows that the dashboard shows of a project.
SHOWN_CHANGES, SHOWN_ISSUES = 8, 10


def shown_first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each project: kept per task before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def display_deductions(components: DataFrame) -> DataFrame:
    return components.filter("deduction > 0")


def coverage_percent(coverage: Column) -> Column:
    return F.floor(coverage * 100 + 0.5).cast("bigint")
