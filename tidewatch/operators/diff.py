"""Changes between two states of pages: by snapshot (URL keyed) and by observation (page keyed, gated by validity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE_TYPES = (
    "URL_ADDED", "URL_REMOVED", "HTTP_STATUS_CHANGED", "ROBOTS_CHANGED", "CANONICAL_CHANGED", "TITLE_CHANGED", "META_DESCRIPTION_CHANGED", "INTERNAL_LINKS_CHANGED",
)
SEVERITIES = ("CRITICAL", "WARNING", "INFO")


def event(kind: str, severity: Column | str, before: Column, after: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("change_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        before.cast("string").alias("before"), after.cast("string").alias("after"),
    )


def ok(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def last_of(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """Of rows with one key the last by order; rows are taken as unique where no order is given."""
    if order is None:
        return df
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("__n = 1").drop("__n")


def snapshot_diff(previous: DataFrame, current: DataFrame, order: str | None = None) -> DataFrame:
    """url, change_type, severity, before, after. One full outer join on url; every field compares null-safely, without a gate."""
    fields = ("status_code", "robots", "canonical", "title", "meta_description", "internal_links_count")
    a = last_of(previous, "url", order).select("url", F.struct(*fields).alias("a"))
    b = last_of(current, "url", order).select("url", F.struct(*fields).alias("b"))
    both = a.join(b, "url", "full")
    was, now = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    http = F.when(ok(was("status_code")) & ((now("status_code") == 404) | (now("status_code") >= 500)), "CRITICAL").otherwise("INFO")
    robots = F.when(was("robots").eqNullSafe("index") & now("robots").eqNullSafe("noindex"), "CRITICAL").otherwise("INFO")
    differs = lambda f: there & ~was(f).eqNullSafe(now(f))
    events = F.array(
        F.when(F.col("a").isNull(), event("URL_ADDED", "INFO", F.lit(None), F.col("url"))),
        F.when(differs("status_code"), event("HTTP_STATUS_CHANGED", http, was("status_code"), now("status_code"))),
        F.when(differs("robots"), event("ROBOTS_CHANGED", robots, was("robots"), now("robots"))),
        *(
            F.when(differs(f), event(kind, severity, was(f), now(f)))
            for kind, f, severity in (
                ("CANONICAL_CHANGED", "canonical", "WARNING"), ("TITLE_CHANGED", "title", "WARNING"),
                ("META_DESCRIPTION_CHANGED", "meta_description", "WARNING"), ("INTERNAL_LINKS_CHANGED", "internal_links_count", "INFO"),
            )
        ),
        F.when(F.col("b").isNull(), event("URL_REMOVED", "INFO", F.col("url"), F.lit(None))),
    )
    return both.select("url", F.inline(F.filter(events, lambda e: e.isNotNull())))


def canonical_value(resolved: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(resolved)), " ")


#: What an observation is compared by.
COMPARED = ("fetch_outcome", "initial_status", "robots", "title", "meta_description", "canonical", "internal_links_count", "field_validity")


def comparable(side: str) -> dict[str, Column]:
    """Fields of one side of the joined observations."""
    c = lambda f: F.col(f"{side}.{f}")
    return {
        "outcome": c("fetch_outcome"), "status": c("initial_status"), "robots": c("robots.index"), "title": c("title"), "metaDescription": c("meta_description"),
        "canonical": F.when(c("canonical").isNotNull(), canonical_value(c("canonical.resolved"))), "internalLinksCount": c("internal_links_count"), "validity": c("field_validity"),
    }


def observation_diff(current: DataFrame, base: DataFrame, base_run: str = "base_run_id", keys: tuple[str, ...] = ("project_id", "run_id", "run_no")) -> DataFrame:
    """keys, page_id, change_type, severity, before, after.

    current carries the id of the run to compare with (null: none). One left join on (run, page); the field comparisons are
    one projection whose events are exploded, so the observations are read once per side. Never reports removed pages.
    """
    c = current.select(*keys, "page_id", "identity_url", base_run, F.struct(*COMPARED).alias("now"))
    b = base.select(F.col("run_id").alias("__run"), F.col("page_id").alias("__page"), F.struct(*COMPARED).alias("was"))
    both = c.join(b, (F.col(base_run) == F.col("__run")) & (F.col("page_id") == F.col("__page")), "left")
    x, y = comparable("was"), comparable("now")
    known = lambda f: F.coalesce(x["validity"][f] == "KNOWN", F.lit(False)) & F.coalesce(y["validity"][f] == "KNOWN", F.lit(False))
    met = F.col("was").isNotNull()
    differs = lambda f: met & known(f) & ~x[f].eqNullSafe(y[f])
    answered = (x["outcome"] == "HTTP_RESPONSE") & (y["outcome"] == "HTTP_RESPONSE")
    http = F.when(ok(x["status"]) & (y["status"].isin(404, 410) | (y["status"] >= 500)), "CRITICAL").otherwise("INFO")
    events = F.array(
        F.when(~met & F.col(base_run).isNotNull(), event("URL_ADDED", "INFO", F.lit(None), F.col("identity_url"))),
        F.when(met & answered & ~x["status"].eqNullSafe(y["status"]), event("HTTP_STATUS_CHANGED", http, x["status"], y["status"])),
        F.when(differs("robots"), event("ROBOTS_CHANGED", F.when(y["robots"].eqNullSafe("DISALLOWED"), "CRITICAL").otherwise("INFO"), x["robots"], y["robots"])),
        *(
            F.when(differs(f), event(kind, severity, x[f], y[f]))
            for kind, f, severity in (
                ("TITLE_CHANGED", "title", "WARNING"), ("META_DESCRIPTION_CHANGED", "metaDescription", "WARNING"),
                ("CANONICAL_CHANGED", "canonical", "WARNING"), ("INTERNAL_LINKS_CHANGED", "internalLinksCount", "INFO"),
            )
        ),
    )
    return both.select(*keys, "page_id", F.inline(F.filter(events, lambda e: e.isNotNull())))


def summarize(events: DataFrame, *keys: str, page: str | None = "page_id") -> DataFrame:
    """keys, total, critical, warning, info and, with page, affected_pages (exact)."""
    counts = [F.count(F.lit(1)).alias("total")] + [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return events.groupBy(*keys).agg(*counts, *([F.countDistinct(page).alias("affected_pages")] if page else []))


def by_type(events: DataFrame, *keys: str) -> DataFrame:
    """keys and by_type, a map from change type to count."""
    n = events.groupBy(*keys, "change_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("change_type", "n")))).alias("by_type"))
