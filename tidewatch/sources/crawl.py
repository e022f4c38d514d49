"""Crawl observations derived from the pages table: four weekly runs of every host, by plain arithmetic.

A host is a project. The formulas give every outcome, status and validity the operators tell apart; failures are gated by
host and run, so most runs stay complete. Every 13th host gets a new policy before its third run; for half of these it begins
a new scope, for the others the scope goes on. The text below is the derivation alone and is shared with the SQL oracle; what
is computed from it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import load

RUNS = 4

_OBSERVED = r"""
obs_p AS (
  SELECT page_id, {host} AS project_id, regexp_replace(url, '#.*$', '') AS identity_url, {title} AS html_title, {links} AS n_links FROM {pages}
),
obs_h AS (SELECT obs_p.*, hn FROM obs_p JOIN (SELECT {host} AS host, min(page_id) AS hn FROM {pages} GROUP BY {host}) h ON project_id = host),
obs_w AS (
  SELECT obs_h.*, CAST(run_no AS BIGINT) AS run_no, concat(project_id, '#', CAST(run_no AS {string})) AS run_id,
    concat(project_id, CASE WHEN hn % 13 = 0 AND run_no >= 3 THEN '@2' ELSE '@1' END) AS policy_id,
    CAST(CASE WHEN hn % 26 = 13 AND run_no >= 3 THEN 2 ELSE 1 END AS BIGINT) AS scope_generation, CAST(1 AS BIGINT) AS rule_version,
    CASE WHEN (hn + run_no) % 6 = 0 AND page_id % 3 = 0 THEN 'NETWORK_ERROR'
      WHEN (hn + run_no * 2) % 11 = 0 AND page_id % 4 = 1 THEN 'SECURITY_BLOCKED'
      WHEN (page_id * 7 + run_no * 3) % 40 = 0 THEN 'ROBOTS_BLOCKED' ELSE 'HTTP_RESPONSE' END AS fetch_outcome
  FROM obs_h {runs} WHERE (page_id + run_no) % 23 <> 0
),
obs_s AS (
  SELECT *, CASE WHEN fetch_outcome <> 'HTTP_RESPONSE' THEN NULL WHEN (page_id * 11 + run_no * 5) % 30 = 0 THEN 404
      WHEN (page_id * 11 + run_no * 5) % 30 = 1 THEN 410 WHEN (page_id * 11 + run_no * 5) % 30 = 2 THEN 503
      WHEN (page_id * 11 + run_no * 5) % 30 = 3 THEN 301 ELSE 200 END AS initial_status
  FROM obs_w
),
obs_v AS (
  SELECT *, CASE WHEN fetch_outcome <> 'HTTP_RESPONSE' THEN 'UNKNOWN' WHEN initial_status = 200 THEN 'KNOWN' ELSE 'NOT_APPLICABLE' END AS validity,
    (page_id * 13 + run_no) % 19 AS canonical_kind FROM obs_s
),
obs AS (
  SELECT project_id, run_no, run_id, policy_id, scope_generation, rule_version, page_id, identity_url, fetch_outcome, initial_status, validity,
    CASE WHEN validity <> 'KNOWN' OR (page_id * 3 + run_no) % 17 = 0 THEN NULL
      WHEN (page_id + run_no) % 9 = 0 THEN concat(html_title, ' v', CAST(run_no AS {string})) ELSE html_title END AS title,
    CASE WHEN validity <> 'KNOWN' OR (page_id * 2 + run_no) % 7 = 0 THEN NULL
      WHEN (page_id + run_no * 2) % 12 = 0 THEN concat('d', CAST(page_id % 5 AS {string}), ' v', CAST(run_no AS {string}))
      ELSE concat('d', CAST(page_id % 5 AS {string})) END AS meta_description,
    CASE WHEN validity <> 'KNOWN' THEN NULL ELSE canonical_kind END AS canonical_kind,
    CASE WHEN validity <> 'KNOWN' THEN NULL WHEN (page_id * 5 + run_no) % 13 = 0 THEN 'DISALLOWED' ELSE 'ALLOWED' END AS robots_index,
    CASE WHEN validity <> 'KNOWN' THEN NULL ELSE n_links + CASE WHEN page_id % 5 = 0 THEN run_no % 2 ELSE 0 END END AS internal_links_count
  FROM obs_v
)"""

SPARK = {
    "host": "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)", "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "links": "CAST(size(array_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS BIGINT)",
    "string": "STRING", "runs": "LATERAL VIEW explode(array(1, 2, 3, 4)) t AS run_no", "pages": "{pages}",
}
DUCK = {
    "host": "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)", "title": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "links": "len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))",
    "string": "VARCHAR", "runs": ", unnest([1, 2, 3, 4]) AS t(run_no)", "pages": "pages",
}
#: CTEs obs_p to obs for the oracle.
OBSERVED_SQL = _OBSERVED.format(**DUCK)
FIELDS = ("title", "metaDescription", "canonical", "robots", "internalLinksCount")
BAD_CANONICAL, OTHER_CANONICAL = "::bad::", "https://other.example/x"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per project, run and observed page, with field validity as a map and canonical, robots as structs."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    obs = spark.sql(f"WITH {_OBSERVED.format(**SPARK)} SELECT * FROM obs", pages=pages)
    kind, own = F.col("canonical_kind"), F.col("identity_url")
    none = F.array().cast("array<string>")
    raw = F.when(kind == 0, none).when(kind == 1, F.array(own, F.lit(OTHER_CANONICAL))).when(kind == 2, F.array(F.lit(BAD_CANONICAL))).otherwise(F.array(own))
    resolved = F.when((kind == 0) | (kind == 2), none).when(kind == 1, F.array(own, F.lit(OTHER_CANONICAL))).otherwise(F.array(own))
    directives = F.when(F.col("robots_index") == "DISALLOWED", F.array(F.lit("noindex"))).otherwise(none)
    validity = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array_repeat("validity", len(FIELDS)))
    return obs.select(
        "project_id", "run_no", "run_id", "policy_id", "scope_generation", "rule_version", "page_id", "identity_url", "fetch_outcome", "initial_status", "title", "meta_description", "internal_links_count",
        F.when(kind.isNotNull(), F.struct(raw.alias("raw"), resolved.alias("resolved"))).alias("canonical"),
        F.when(F.col("robots_index").isNotNull(), F.struct(directives.alias("raw"), F.col("robots_index").alias("index"))).alias("robots"),
        validity.alias("field_validity"),
        F.expr("timestamp_ntz'2026-01-05 00:00:00' + make_dt_interval(7 * cast(run_no - 1 as int))").alias("fetched_at"),
    )


def suppressions(observations: DataFrame) -> DataFrame:
    """project_id, page_id, rule_key, suppressed_until: issues that are muted for a while, by plain arithmetic."""
    pages = observations.filter("page_id % 3 = 1").select("project_id", "page_id").distinct()
    until = F.expr("timestamp_ntz'2026-01-12 00:00:00' + make_dt_interval(7 * cast(page_id % 4 as int))")
    keys = F.array(F.lit("missing_title"), F.lit("noindex_on_indexable"))
    return pages.select("project_id", "page_id", F.explode(keys).alias("rule_key"), until.alias("suppressed_until"))


def later_runs(observations: DataFrame) -> DataFrame:
    """Runs of some projects after the observed ones: ended without publication, or still going."""
    hosts = observations.groupBy("project_id").agg(F.countDistinct("page_id").alias("pages_known"))
    k = F.length("project_id") % 5
    kinds = [(0, 5, "CRAWLING", None), (1, 5, "FAILED", "LEASE_LOST"), (1, 6, "QUEUED", None), (2, 5, "FAILED", "NO_OBSERVATIONS"), (2, 6, "CANCELLED", None)]
    rows = [
        F.when(
            k == rest,
            F.struct(
                F.lit(n).cast("bigint").alias("run_no"), F.concat("project_id", F.lit(f"#{n}")).alias("run_id"), F.lit(status).alias("status"),
                F.lit(code).cast("string").alias("failure_code"), (F.col("pages_known") - 1 if status == "CRAWLING" else F.lit(0).cast("bigint")).alias("pages_done"),
            ),
        )
        for rest, n, status, code in kinds
    ]
    return hosts.select("project_id", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())), "pages_known")
