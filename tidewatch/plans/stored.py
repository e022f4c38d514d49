"""Publication tables of a data set, written once per application and version of its pages: reports read them as a service
reads its tables.

The observations are derived from the pages once, then the publication from the observations; every query of the catalogue
starts from these tables, not from HTML. All are bucketed by project: reports join them without an exchange, and what is asked
of one project reads its bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import publish as publishing
from tidewatch.operators import rules
from tidewatch.sources import crawl
from tidewatch.sources.tables import bucketed, version

_TABLES: dict[tuple, DataFrame] = {}
_PUBLICATIONS: dict[tuple, publishing.Publication] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, version(spark, f"{sf_dir}/pages.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (*_key(spark, sf_dir), name)
    if key not in _TABLES:
        _TABLES[key] = bucketed(make(), "project_id")
    return _TABLES[key]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "observations", lambda: crawl.observations(spark, sf_dir))


def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "suppressions", lambda: crawl.suppressions(observations(spark, sf_dir)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known page with the first and last run that saw it."""
    seen = observations(spark, sf_dir).groupBy("project_id", "page_id", "identity_url")
    return _once(spark, sf_dir, "pages", lambda: seen.agg(F.min_by("run_id", "run_no").alias("first_seen_run_id"), F.max_by("run_id", "run_no").alias("last_seen_run_id")))


def publication(spark: SparkSession, sf_dir: str) -> publishing.Publication:
    key = _key(spark, sf_dir)
    if key in _PUBLICATIONS:
        return _PUBLICATIONS[key]
    once = partial(_once, spark, sf_dir)
    o = observations(spark, sf_dir)
    plan = publishing.publish(o)
    runs = once("runs", lambda: plan.runs)
    events, verdicts = once("events", lambda: plan.events), once("verdicts", lambda: plan.verdicts)
    states = once("states", lambda: rules.history(verdicts))
    summary = once("summary", lambda: publishing.summarise(runs, events, states, suppressions(spark, sf_dir)))
    return _PUBLICATIONS.setdefault(key, publishing.Publication(runs, events, verdicts, states, summary))
