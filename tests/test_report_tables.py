"""Reports over bucketed tables: no exchange, one bucket for one project, a changed source is seen."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import reports
from tidewatch.plans import stored
from tidewatch.plans.catalogue import QUERIES
from tidewatch.sources.tables import bucketed

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["report_changes", "report_issues", "report_pages"])
def test_reports_without_an_exchange(spark, no_broadcast, name):
    p = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in p and "Bucketed: true" in p


def test_one_project_reads_one_bucket(spark):
    p = stored.publication(spark, SF)
    one = p.events.first().project_id
    found = reports.changes(p.events.filter(F.col("project_id") == one), stored.pages(spark, SF).filter(F.col("project_id") == one), p.summary.filter(F.col("project_id") == one))
    assert set(re.findall(r"SelectedBucketsCount: (\d+) out of", plan(found))) == {"1"}
    assert {r.project_id for r in found.collect()} <= {one}


def test_buckets_hold_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.create_map(F.lit("a"), F.col("id")).alias("m")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    t = bucketed(df, "k", 3)
    assert sorted((r.k or 0, r.id, r.m["a"]) for r in t.collect()) == sorted((i % 7, i, i) for i in range(1000))
    assert bucketed(df.limit(0), "k", 3).count() == 0


def test_pages_that_change_are_seen(spark, tmp_path):
    there = f"{tmp_path}/sf"
    shutil.copytree(SF, there)
    n = stored.observations(spark, there).select("page_id").distinct().count()
    rows = spark.read.parquet(f"{SF}/pages.parquet").limit(3).collect()
    shutil.rmtree(f"{there}/pages.parquet") if (tmp_path / "sf/pages.parquet").is_dir() else (tmp_path / "sf/pages.parquet").unlink()
    spark.createDataFrame(rows).write.parquet(f"{there}/pages.parquet")
    assert stored.observations(spark, there).select("page_id").distinct().count() <= 3 < n
