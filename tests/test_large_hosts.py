"""Hosts of more pages than a run's budgets, and runs of many redirects."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import runs
from tidewatch.plans.catalogue import QUERIES
from tidewatch.plans.oracles import ORACLES
from tidewatch.streaming.visits import visit


def made(spark, folder, n):
    """A host of n pages, every tenth in /en/."""
    page = F.concat(F.lit("<title>t"), "page_id", F.lit("</title>"))
    rows = spark.range(n).select((F.col("id") + 1).alias("page_id")).select("page_id", F.concat(F.lit("https://large.example.com/"), F.when(F.col("page_id") % 10 == 0, "en/").otherwise(""), "page_id").alias("url"), page.alias("html"))
    rows.coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def equals(df, sql, folder):
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    own, there = c.sql(sql), sorted(map(str, (tuple(r) for r in df.collect())))
    return df.columns == own.columns and there == sorted(map(str, own.fetchall()))


def test_crawl_run_sees_every_page_of_a_host_beyond_the_budgets(spark, tmp_path):
    folder = made(spark, tmp_path, 7500)
    assert equals(QUERIES["crawl_run"](spark, folder), ORACLES["crawl_run"], folder)


def test_crawl_visits_sees_every_page_of_a_host_beyond_the_budgets(spark, tmp_path):
    folder = made(spark, tmp_path, 5200)
    assert equals(runs.QUERIES["crawl_visits"](spark, folder), runs.ORACLES["crawl_visits"], folder)


@pytest.mark.parametrize("n", [60])
def test_redirects_cost_no_batch_each(spark, tmp_path, n):
    home = "https://h.example.com"
    moved = [(f"{home}/a{i}", 301, f"/b{i}", None) for i in range(n)] + [(f"{home}/b{i}", 200, None, "<title>b</title>") for i in range(n)]
    answers = spark.createDataFrame([*moved, (f"{home}/robots.txt", 200, None, "User-agent: *\n")], "url string, status int, location string, body string")
    hosts = spark.createDataFrame([("h.example.com",)], "host string")
    pages = spark.createDataFrame([("h.example.com", f"{home}/a{i}") for i in range(n)], "host string, url string")
    seen, ends = visit(hosts, pages, answers, str(tmp_path))
    got = seen.select("url", "depth", "chain").collect()
    assert sorted(r.url for r in got if r.chain == 0 and "/b" in r.url) == sorted(f"{home}/b{i}" for i in range(n))
    assert len(got) == len({r.url for r in got}) == 2 * n + 1 and {r.depth for r in got} == {0}
    assert ends.select("pages").collect() == [(2 * n + 1,)]
    assert len(os.listdir(f"{tmp_path}/steps")) <= 4
