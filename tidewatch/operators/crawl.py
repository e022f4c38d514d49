"""The crawl loop over a table of responses: claim, robots, fetch, observe, discover, level by level.

A level of the frontier is one anti-join with what was seen, one robots decision and one join with the responses; its
observations and links come from one extraction. Levels are written out (see frontier.kept) and follow each other until one
is empty; budgets cut a level in (depth, key) order, so a run stops where the loop over single URLs would.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import html, robots, urls
from tidewatch.operators.frontier import kept
from tidewatch.sources.responses import RUN_CAP

# Budgets of a run (pages, frontier, duration at one request per interval), fetches of a lost URL, longest URL.
MAX_PAGES, MAX_FRONTIER, MAX_MS, INTERVAL_MS, TRIES, MAX_URL = 5000, 20_000, 120 * 60_000, 1000, 3, 8192
#: Budgets of a run that ends with its frontier alone, however large its host is.
NO_BUDGETS = dict.fromkeys(("max_pages", "body_bytes", "max_frontier", "max_ms"), 1 << 60)


def observe(fetched: DataFrame) -> DataFrame:
    """Observations of fetched rows (run_id, url, depth, outcome, status, content_type, x_robots_tag, redirects, body): every
    field known on eligible pages, not applicable on other answers, unknown elsewhere."""
    page = html.eligible(F.col("content_type"), F.col("status"), F.col("redirects"), F.col("body")) & (F.col("outcome") == "HTTP_RESPONSE")
    facts = fetched.withColumn("__page", F.coalesce(page, F.lit(False))).withColumn("__f", html.page_facts(F.when(F.col("__page"), F.col("body")), "url"))
    known = lambda c: F.when(F.col("__page"), c)
    f = lambda name: F.col(f"__f.{name}")
    return facts.select(
        "run_id", "url", urls.url_key(F.col("url")).alias("url_key"), "depth", F.col("outcome").alias("fetch_outcome"), F.col("status").alias("initial_status"),
        known(f("title")).alias("title"), known(f("meta_description")).alias("meta_description"),
        known(F.struct(f("canonical_raw").alias("raw"), f("canonical_resolved").alias("resolved"))).alias("canonical"),
        known(F.struct(f("robots_meta").alias("raw"), html.page_index_state(f("robots_meta"), F.col("x_robots_tag")).alias("index"))).alias("robots"),
        known(f("internal_links_count")).alias("internal_links_count"), html.validity(F.col("outcome"), F.col("__page")).alias("field_validity"),
        F.when(F.col("__page"), f("internal_links")).alias("links"), F.octet_length("body").alias("bytes"),
    )


def crawl(
    seeds: DataFrame, responses: DataFrame, rules: DataFrame, max_depth: int | None = None, max_pages: int = MAX_PAGES, body_bytes: int = RUN_CAP, max_frontier: int = MAX_FRONTIER, max_ms: int = MAX_MS, interval_ms: int = INTERVAL_MS
) -> tuple[DataFrame, DataFrame]:
    """(observations, state) of runs over their frontiers. seeds: run_id, url; rules: host, rule_path, allow of robots.txt.

    A run ends with an empty frontier or at a budget: observations, bytes of bodies, or time (one request per interval, TRIES
    of them for a URL without an answer; answers themselves take no time). The frontier admits URLs in the order in which
    they are found until it is full. Without max_depth discovery goes as deep as links lead.
    state: run_id, observed, limit_reached (URLs were left or not admitted), body_budget_exceeded.
    """
    by_key = Window.partitionBy("run_id").orderBy("url_key")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept(responses.select("url", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("size"), F.col("status").isNotNull().alias("answered")))
    found = seeds.select("run_id", "url", F.struct(urls.url_key(F.col("url")).alias("key"), F.lit(0).alias("i")).alias("place"))
    seen = done = tally = None
    stopped = []
    for depth in count():
        fresh = found.filter(F.length("url") <= MAX_URL).groupBy("run_id", "url").agg(F.min("place").alias("place"))
        fresh = fresh if seen is None else fresh.join(seen, ["run_id", "url"], "left_anti")
        ranked = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("run_id").orderBy("place", "url")))
        ranked = ranked.withColumns({c: F.lit(0) for c in ("frontier", "pages", "bytes", "tries")}) if tally is None else ranked.join(tally, "run_id")
        at = ranked.withColumns({"admitted": F.col("__n") + F.col("frontier") <= max_frontier, "url_key": urls.url_key(F.col("url")), "host": urls.host_of(F.col("url")), "path": F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1)})
        met = robots.allowed(at, rules, "host").join(sizes, "url", "left").withColumn("lost", F.col("allowed") & ~F.coalesce("answered", F.lit(False)))
        met = met.withColumns({"size": F.when(F.col("allowed"), F.coalesce("size", F.lit(0))).otherwise(0), "cost": F.when(F.col("lost"), TRIES).otherwise(1)})
        spent = lambda c: F.coalesce(F.sum(F.when(F.col("admitted"), c)).over(before), F.lit(0))
        due = (F.col("pages") + spent(F.lit(1)) < max_pages) & (F.col("bytes") + spent(F.col("size")) < body_bytes) & ((F.col("tries") + spent(F.col("cost")) - 1) * interval_ms < max_ms)
        if max_depth is not None and depth > max_depth:
            due = F.lit(False)
        level = kept(met.withColumn("taken", F.col("admitted") & due).select("run_id", "url", "allowed", "lost", "size", "cost", "admitted", "taken"))
        if done is not None and level.isEmpty():
            break
        stopped.append(level.filter(~F.col("taken")).select("run_id").distinct())
        taken = lambda c: F.sum(F.when(F.col("taken"), c).otherwise(0))
        here = level.groupBy("run_id").agg(F.count_if("admitted").alias("frontier"), F.count_if("taken").alias("pages"), taken(F.col("size")).alias("bytes"), taken(F.col("cost")).alias("tries"))
        tally = here if tally is None else tally.unionByName(here).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("frontier", "pages", "bytes", "tries")])
        own = level.filter("admitted").select("run_id", "url")
        seen = own if seen is None else seen.unionByName(own)
        outcome = F.when(~F.col("allowed"), "ROBOTS_BLOCKED").when(F.col("lost"), "NETWORK_ERROR").otherwise("HTTP_RESPONSE")
        blank = lambda c: F.when(F.col("allowed"), F.col(c)).alias(c)
        fetched = level.filter("taken").join(responses, "url", "left").select("run_id", "url", F.lit(depth).alias("depth"), outcome.alias("outcome"), *map(blank, ("status", "content_type", "x_robots_tag", "redirects", "body")))
        rows = kept(observe(fetched))
        done = rows if done is None else done.unionByName(rows)
        if depth % 16 == 15:  # keeps the plans of long chains short
            seen, done, tally, stopped = kept(seen), kept(done), kept(tally), [kept(_union(stopped).distinct())]
        links = rows.select("run_id", F.col("url_key").alias("key"), F.posexplode("links").alias("i", "url"))
        found = links.select("run_id", "url", F.struct("key", "i").alias("place"))
    left = _union(stopped).distinct().withColumn("limit_reached", F.lit(True))
    over = (F.col("bytes") > body_bytes) | (F.col("limit_reached") & (F.col("bytes") >= body_bytes) & (F.col("pages") < max_pages))
    state = tally.join(left, "run_id", "left").fillna(False, ["limit_reached"]).select("run_id", F.col("pages").alias("observed"), "limit_reached", over.alias("body_budget_exceeded"))
    return done.drop("links"), state


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
