"""Crawl frontier: seeds, breadth-first discovery with budgets, sitemap walk, redirects, fetch outcomes.

Breadth-first search is a driver loop over levels; each level is one anti-join and one join, written out before the next,
so lineage does not grow. Levels are few (a depth budget), and the driver sees only whether a level is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.sources.tables import stored

# Order of seed sources; sitemap budgets; redirects.
SOURCES = ("ENTRY", "MONITORED", "SITEMAP", "LINK")
SITEMAP_DEPTH, SITEMAP_DOCUMENTS, SITEMAP_URLS = 3, 20, 20_000
REDIRECTS, MAX_HOPS = (301, 302, 303, 307, 308), 5


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder."""
    return stored(df)


def seeds(entry: DataFrame, monitored: DataFrame, sitemap: DataFrame, keys: tuple[str, ...] = ("run_id", "url_key")) -> DataFrame:
    """Union of the seed sources, one row per key, the first source wins; depth 0."""
    parts = [df.withColumn("source", F.lit(s)).withColumn("__o", F.lit(i)) for i, (s, df) in enumerate(zip(SOURCES, (entry, monitored, sitemap), strict=False))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("__o"))
    return every.withColumn("__n", n).filter("__n = 1").drop("__n", "__o").withColumn("depth", F.lit(0))


def new_candidates(candidates: DataFrame, frontier: DataFrame, keys: tuple[str, ...] = ("run_id", "url_key")) -> DataFrame:
    return candidates.join(frontier.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def next_due(frontier: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The pending rows to fetch next: shallow ones first, then by key."""
    due = (F.col("state") == "PENDING") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    return frontier.filter(due).orderBy("depth", "url_key").limit(n)


def fetch_order(frontier: DataFrame, *scope: str) -> DataFrame:
    return frontier.withColumn("fetch_order", F.row_number().over(Window.partitionBy(*scope).orderBy("depth", "url_key")))


def within_budget(frontier: DataFrame, scope: tuple[str, ...], pages: int, body_bytes: int | None = None, size: str = "bytes") -> DataFrame:
    """Rows fetched before a budget stops the run: the first `pages` in fetch order, up to the row that passes body_bytes."""
    w = Window.partitionBy(*scope).orderBy("depth", "url_key")
    rows = frontier.withColumn("__n", F.row_number().over(w))
    keep = F.col("__n") <= pages
    if body_bytes is not None:
        rows = rows.withColumn("__b", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        keep &= F.col("__b") <= body_bytes
    return rows.filter(keep).drop("__n", "__b")


def breadth_first(start: DataFrame, links: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """scope, node, depth of everything reached from start (scope, node) over links (scope, source, target) within depth.

    With limit, a scope keeps its first nodes in (depth, node) order.
    """
    level = start.select("scope", "node", F.lit(0).alias("depth")).dropDuplicates(["scope", "node"])
    reached = level = kept(level)
    for d in range(1, depth + 1):
        on = (level["scope"] == links["scope"]) & (level["node"] == links["source"])
        found = level.join(links, on).select(level["scope"], F.col("target").alias("node")).distinct()
        level = kept(found.join(reached, ["scope", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    if limit is not None:
        n = F.row_number().over(Window.partitionBy("scope").orderBy("depth", "node"))
        reached = reached.withColumn("__n", n).filter(F.col("__n") <= limit).drop("__n")
    return reached


def sitemap_walk(roots: DataFrame, documents: DataFrame, depth: int = SITEMAP_DEPTH, max_documents: int = SITEMAP_DOCUMENTS, max_urls: int = SITEMAP_URLS) -> tuple[DataFrame, DataFrame]:
    """(urls: scope, url; state: scope, documents, truncated). roots: scope, root and, where it is not the root's, host, and
    pos where a scope has several; documents: url, kind, urls.

    A scope fetches documents in (level, position) order until max_documents (the root counts) and takes URLs in the order
    of those documents until max_urls. The root is level 0 and level `depth` is the last one opened. Documents and URLs of
    other hosts are passed over and use up no budget. Anything else left out sets truncated.
    """
    at_home = lambda url: (urls.host_of(url) == F.col("host")) & ((F.col("host") == "") | url.rlike("(?i)^https?://"))
    host = F.lower("host") if "host" in roots.columns else urls.host_of(F.col("root"))
    level = roots.select("scope", F.col("root").alias("url"), F.array(F.col("pos") if "pos" in roots.columns else F.lit(0)).alias("place"), host.alias("host")).filter(at_home(F.col("url")))
    fetched = None
    cut = roots.select("scope", F.lit(False).alias("cut")).limit(0)
    for d in range(depth + 1):
        seen = None if fetched is None else fetched.select("scope", "url")
        fresh = level.dropDuplicates(["scope", "url"]) if seen is None else level.dropDuplicates(["scope", "url"]).join(seen, ["scope", "url"], "left_anti")
        used = None if fetched is None else fetched.groupBy("scope").agg(F.count(F.lit(1)).alias("__used"))
        ranked = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("scope").orderBy("place")))
        ranked = ranked.withColumn("__used", F.lit(0)) if used is None else ranked.join(used, "scope", "left").fillna(0, ["__used"])
        open_ = F.col("__n") + F.col("__used") <= max_documents
        cut = cut.union(ranked.filter(~open_).select("scope", F.lit(True)))
        got = kept(ranked.filter(open_).select("scope", "url", "place", "host").join(documents, "url", "left").withColumn("level", F.lit(d)))
        fetched = got if fetched is None else fetched.unionByName(got)
        under = got.filter("kind = 'INDEX'").select("scope", "place", "host", F.posexplode("urls").alias("i", "url")).filter(at_home(F.col("url")))
        level = under.select("scope", "url", F.concat("place", F.array("i")).alias("place"), "host")
    cut = cut.union(level.join(fetched.select("scope", "url"), ["scope", "url"], "left_anti").select("scope", F.lit(True)))
    locs = fetched.filter("kind = 'URLSET'").select("scope", "level", "place", "host", F.posexplode("urls").alias("i", "loc")).filter(at_home(F.col("loc")))
    locs = locs.withColumn("loc", F.coalesce(urls.same_host_identity(F.col("loc"), F.col("host")), "loc"))
    first = locs.withColumn("__d", F.row_number().over(Window.partitionBy("scope", "loc").orderBy("level", "place", "i"))).filter("__d = 1")
    placed = first.withColumn("__n", F.row_number().over(Window.partitionBy("scope").orderBy("level", "place", "i")))
    cut = cut.union(placed.filter(F.col("__n") > max_urls).select("scope", F.lit(True)))
    n = fetched.groupBy("scope").agg(F.count(F.lit(1)).alias("documents"))
    state = n.join(cut.groupBy("scope").agg(F.bool_or("cut").alias("truncated")), "scope", "left").fillna(False, ["truncated"])
    return placed.filter(F.col("__n") <= max_urls).select("scope", F.col("loc").alias("url")), state


def redirect_walk(starts: DataFrame, hops: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Follows redirects: start, initial_status, final_status, final_url, chain (number of redirects), outcome.

    starts: start (same as url); hops: url, status, location, host_class (of the host's addresses), one row per URL.
    A hop to another host or to an address that is not public ends the walk; the redirect is counted before the limit is tested.
    """
    host = lambda u: F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1)
    live = starts.select("start", F.col("start").alias("url"), F.lit(None).cast("int").alias("initial_status"), F.lit(None).cast("int").alias("seen_status"), F.lit(0).alias("chain"))
    ended = []
    for _ in range(max_hops + 1):
        at = live.join(hops, "url", "left")
        fetched = F.col("status").isNotNull()
        moved = F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull()
        lost = F.when(host(F.col("url")) != host(F.col("start")), F.when(F.col("chain") == 0, "SCOPE_BLOCKED").otherwise("REDIRECT_BLOCKED"))
        lost = lost.when(F.col("host_class") == "NONE", "NETWORK_ERROR").when(F.col("host_class") != "PUBLIC", "SECURITY_BLOCKED").when(~fetched, "NETWORK_ERROR")
        outcome = lost.when(~moved, "HTTP_RESPONSE").when(F.col("chain") + 1 > max_hops, "REDIRECT_LIMIT")
        took = F.coalesce(outcome.isin("HTTP_RESPONSE", "REDIRECT_LIMIT"), F.lit(True))
        walked = at.select(
            "start", "url", "location", outcome.alias("outcome"), F.coalesce("initial_status", F.when(took, F.col("status"))).alias("initial_status"),
            F.when(took, F.col("status")).otherwise(F.col("seen_status")).alias("seen_status"), (F.col("chain") + F.when(took & moved, 1).otherwise(0)).alias("chain"),
        )
        walked = kept(walked)
        ended.append(walked.filter("outcome is not null"))
        live = walked.filter("outcome is null").select("start", F.col("location").alias("url"), "initial_status", "seen_status", "chain")
        if live.isEmpty():
            break
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.select("start", "initial_status", F.col("seen_status").alias("final_status"), F.when(F.col("outcome") == "HTTP_RESPONSE", F.col("url")).alias("final_url"), "chain", "outcome")


def capped(outcome: Column, body: Column, cap: int) -> Column:
    """The outcome once the body is read: one over the cap has none."""
    return F.when((outcome == "HTTP_RESPONSE") & (F.octet_length(body) > cap), "BODY_TOO_LARGE").otherwise(outcome)


def paced(frontier: DataFrame, scope: str = "run_id", interval_ms: int = 1000) -> DataFrame:
    """Earliest start of each fetch, in ms after the run's: one request per interval and host."""
    return frontier.withColumn("start_ms", (F.row_number().over(Window.partitionBy(scope).orderBy("depth", "url_key")) - 1) * interval_ms)


def earliest_retry(frontier: DataFrame) -> DataFrame:
    """When the next pending row of each run may be tried again."""
    return frontier.filter("state = 'PENDING' and next_attempt_at is not null").groupBy("run_id").agg(F.min("next_attempt_at").alias("next_attempt_at"))


def state_counts(frontier: DataFrame) -> DataFrame:
    """Rows of each run's frontier by state."""
    return frontier.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("PENDING", "FETCHING", "DONE", "FAILED")])
