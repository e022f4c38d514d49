"""What a crawl's requests come to, as relations: tries, redirects, limits, robots.txt and sitemaps of a run's beginning.

An archive of answers has one row per URL and try: url (its identity), try (from 1; the last one stands for all later tries),
status, location, content_type, x_robots_tag, body (binary or string), error (NETWORK_ERROR, TIMEOUT or null), elapsed_ms,
host_class (of the host's addresses: PUBLIC, NONE or another). Columns but url may be absent. A URL without a row has no answer.

Redirects are followed hop by hop for all requests at once: a hop is one equi-join with the archive on (url, try), and
the walk ends as soon as no request goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import robots, sitemap, urls
from tidewatch.operators.frontier import MAX_HOPS, REDIRECTS, SITEMAP_DOCUMENTS, kept, sitemap_walk
from tidewatch.sources.responses import BODY_CAP, TIMEOUT_S

# Tries of a page, of robots.txt over https; waits before the next try.
TRIES, ROBOTS_TRIES, ROBOTS_WAIT_MS = 3, 3, 2000
LOST = ("NETWORK_ERROR", "TIMEOUT")
#: Columns of an archive: what an absent one is filled with.
_DEFAULTS = {
    "try": (1, "int"), "status": (200, "int"), "location": (None, "string"), "content_type": ("text/html", "string"), "x_robots_tag": (None, "string"),
    "body": (None, "string"), "error": (None, "string"), "elapsed_ms": (0, "int"), "host_class": ("PUBLIC", "string"),
}


def archive(answers: DataFrame, tries: int = TRIES) -> DataFrame:
    """The answer to each of the first tries of every URL, absent columns filled in."""
    every = answers.withColumns({c: F.lit(v).cast(kind) for c, (v, kind) in _DEFAULTS.items() if c not in answers.columns})
    until = F.coalesce(F.lead("try").over(Window.partitionBy("url").orderBy("try")) - 1, F.lit(tries))
    spread = every.withColumn("__until", F.least(until, F.lit(tries))).filter(F.col("try") <= F.col("__until"))
    return spread.withColumn("try", F.explode(F.sequence("try", "__until"))).drop("__until")


def walked(requests: DataFrame, answers: DataFrame, max_hops: int = MAX_HOPS, body_cap: int = BODY_CAP, timeout_ms: int = 1000 * TIMEOUT_S) -> DataFrame:
    """requests (url, try, host: the only host allowed) with outcome, initial_status, final_status, final_url, chain (number of
    redirects), content_type, x_robots_tag, body, elapsed_ms: the answer that the last hop got."""
    archived = answers.select(F.col("url").alias("__at"), F.col("try").alias("__try"), *[c for c in _DEFAULTS if c != "try"])
    none = lambda kind: F.lit(None).cast(kind)
    live = requests.select("url", "try", "host", F.col("url").alias("at"), none("int").alias("initial_status"), none("int").alias("final_status"), none("string").alias("final_url"), F.lit(0).alias("chain"))
    ended = []
    for _ in range(max_hops + 2):
        met = live.join(archived, (F.col("at") == F.col("__at")) & (F.col("try") == F.col("__try")), "left")
        error = F.when(F.col("elapsed_ms") > timeout_ms, "TIMEOUT").otherwise(F.col("error"))
        outcome = F.when(urls.host_of(F.col("at")) != F.col("host"), F.when(F.col("chain") == 0, "SCOPE_BLOCKED").otherwise("REDIRECT_BLOCKED"))
        outcome = outcome.when(F.col("__at").isNull() | (F.col("host_class") == "NONE"), "NETWORK_ERROR").when(F.col("host_class") != "PUBLIC", "SECURITY_BLOCKED").when(error.isNotNull(), error)
        moved = F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull()
        took = outcome.isNull()
        target = F.when(took & moved, urls.identity_any("location", F.col("at")))
        step = met.withColumns({"__moved": took & moved, "__target": target, "__lost": outcome})
        unsafe = (F.length("location") > urls.MAX_URL) | F.col("__target").isNull() | urls.safety_any(F.coalesce("__target", F.lit(""))).isNotNull()
        long_body = F.octet_length("body") > body_cap
        verdict = F.coalesce(F.col("__lost"), F.when(~F.col("__moved"), F.when(long_body, "BODY_TOO_LARGE").otherwise("HTTP_RESPONSE")).when(unsafe, "SECURITY_BLOCKED").when(F.col("chain") >= max_hops, "REDIRECT_LIMIT"))
        answered = F.col("__lost").isNull()
        counted = F.col("__moved") & (verdict.isNull() | (verdict == "REDIRECT_LIMIT"))
        done = kept(step.select(
            "url", "try", "host", "at", verdict.alias("outcome"), F.when(answered, F.coalesce("initial_status", "status")).otherwise(F.col("initial_status")).alias("initial_status"),
            F.when(answered, F.col("status")).otherwise(F.col("final_status")).alias("final_status"), F.when(answered, F.col("at")).otherwise(F.when(F.col("__lost") == "REDIRECT_BLOCKED", none("string")).otherwise(F.col("final_url"))).alias("final_url"),
            (F.col("chain") + counted.cast("int")).alias("chain"), "content_type", "x_robots_tag", F.when(verdict == "HTTP_RESPONSE", F.col("body")).alias("body"), F.col("__target").alias("target"),
        ))
        ended.append(done.filter("outcome is not null").drop("at", "target"))
        live = done.filter("outcome is null").select("url", "try", "host", F.col("target").alias("at"), "initial_status", "final_status", "final_url", "chain")
        if live.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def settled(requests: DataFrame, answers: DataFrame, **limits: int) -> DataFrame:
    """requests (url, host), each with the try that settles it: the first whose answer was not lost, else the last; lost: how
    many were lost before. Only requests whose answer was lost are walked again."""
    left, out = requests.select("url", "host").distinct(), []
    for n in range(1, TRIES + 1):
        got = walked(left.withColumn("try", F.lit(n)), answers, **limits).drop("try")
        lost = F.col("outcome").isin(*LOST)
        out.append((got if n == TRIES else got.filter(~lost)).withColumn("lost", F.when(lost, n).otherwise(n - 1)))
        left = got.filter(lost).select("url", "host")
        if n == TRIES or left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def text_of(body: Column) -> Column:
    return body.cast("string")


def robots_of(hosts: DataFrame, answers: DataFrame, interval_ms: int, **limits: int) -> DataFrame:
    """host, robots (RULES, ALLOW_ALL, DENIED or UNAVAILABLE), origin, text, bytes and clock: the tries over https with
    waits between them, then one over http where nobody answered or nothing was found; clock_ms is when the last try
    was made."""
    secure, plain = F.concat(F.lit("https://"), "host", F.lit("/robots.txt")), F.concat(F.lit("http://"), "host", F.lit("/robots.txt"))
    asked = hosts.select("host", secure.alias("url"), F.lit("https").alias("scheme"), F.explode(F.sequence(F.lit(1), F.lit(ROBOTS_TRIES))).alias("try"))
    asked = asked.unionByName(hosts.select("host", plain.alias("url"), F.lit("http").alias("scheme"), F.lit(1).alias("try")))
    got = walked(asked.select("url", "try", "host"), answers, **limits).withColumn("scheme", F.regexp_extract("url", "^[a-z]+", 0))
    tries = kept(got.select("host", "scheme", F.col("try").alias("attempt"), "outcome", F.col("final_status").alias("status"), F.col("body").isNotNull().alias("has_body"), "body", "final_url"))
    verdicts = robots.acquired(tries, "host")
    verdict = robots.acquisition(F.col("scheme"), F.col("attempt"), F.col("outcome"), F.col("status"), F.col("has_body"))
    final = F.min(F.when((F.col("scheme") == "https") & verdict.isin("RULES", "DENIED", "UNAVAILABLE"), F.col("attempt"))).over(Window.partitionBy("host"))
    other = F.max(((F.col("scheme") == "https") & (F.col("outcome") == "HTTP_RESPONSE") & ~F.coalesce(F.col("status"), F.lit(0)).isin(404, 410)).cast("int")).over(Window.partitionBy("host"))
    marked = tries.withColumns({"__final": final, "__other": other})
    made = F.when(F.col("scheme") == "https", F.col("attempt") <= F.coalesce("__final", F.lit(ROBOTS_TRIES))).otherwise(F.col("__final").isNull() & (F.col("__other") == 0))
    wait = F.greatest(F.lit(ROBOTS_WAIT_MS), F.lit(interval_ms))
    at = F.when(F.col("scheme") == "https", (F.col("attempt") - 1) * wait).otherwise((ROBOTS_TRIES - 1) * wait + interval_ms)
    used = marked.filter(made).withColumn("at", at)
    last = used.groupBy("host").agg(
        F.max_by(F.struct("body", F.regexp_extract(F.coalesce("final_url", F.concat("scheme", F.lit("://"), "host")), "^[a-z]+://[^/]+", 0).alias("origin")), "at").alias("l"),
        F.max("at").cast("long").alias("clock_ms"), F.sum(F.coalesce(F.octet_length("body"), F.lit(0))).cast("long").alias("bytes"),
    )
    return verdicts.join(last, "host").select("host", "robots", F.col("l.origin").alias("origin"), F.when(F.col("robots") == "RULES", text_of(F.col("l.body"))).alias("text"), "clock_ms", "bytes")


def rules_of(acquired: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """(rules: host, rule_path, allow; sources: host, sitemaps) of acquired robots.txt texts."""
    parsed = acquired.select("host", "origin", robots.robots_groups(F.coalesce("text", F.lit(""))).alias("r"))
    rules = parsed.select("host", F.explode(robots.rules_for(F.col("r.groups"), agent)).alias("x")).select("host", F.col("x.path").alias("rule_path"), F.col("x.allow").alias("allow"))
    return rules, parsed.select("host", urls.sitemap_sources(F.col("r.sitemaps"), F.col("origin")).alias("sitemaps"))


def sitemap_urls(sources: DataFrame, answers: DataFrame, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(urls: host, url; state: host, documents, truncated) found in the sitemaps of hosts (host, sitemaps)."""
    first = F.col("try") == 1
    likely = first & (F.coalesce(F.col("content_type"), F.lit("")).contains("xml") | F.col("url").rlike(r"(?i)\.xml(\?|$)"))
    asked = answers.filter(likely).select("url", urls.host_of(F.col("url")).alias("host"), "try")
    named = sources.select("host", F.posexplode("sitemaps").alias("pos", "root"))
    asked = asked.unionByName(named.select(F.col("root").alias("url"), "host", F.lit(1).alias("try"))).distinct()
    bodies = walked(asked, answers, **limits).filter("outcome = 'HTTP_RESPONSE' and final_status = 200 and body is not null")
    documents = kept(bodies.select("url", sitemap.sitemap_facts(text_of(F.col("body"))).alias("f")).select("url", "f.*"))
    roots = named.select(F.col("host").alias("scope"), "root", "host", "pos")
    found, state = sitemap_walk(roots, documents, max_documents=SITEMAP_DOCUMENTS)
    return found.withColumnRenamed("scope", "host"), state.withColumnRenamed("scope", "host")
