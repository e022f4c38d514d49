"""The crawl as a stream: one stateful run per host, fed by the answers that it asks for.

A run visits one URL after the other: the shallowest due one, by key, one request per interval; a lost answer is tried again
5 s x try later, while others go ahead; a redirect's end and a page's links join the frontier; budgets of pages, bytes, time
and frontier end the run. What a visit comes to depends on all before it, so the order is kept as Spark state per run
(transformWithState): the clock and its budgets, the frontier and the answers at hand as map states. A run goes on until it
needs an answer that it has not got, and asks for those of all waiting URLs at once.

Fetching is relational: in each batch the asked URLs of all runs are judged by robots.txt, met with the archive, followed over
redirects and searched for links together, and their answers become the stream's next input. Ends of redirects are as deep as
what led to them, so half of them are due at once; they are asked for in the same batch, before a run wants them. So a level
of links costs a batch, not a request or a redirect a batch, and hosts are spread over the state's partitions. A run's state is bounded by its budgets
(MAX_FRONTIER URLs). URLs that were visited are a state of their own, which is asked for single URLs and never read as a
whole: the state store tells by its Bloom filters and, where these say maybe, exactly. So a batch costs what is waiting and
what was found, however long the crawl has been.

Time is the crawl's own: a wait moves the run's clock. State, asked URLs and visits survive a restart with the stream's
checkpoint; a batch that is tried again overwrites what it wrote.

Defined results: a host without seeds has its origin alone; a host whose robots.txt denies or cannot be had makes no visit and
ends as FAILED; repeated seeds and links count once; URLs of other hosts, of no http(s) scheme or over 8192 characters never
join; an empty table of hosts gives empty tables.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import robots, urls
from tidewatch.operators import fetch
from tidewatch.operators.crawl import INTERVAL_MS, MAX_FRONTIER, MAX_MS, MAX_PAGES, MAX_URL, observe
from tidewatch.operators.frontier import kept
from tidewatch.operators.publish import completeness
from tidewatch.sources.responses import RUN_CAP

# The wait before the next try of a page, for each try made.
BACKOFF_MS = 5000
#: What a run is fed: its beginning, its seeds, its answers.
INBOX = "run_id string, kind string, seq int, url string, clock_ms long, bytes long, allowed boolean, lost int, outcome string, links array<string>"
#: What a run gives: the URLs it asks for, its visits, its end.
OUTBOX = "kind string, run_id string, url string, seq long, at_ms long, depth int, tries int, outcome string, pages long, bytes long, limit_reached boolean, body_budget_exceeded boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def key_of(url: str) -> str:
    """urls.url_key() of one URL."""
    return hashlib.sha256(url.encode()).hexdigest()


class Visits(StatefulProcessor):
    """One run: which URL is visited when. Budgets as in crawl()."""

    def __init__(self, max_pages: int, body_bytes: int, max_frontier: int, max_ms: int, interval_ms: int):
        self.max_pages, self.body_bytes, self.max_frontier, self.max_ms, self.interval_ms = max_pages, body_bytes, max_frontier, max_ms, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "clock long, next_at long, pages long, bytes long, seq long, admitted long, truncated boolean, over boolean")
        self.frontier = handle.getMapState("frontier", "url string", "key string, depth int, tries int, due long, asked boolean, done boolean")
        self.visited = handle.getMapState("visited", "url string", "seq long")
        self.answers = handle.getMapState("answers", "url string", "allowed boolean, lost int, outcome string, bytes long, links array<string>, ends int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seeds, answers = [], []
        clock, next_at, pages, taken, seq, admitted, truncated, over = self.run.get() if self.run.exists() else (0, 0, 0, 0, 0, 0, False, False)
        for r in rows:
            if r.kind == "begin":
                clock, next_at, taken, truncated = r.clock_ms, r.clock_ms + self.interval_ms, r.bytes, bool(r.lost)
            else:
                (seeds if r.kind == "seed" else answers).append(r)
        state = {k[0]: list(v) for k, v in self.frontier.iterator()} if seq or pages or admitted else {}
        at_hand = {k[0]: v for k, v in self.answers.iterator()} if state else {}
        kept, again = set(state), bool(seq)
        touched, new = set(), {r.url: (r.allowed, r.lost, r.outcome, r.bytes, r.links, r.seq) for r in answers}
        waiting: list[tuple[int, int, str, str]] = []  # due, depth, key, url
        due: list[tuple[int, str, str]] = []

        def add(url: str, depth: int) -> None:
            nonlocal admitted, truncated
            if len(url) > MAX_URL or url in state or (again and self.visited.containsKey((url,))):
                return
            if admitted >= self.max_frontier:
                truncated = True
                return
            admitted += 1
            ukey = key_of(url)
            state[url] = [ukey, depth, 0, 0, False, False]
            touched.add(url)
            heapq.heappush(due, (depth, ukey, url))

        for url, (ukey, depth, _, at, _, _) in state.items():
            heapq.heappush(waiting, (at, depth, ukey, url))
        for r in sorted(seeds, key=lambda r: (r.seq, key_of(r.url))):
            add(r.url, 0)
        out: list[dict] = []
        ended = False
        while True:
            open_ = bool(waiting or due)
            if not open_ or pages >= self.max_pages or taken >= self.body_bytes or clock >= self.max_ms:
                ended = True
                over |= open_ and pages < self.max_pages and taken >= self.body_bytes
                truncated |= open_
                break
            while waiting and waiting[0][0] <= clock:
                _, depth, ukey, url = heapq.heappop(waiting)
                heapq.heappush(due, (depth, ukey, url))
            if not due:
                if waiting[0][0] > self.max_ms:
                    ended = truncated = True
                    break
                clock = waiting[0][0]
                continue
            depth, ukey, url = due[0]
            answer = new.get(url) or at_hand.get(url)
            if answer is None:
                break  # the run goes on when it is there
            heapq.heappop(due)
            clock = max(clock, next_at)
            next_at = clock + self.interval_ms
            allowed, lost, outcome, size, links, end = answer
            item = state[url]
            touched.add(url)
            if allowed and clock >= self.max_ms:  # the wait took the rest of the time
                heapq.heappush(due, (depth, ukey, url))
                ended = truncated = True
                break
            if allowed and item[2] < lost:
                item[2] += 1
                if item[2] < fetch.TRIES:
                    item[3] = clock + BACKOFF_MS * item[2]
                    heapq.heappush(waiting, (item[3], depth, ukey, url))
                    continue
            else:
                item[2] += 1
            item[5] = True
            pages += 1
            seq += 1
            out.append({"kind": "visit", "url": url, "seq": seq, "at_ms": clock, "depth": depth, "tries": item[2] if allowed else 0, "outcome": outcome if allowed else "ROBOTS_BLOCKED"})
            if allowed:
                taken += size
                for i, link in enumerate(links or []):  # the last one may be a redirect's end: as deep as the URL itself
                    add(link, depth if i == end else depth + 1)
        if ended:
            out.append({"kind": "end", "seq": seq, "at_ms": clock, "pages": pages, "bytes": taken, "limit_reached": truncated, "body_budget_exceeded": over or taken > self.body_bytes})
            for s in (self.frontier, self.visited, self.answers, self.run):
                s.clear()
        else:
            for _, _, url in due:
                if not state[url][4] and url not in new and url not in at_hand:
                    state[url][4] = True
                    touched.add(url)
                    out.append({"kind": "want", "url": url})
            for url in touched:
                if not state[url][5]:
                    self.frontier.updateValue((url,), tuple(state[url]))
                    continue
                self.visited.updateValue((url,), (seq,))
                if url in kept:
                    self.frontier.removeKey((url,))
            for url, a in new.items():  # a redirect's end may be there before the run has come to it, or be visited by then
                if not state[url][5] if url in state else not (again and self.visited.containsKey((url,))):
                    self.answers.updateValue((url,), a)
            for url in at_hand:
                if url in state and state[url][5]:
                    self.answers.removeKey((url,))
            self.run.update((clock, next_at, pages, taken, seq, admitted, truncated, over))
        names = [c.split()[0] for c in OUTBOX.split(", ")]
        for o in out:
            yield Row(**{n: key[0] if n == "run_id" else o.get(n) for n in names})

    def close(self) -> None:
        pass


def asked(wants: DataFrame, rules: DataFrame, answers: DataFrame, **limits: int) -> DataFrame:
    """What wanted URLs (run_id, url) come to: allowed, lost and, of the try that settles them, outcome and all of observe()."""
    at = wants.withColumns({"host": F.col("run_id"), "path": F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1)})
    judged = robots.allowed(at, rules, "host").select("run_id", "url", "allowed")
    got = fetch.settled(judged.filter("allowed").select("url", F.col("run_id").alias("host")), answers, **limits)
    both = judged.join(got.withColumnRenamed("host", "run_id"), ["run_id", "url"], "left")
    redirects = F.when(F.col("chain") > 0, F.array_repeat(F.lit(""), F.col("chain"))).otherwise(F.array().cast("array<string>"))
    rows = both.select(
        "run_id", "url", F.lit(0).alias("depth"), F.when(F.col("allowed"), F.col("outcome")).otherwise("ROBOTS_BLOCKED").alias("outcome"), F.col("final_status").alias("status"), "content_type", "x_robots_tag",
        redirects.alias("redirects"), fetch.text_of(F.col("body")).alias("body"),
    )
    more = both.select("run_id", "url", "allowed", "lost", "initial_status", "final_status", "final_url", "chain", F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("size"))
    return kept(observe(rows).drop("depth", "bytes", "initial_status")).join(more, ["run_id", "url"])


def _answers(facts: DataFrame) -> DataFrame:
    """The inbox rows of asked URLs: links that may join the frontier, and as the last one a redirect's end."""
    joined = F.col("outcome_end").isNotNull()
    every = F.concat(F.coalesce("links", F.array().cast("array<string>")), F.when(joined, F.array("outcome_end")).otherwise(F.array().cast("array<string>")))
    home = F.filter(every, lambda u: (urls.host_of(u) == F.col("run_id")) & u.rlike("^https?://"))
    ends = F.when(joined & (urls.host_of(F.col("outcome_end")) == F.col("run_id")), F.size(home) - 1).otherwise(-1)
    rows = facts.withColumn("outcome_end", F.when((F.col("chain") > 0) & (F.col("fetch_outcome") == "HTTP_RESPONSE"), urls.identity_any(F.coalesce("final_url", F.lit("")), F.lit(""))))
    return rows.select(
        "run_id", F.lit("answer").alias("kind"), ends.alias("seq"), "url", F.lit(None).cast("long").alias("clock_ms"), F.col("size").alias("bytes"), "allowed",
        F.coalesce("lost", F.lit(0)).alias("lost"), F.col("fetch_outcome").alias("outcome"), home.alias("links"),
    )


def _ends(answered: DataFrame) -> DataFrame:
    """Redirects' ends that may join the frontier (run_id, url), of inbox rows of answers."""
    return answered.filter("seq >= 0").select("run_id", F.get("links", F.col("seq")).alias("url")).distinct()


def begin(hosts: DataFrame, monitored: DataFrame, acquired: DataFrame, found: DataFrame, state: DataFrame, interval_ms: int) -> DataFrame:
    """The inbox rows that runs begin with: clock and bytes after robots.txt and sitemaps, then the seeds in their order: the
    origin, monitored URLs (host, url), those of sitemaps."""
    ready = acquired.filter(F.col("robots").isin("RULES", "ALLOW_ALL")).join(hosts, "host", "left_semi").join(state, "host", "left")
    # the first sitemap is asked for one interval after robots.txt, each further one another interval later
    clock = F.col("clock_ms") + F.coalesce("documents", F.lit(0)) * interval_ms
    first = ready.select(F.col("host").alias("run_id"), F.lit("begin").alias("kind"), clock.alias("clock_ms"), "bytes", F.coalesce("truncated", F.lit(False)).cast("int").alias("lost"))
    origin = ready.select("host", F.concat("origin", F.lit("/")).alias("url"), F.lit(0).alias("rank"))
    seeds = origin.unionByName(monitored.select("host", "url", F.lit(1).alias("rank"))).unionByName(found.select("host", "url", F.lit(2).alias("rank")))
    seeds = seeds.filter((urls.host_of(F.col("url")) == F.col("host")) & F.col("url").rlike("^https?://")).join(ready.select("host"), "host", "left_semi")
    ranked = seeds.groupBy("host", "url").agg(F.min("rank").alias("seq")).select(F.col("host").alias("run_id"), F.lit("seed").alias("kind"), "seq", "url")
    rows = first.unionByName(ranked, allowMissingColumns=True)
    columns = [f.split()[0] for f in INBOX.split(", ")]
    blank = rows.sparkSession.createDataFrame([], INBOX)
    return rows.unionByName(blank, allowMissingColumns=True).select(*columns)


def visit_stream(
    spark: SparkSession, folder: str, rules: DataFrame, answers: DataFrame, max_pages: int = MAX_PAGES, body_bytes: int = RUN_CAP, max_frontier: int = MAX_FRONTIER, max_ms: int = MAX_MS, interval_ms: int = INTERVAL_MS,
    **limits: int,
) -> None:
    """Runs the stream over folder/inbox until no run asks for anything: visits and ends go to folder/log, facts of asked URLs
    to folder/facts. A restart with the same folder goes on where the last one stopped."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    processor = Visits(max_pages, body_bytes, max_frontier, max_ms, interval_ms)
    steps = spark.readStream.schema(INBOX).parquet(f"{folder}/inbox/*").groupBy("run_id").transformWithState(processor, OUTBOX, "Append", "None")

    def act(batch: DataFrame, number: int) -> None:
        there = f"{folder}/steps/{number}"
        batch.write.mode("overwrite").parquet(there)
        rows = spark.read.schema(OUTBOX).parquet(there)
        rows.filter("kind <> 'want'").write.mode("overwrite").parquet(f"{folder}/log/{number}")
        wants = rows.filter("kind = 'want'").select("run_id", "url")
        if wants.isEmpty():
            return
        asked(wants, rules, answers, **limits).write.mode("overwrite").parquet(f"{folder}/facts/{number}")
        facts = spark.read.parquet(f"{folder}/facts/{number}")
        ends = kept(_ends(_answers(facts)).join(wants, ["run_id", "url"], "left_anti"))
        if not ends.isEmpty():
            asked(ends, rules, answers, **limits).write.mode("append").parquet(f"{folder}/facts/{number}")
            facts = spark.read.parquet(f"{folder}/facts/{number}")
        _answers(facts).select(*[f.split()[0] for f in INBOX.split(", ")]).write.mode("overwrite").parquet(f"{folder}/inbox/{number}")

    query = steps.writeStream.foreachBatch(act).option("checkpointLocation", f"{folder}/checkpoint").start()
    spark.conf.set(PROVIDER, before)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def visit(hosts: DataFrame, monitored: DataFrame, answers: DataFrame, folder: str, agent: str = "tidewatch", interval_ms: int = INTERVAL_MS, limits: dict[str, int] | None = None, **budgets: int) -> tuple[DataFrame, DataFrame]:
    """(observations, runs) of one run per host (host), in a folder that all executors share.

    monitored: host, url (identities); answers: an archive (see fetch). observations: what observe() gives, with seq, at_ms,
    depth, tries, initial_status, final_status, final_url, chain; runs: run_id, robots, pages, bytes, at_ms, limit_reached,
    body_budget_exceeded, status, completeness, failure_code.
    """
    spark, limits = hosts.sparkSession, limits or {}
    stored = kept(fetch.archive(answers))
    acquired = kept(fetch.robots_of(hosts.select("host").distinct(), stored, interval_ms, **limits))
    rules, sources = fetch.rules_of(acquired, agent)
    rules = kept(rules)
    found, state = fetch.sitemap_urls(sources.join(acquired.filter(F.col("robots").isin("RULES", "ALLOW_ALL")), "host", "left_semi"), stored, **limits)
    begin(hosts, monitored, acquired, found, state, interval_ms).write.mode("overwrite").parquet(f"{folder}/inbox/begin")
    visit_stream(spark, folder, rules, stored, interval_ms=interval_ms, **budgets, **limits)
    log = spark.read.schema(OUTBOX).option("recursiveFileLookup", "true").parquet(f"{folder}/log")
    visits = log.filter("kind = 'visit'").select("run_id", "url", "seq", "at_ms", "depth", "tries", F.col("outcome").alias("__o"))
    nothing = asked(spark.createDataFrame([], "run_id string, url string"), rules, stored)
    facts = spark.read.schema(nothing.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/facts") if _there(spark, f"{folder}/facts") else nothing
    seen = visits.join(facts.dropDuplicates(["run_id", "url"]), ["run_id", "url"]).drop("__o", "lost", "allowed", "links")
    return seen, _runs(acquired, log, seen)


def _there(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def _runs(acquired: DataFrame, log: DataFrame, seen: DataFrame) -> DataFrame:
    o = F.col("fetch_outcome")
    facts = seen.groupBy("run_id").agg(F.count_if(o == "HTTP_RESPONSE").alias("http_count"), F.bool_or(o == "SECURITY_BLOCKED").alias("security_blocked"), F.bool_or(o.isin("NETWORK_ERROR", "TIMEOUT", "BODY_TOO_LARGE", "REDIRECT_LIMIT")).alias("unrecovered"))
    ends = log.filter("kind = 'end'").select("run_id", "pages", "bytes", "at_ms", "limit_reached", "body_budget_exceeded")
    forced = F.when(F.col("robots") == "DENIED", "ROBOTS_DENIED").when(F.col("robots") == "UNAVAILABLE", "ROBOTS_UNAVAILABLE")
    rows = acquired.select(F.col("host").alias("run_id"), "robots", F.col("bytes").alias("__b"), F.col("clock_ms").alias("__c")).join(ends, "run_id", "left").join(facts, "run_id", "left")
    zero = lambda c, other: F.coalesce(c, other)
    rows = rows.withColumns({
        "forced_failure": forced, "cancelled": F.lit(False), "http_count": zero("http_count", F.lit(0)), "pages": zero("pages", F.lit(0)), "bytes": zero("bytes", F.col("__b")), "at_ms": zero("at_ms", F.col("__c")),
        **{c: zero(c, F.lit(False)) for c in ("security_blocked", "unrecovered", "limit_reached", "body_budget_exceeded")},
    }).withColumn("body_exceeded", F.col("body_budget_exceeded"))
    return completeness(rows).select("run_id", "robots", "pages", "bytes", "at_ms", "limit_reached", "body_budget_exceeded", "status", "completeness", "failure_code")
