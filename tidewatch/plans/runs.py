"""Queries of whole runs, each next to its SQL: the crawl as a stream, publication batch by batch, the gate before it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import netclass, urls
from tidewatch.operators import accounts, operations, publish, writes
from tidewatch.operators.crawl import NO_BUDGETS
from tidewatch.operators.ledger import Ledger
from tidewatch.plans.catalogue import SUMMARY, retention_plan
from tidewatch.plans.oracles import HOST, IDENTITY, RETENTION
from tidewatch.plans.oracles import ORACLES as BATCH
from tidewatch.plans.stored import observations, publication, suppressions
from tidewatch.sources.responses import joined_headers, request_body, responses
from tidewatch.sources.tables import load, shared_folder
from tidewatch.sources.warc import read_archive, write_archive
from tidewatch.streaming.visits import visit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidewatch-{uuid.uuid4().hex}"


# --- the crawl


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(answers, pages) of every host: its pages, some of which are lost at first, late, moved, gone, broken or no pages, and a
    robots.txt of each kind, by plain arithmetic over page_id and the host's least one."""
    k = F.col("page_id")
    every = responses(load(spark, sf_dir, "pages")).select("url", "page_id", "body", urls.host_of(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("origin"))
    lost = F.when(k % 7 == 3, k % 4).otherwise(0).cast("int")
    status = F.when(k % 11 == 4, 301).when(k % 13 == 6, 404).when(k % 17 == 9, 503).otherwise(200)
    own = every.filter(lost < 3).select(
        "url", (lost + 1).alias("try"), status.alias("status"), F.when(k % 11 == 4, F.concat(F.lit("/moved/"), k)).alias("location"), F.when(k % 19 == 3, "application/pdf").otherwise("text/html").alias("content_type"),
        "body", F.lit(None).cast("string").alias("error"), F.lit(0).alias("elapsed_ms"),
    )
    none = every.filter(lost > 0).select(
        "url", F.explode(F.sequence(F.lit(1), lost)).alias("try"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("content_type"),
        F.lit(None).cast("string").alias("body"), F.when(k % 2 == 0, "NETWORK_ERROR").alias("error"), F.when(k % 2 == 0, 0).otherwise(25_000).alias("elapsed_ms"),
    )
    target = F.when(k % 22 == 4, F.concat("origin", F.lit("/moved/"), k)).otherwise(F.concat(F.lit("https://elsewhere.example/"), k))
    moved = every.filter(k % 11 == 4).select(F.concat("origin", F.lit("/moved/"), k).alias("url"), F.lit(1).alias("try"), F.when(k % 22 == 4, 200).otherwise(302).alias("status"), F.when(k % 22 != 4, target).alias("location"))
    moved = moved.withColumns({"content_type": F.lit("text/html"), "body": F.lit("<title>moved</title>"), "error": F.lit(None).cast("string"), "elapsed_ms": F.lit(0)})
    hosts = every.groupBy("host").agg(F.min("page_id").alias("hn"))
    kind, text = F.col("hn") % 5, F.lit("User-agent: *\nDisallow: /en/\n")
    answer = lambda scheme, n, code, body: F.struct(F.concat(F.lit(f"{scheme}://"), "host", F.lit("/robots.txt")).alias("url"), F.lit(n).alias("try"), F.lit(code).cast("int").alias("status"), body.cast("string").alias("body"))
    nothing = F.lit(None)
    robots = hosts.select(F.explode(
        F.when(kind == 0, F.array(answer("https", 1, None, nothing), answer("https", 2, 200, text))).when(kind == 1, F.array(answer("https", 1, 404, nothing), answer("http", 1, 404, nothing)))
        .when(kind == 2, F.array(answer("https", 1, 403, nothing))).when(kind == 3, F.array(answer("https", 1, 500, nothing))).otherwise(F.array(answer("https", 1, 200, text)))
    ).alias("r")).select("r.*", F.when(F.col("r.status").isNull(), "NETWORK_ERROR").alias("error"))
    answers = own.unionByName(none).unionByName(moved).unionByName(robots, allowMissingColumns=True).fillna(0, ["elapsed_ms"])
    return answers, every.select("host", "url")


@query(
    f"""WITH p AS (SELECT {HOST} AS host, {IDENTITY} AS u, min(page_id) AS k FROM pages GROUP BY ALL),
    h AS (SELECT host, min(k) % 5 AS kind FROM p GROUP BY host),
    s AS (SELECT p.*, CASE WHEN k % 7 = 3 THEN k % 4 ELSE 0 END AS lost, kind IN (0, 4) AND regexp_matches(u, '^[a-z]+://[^/]+/en/') AS blocked,
      CASE WHEN k % 11 = 4 THEN 301 WHEN k % 13 = 6 THEN 404 WHEN k % 17 = 9 THEN 503 ELSE 200 END AS status FROM p JOIN h USING (host) WHERE kind NOT IN (2, 3)),
    o AS (SELECT *, CASE WHEN blocked THEN 'ROBOTS_BLOCKED' WHEN lost >= 3 THEN CASE WHEN k % 2 = 0 THEN 'NETWORK_ERROR' ELSE 'TIMEOUT' END
      WHEN k % 11 = 4 AND k % 22 <> 4 THEN 'REDIRECT_BLOCKED' ELSE 'HTTP_RESPONSE' END AS outcome FROM s)
    SELECT host AS run_id, u AS url, outcome AS fetch_outcome, CASE WHEN blocked THEN 0 ELSE least(lost + 1, 3) END::INT AS tries,
      coalesce(CASE WHEN NOT blocked AND lost < 3 THEN status END, 0)::INT AS initial_status,
      coalesce(CASE WHEN NOT blocked AND lost < 3 THEN CASE WHEN k % 22 = 4 THEN 200 WHEN k % 11 = 4 THEN 302 ELSE status END END, 0)::INT AS final_status,
      CASE WHEN blocked OR lost >= 3 OR k % 11 <> 4 THEN 0 WHEN k % 22 = 4 THEN 1 ELSE 2 END::INT AS chain,
      CASE WHEN outcome <> 'HTTP_RESPONSE' THEN 'UNKNOWN' WHEN status = 200 AND k % 19 <> 3 THEN 'KNOWN' ELSE 'NOT_APPLICABLE' END AS validity FROM o"""
)
def crawl_visits(spark, sf_dir):
    """The whole crawl of every host as a stream, discovery included, from an archive of WARC files; what became of the monitored
    pages, all of them as its SQL has it, so runs have no budgets."""
    answers, pages = archive(spark, sf_dir)
    folder = _folder(spark)
    write_archive(answers.repartition(spark.sparkContext.defaultParallelism), f"{folder}/archive")
    seen, _ = visit(pages.select("host").distinct(), pages, read_archive(spark, f"{folder}/archive"), folder, **NO_BUDGETS)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = seen.join(pages.select(F.col("host").alias("run_id"), "url").distinct(), ["run_id", "url"], "left_semi")
    return own.select("run_id", "url", "fetch_outcome", "tries", zero("initial_status"), zero("final_status"), zero("chain"), F.col("field_validity")["title"].alias("validity"))


# --- publication


@query(BATCH["publish_summary"])
def publish_ledger(spark, sf_dir):
    """Four batches, one of the first runs of all projects, one of the second ones and so on: what the ledger shows at last."""
    seen, muted = observations(spark, sf_dir), suppressions(spark, sf_dir)
    book = Ledger(spark, _folder(spark))
    for n in range(1, 5):
        book.publish(seen.filter(F.col("run_no") == n).select("project_id", "run_id").distinct(), seen, muted)
    return book.table("summary").select(*SUMMARY)


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN 'NOT_FOUND' WHEN o_orderkey % 4 = 1 THEN 'REPLAY' WHEN o_orderstatus <> 'F' THEN 'NOT_FINALIZING'
      WHEN o_orderkey % 5 = 0 THEN 'CANCEL_REQUESTED' WHEN o_custkey % 3 <> o_orderkey % 3 THEN 'LEASE_LOST' ELSE 'PUBLISH' END AS decision FROM orders"""
)
def publish_gate(spark, sf_dir):
    """Who may publish: every order as a request."""
    o = load(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "FINALIZING").otherwise("CRAWLING")
    asked = o.select(k, status.alias("status"), (k % 5 == 0).alias("cancel_requested"), (k % 4 == 1).alias("published"), (c % 9 != 0).alias("same_project"), (c % 3 == k % 3).alias("token_matches"))
    return publish.publish_gate(asked).select("o_orderkey", "decision")


# --- admission and claims


_ASKED = """a AS (SELECT event_id AS id, user_id AS project_id, event_type AS actor, floor(epoch(ts))::BIGINT AS t, 'k' || event_id % 6 AS key, event_id % 11 * 900 AS lasts,
    CASE WHEN event_id % 13 = 0 THEN 'FORBIDDEN' WHEN event_id % 29 = 0 THEN 'IDEMPOTENCY_KEY_REQUIRED' END AS early, CASE WHEN user_id % 17 = 0 THEN 'ARCHIVED' WHEN user_id % 19 = 0 THEN 'NOT_VERIFIED' END AS late,
    row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events)"""


@query(
    f"""WITH RECURSIVE {_ASKED},
    z AS (SELECT project_id, 0::BIGINT AS n, NULL::BIGINT AS id, ''::VARCHAR AS outcome, NULL::BIGINT AS run, 0::BIGINT AS until, -1000000::BIGINT AS last,
      []::STRUCT(t BIGINT, k VARCHAR, i BIGINT)[] AS held FROM a GROUP BY project_id),
    s AS (SELECT * FROM z UNION ALL
      SELECT project_id, n, id, CASE WHEN early IS NOT NULL THEN early WHEN again IS NOT NULL THEN 'REPLAY' ELSE coalesce(refused, 'ACCEPTED') END,
        CASE WHEN early IS NOT NULL THEN NULL WHEN again IS NOT NULL THEN again WHEN refused IS NULL THEN id END,
        CASE WHEN ok THEN t + lasts ELSE until END, CASE WHEN ok THEN t ELSE last END, CASE WHEN ok THEN list_append(day, struct_pack(t := t, k := k, i := id)) ELSE day END
      FROM (SELECT *, early IS NULL AND again IS NULL AND refused IS NULL AS ok FROM (SELECT *, list_filter(day, lambda x: x.k = k AND t < x.t + 86400)[1].i AS again,
          coalesce(late, CASE WHEN until > t THEN 'ALREADY_ACTIVE' WHEN len(day) >= 10 THEN 'DAILY_LIMIT' WHEN last + 300 > t THEN 'SPACING' END) AS refused
        FROM (SELECT a.project_id, a.n, a.id, a.t, a.lasts, a.early, a.late, a.actor || '|' || a.key AS k, s.until, s.last, list_filter(s.held, lambda x: x.t >= a.t - 86400) AS day
          FROM s JOIN a ON a.project_id = s.project_id AND a.n = s.n + 1))))
    SELECT project_id, id, outcome, CASE WHEN run IS NOT NULL THEN project_id || '/' || run END AS run_id, outcome = 'ACCEPTED' AS has_run, outcome = 'ACCEPTED' AS has_event, outcome = 'ACCEPTED' AS has_audit FROM s WHERE n > 0"""
)
def crawl_admission(spark, sf_dir):
    """Every event as a request for a crawl of its user's project; what it comes to and what it writes."""
    k, u = F.col("event_id"), F.col("user_id")
    asked = load(spark, sf_dir, "events").select(
        k.alias("id"), u.alias("project_id"), F.lit("w").alias("workspace_id"), F.col("event_type").alias("actor_id"), F.when(k % 13 == 0, "VIEWER").otherwise("MEMBER").alias("role"),
        F.when(k % 29 == 0, "").otherwise(F.concat(F.lit("k"), k % 6)).alias("key"), F.col("ts").alias("at"), (k % 11 * 900).alias("lasts_s"), F.lit("p").alias("policy_id"),
        F.lit(True).alias("project_exists"), (u % 17 == 0).alias("archived"), F.when(u % 19 == 0, "NOT_VERIFIED").alias("block_reason"),
    )
    got = operations.admit(asked)
    there = lambda df, c, n: df.select(F.col(c).alias("run_id"), F.lit(True).alias(n))
    own = got.decisions.withColumn("own", F.when(F.col("outcome") == "ACCEPTED", F.col("run_id")))
    for df, c, n in ((got.runs, "run_id", "has_run"), (got.outbox, "aggregate_id", "has_event"), (got.audit, "resource_id", "has_audit")):
        own = own.join(there(df, c, n).withColumnRenamed("run_id", "own"), "own", "left").withColumn(n, F.coalesce(n, F.lit(False)))
    return own.drop("own")


@query(
    """SELECT event_id, ['w1', 'w2', 'w3'][((n - 1) % 3 + 1)::INT] AS claimed_by, ((n - 1) // 3)::INT AS claim_order FROM (
      SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click' AND event_id % 2 <> 0 AND ts <= TIMESTAMP '2024-01-20') WHERE n <= 60"""
)
def outbox_claims(spark, sf_dir):
    """Twenty events for each of three workers."""
    e = load(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("type"), F.col("ts").alias("available_at"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("delivered_at"), F.lit(None).cast("timestamp_ntz").alias("claim_until")
    )
    got = operations.claims(e, "click", ["w1", "w2", "w3"], 20, F.lit("2024-01-20").cast("timestamp_ntz"))
    return got.select("event_id", "claimed_by", "claim_order")


# --- single operators


@query(
    f"""SELECT run_id, issues_open + CASE WHEN urls_crawled % 2 = 0 THEN 1000 ELSE 0 END AS issues_open, coalesce(health_score, -1) AS health_score, comparison_mode
    FROM ({BATCH["publish_summary"]})"""
)
def write_summary(spark, sf_dir):
    """Every run's summary is written; those that were there already, here with other counts, stay as they are."""
    new = publication(spark, sf_dir).summary.select("run_id", "issues_open", F.coalesce("health_score", F.lit(-1)).alias("health_score"), "comparison_mode", "urls_crawled")
    there = new.filter(F.col("urls_crawled") % 2 == 0).withColumn("issues_open", F.col("issues_open") + 1000)
    return writes.first_write_wins(there, new, ["run_id"]).drop("urls_crawled")


@query(RETENTION + "SELECT ((SELECT count(*) FROM lineitem JOIN plan ON run_id = lpad(l_orderkey::VARCHAR, 10, '0')) + (SELECT count(*) FROM plan))::BIGINT AS deleted")
def retention_counters(spark, sf_dir):
    """Rows that retention deletes in all: line items and orders of the runs that go."""
    plan = retention_plan(spark, sf_dir).select("run_id")
    key = lambda c: F.lpad(F.col(c).cast("string"), 10, "0").alias("run_id")
    counts = [writes.delete_details(load(spark, sf_dir, t).select(key(c)), plan)[1] for t, c in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))]
    return operations.prune_counters(*counts)


@query(f"SELECT page_id, CASE WHEN page_id % 3 > 0 THEN {IDENTITY} END AS identity FROM pages")
def same_host(spark, sf_dir):
    """The identity of every page's URL on its own host, and none on another."""
    own = F.when(F.col("page_id") % 3 > 0, F.upper(urls.host_of(F.col("url")))).otherwise("other.example")
    return load(spark, sf_dir, "pages").select("page_id", urls.same_host_identity(F.col("url"), own).alias("identity"))


@query(
    """SELECT event_id, CASE WHEN event_id % 6 < 2 THEN (event_id * 2654435761) % 4294967296 END AS number FROM events"""
)
def ipv4_literal(spark, sf_dir):
    """Dotted quads, and what only looks like one: a part too large, a part too few, a sign, text behind it."""
    n = F.pmod(F.col("event_id") * 2654435761, F.lit(2**32))
    part = lambda k: (F.shiftright(n, k) % 256).cast("string")
    quad, kind = F.concat_ws(".", part(24), part(16), part(8), part(0)), F.col("event_id") % 6
    literal = F.when(kind < 2, quad).when(kind == 2, F.concat(F.lit("256."), part(16), F.lit(".1.1"))).when(kind == 3, F.concat_ws(".", part(24), part(16), part(8)))
    literal = literal.when(kind == 4, F.concat(F.lit("-"), quad)).otherwise(F.concat(quad, F.lit(".example")))
    return load(spark, sf_dir, "events").select("event_id", netclass.ipv4_number(literal).alias("number"))


@query("""SELECT event_id, event_type || ', ' || (event_id % 3) || ', ' AS value FROM events""")
def header_lines(spark, sf_dir):
    """A header that came three times, the last time empty."""
    return load(spark, sf_dir, "events").select("event_id", joined_headers(F.array("event_type", (F.col("event_id") % 3).cast("string"), F.lit(""))).alias("value"))


@query("""SELECT event_id, event_id % 4 <> 0 AS json, CASE WHEN event_id % 4 <> 0 THEN event_id % 10 END AS page FROM events""")
def request_bodies(spark, sf_dir):
    """JSON bodies of requests, every fourth one broken."""
    k = F.col("event_id")
    text = F.concat(F.lit('{"page": '), k % 10, F.lit(', "who": ["'), F.col("event_type"), F.lit('"]'), F.when(k % 4 == 0, "").otherwise("}"))
    body = request_body(text)
    return load(spark, sf_dir, "events").select("event_id", body.isNotNull().alias("json"), F.variant_get(body, "$.page", "bigint").alias("page"))


# --- control plane


_ROLES = "['OWNER', 'ADMIN', 'MEMBER', 'VIEWER']"


@query(
    f"""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS d, o_custkey AS c, o_custkey % 40 AS w, {_ROLES}[o_custkey % 4 + 1] AS role, 'h' || o_orderkey % 900 || '.example.com' AS host FROM orders),
    f AS (SELECT *, CASE WHEN c % 6 = 5 OR role IN ('MEMBER', 'VIEWER') THEN 'FORBIDDEN' WHEN id % 11 = 0 THEN 'INVALID_INPUT' WHEN w = id % 900 % 40 THEN 'CONFLICT' END AS e FROM r)
    SELECT id, coalesce(e, CASE WHEN row_number() OVER (PARTITION BY w, host ORDER BY e IS NOT NULL, d, id) > 1 THEN 'CONFLICT' END) AS error FROM f"""
)
def project_requests(spark, sf_dir):
    """Every order as a request for a project in one of forty workspaces, some of which have the host name already."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    roles = F.array(*map(F.lit, ("OWNER", "ADMIN", "MEMBER", "VIEWER")))
    o = load(spark, sf_dir, "orders")
    asked = o.select(
        k.alias("id"), F.col("o_orderdate").alias("at"), (c % 40).alias("workspace_id"), c.alias("actor_id"), F.lit("x").alias("display_name"),
        F.when(k % 11 == 0, "no host").otherwise(F.concat(F.lit(" H"), k % 900, F.lit(".example.com. "))).alias("hostname"),
    )
    members = o.filter(c % 6 != 5).select((c % 40).alias("workspace_id"), c.alias("user_id"), F.get(roles, (c % 4).cast("int")).alias("role")).distinct()
    there = spark.range(900).select((F.col("id") % 40).alias("workspace_id"), F.concat(F.lit("h"), "id", F.lit(".example.com")).alias("hostname"))
    return accounts.create_projects(asked, there, members).decisions


@query(
    """WITH p AS (SELECT c_custkey AS p, c_custkey % 5 AS v, c_custkey % 3 AS s FROM customer),
    r AS (SELECT o_orderkey AS id, o_orderdate AS d, o_custkey AS p, v, s FROM orders LEFT JOIN p ON o_custkey = p.p AND o_custkey % 7 <> 0),
    f AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'FORBIDDEN' WHEN v IS NULL THEN 'NOT_FOUND' WHEN v > 0 AND s = 0 THEN 'CONFLICT' END AS e FROM r),
    g AS (SELECT *, coalesce(e, CASE WHEN row_number() OVER (PARTITION BY p ORDER BY e IS NOT NULL, d, id) > 1 THEN 'CONFLICT' END) AS error FROM f)
    SELECT id, error, CASE WHEN error IS NULL THEN v + 1 ELSE 0 END::INT AS challenge_version FROM g"""
)
def verification_rotate(spark, sf_dir):
    """Every order as a request for the next challenge of its customer's project."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    who = F.when(k % 9 == 0, "viewer").otherwise("owner")
    asked = load(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").alias("at"), F.lit("w").alias("workspace_id"), who.alias("actor_id"), c.alias("project_id"))
    members = spark.createDataFrame([("w", "viewer", "VIEWER"), ("w", "owner", "OWNER")], "workspace_id string, user_id string, role string")
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    own = customers.filter(F.col("project_id") % 7 != 0).select(F.lit("w").alias("workspace_id"), "project_id", F.concat(F.lit("h"), "project_id", F.lit(".example")).alias("hostname"))
    n = F.col("project_id") % 5
    done = customers.filter(n > 0).select("project_id", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("challenge_version"), F.when(F.col("project_id") % 3 == 0, "PENDING").otherwise("FAILED").alias("status"))
    got = accounts.rotate_challenges(asked, own, done, members, F.concat(F.lit("c"), "id"))
    rows = got.rows.select(F.substring("verification_id", 2, 20).cast("bigint").alias("id"), "challenge_version")
    return got.decisions.join(rows, "id", "left").select("id", "error", F.coalesce("challenge_version", F.lit(0)).cast("int").alias("challenge_version"))
