"""Queries of writes, guards, leases, codecs and frontier rules over whole tables, each next to its SQL.

The tables hold no such requests, so both sides make them from keys by arithmetic; what is decided is written apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import codec, html, robots, urls
from tidewatch.operators import control, frontier, operations, writes
from tidewatch.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _now(text: str = "2026-01-05"):
    return F.lit(text).cast("timestamp_ntz")


def _day(days):
    """2026-01-01 and so many days."""
    return F.expr("timestamp_ntz'2026-01-01'") + F.make_dt_interval(days=days.cast("int"))


def _shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def _one_of(number, *names):
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def _k():
    return F.col("k")

# --- writes


def _twice(spark, sf_dir):
    """Events as facts keyed by user and type: every third is stored, all are offered."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return e.filter("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts")), e


_TWICE = "WITH old AS (SELECT user_id, event_type, min(event_id) AS event_id, min(ts) AS ts FROM events WHERE event_id % 3 = 0 GROUP BY ALL) "
KEYS = ["user_id", "event_type"]


@query(
    _TWICE + "SELECT user_id, event_type, arg_min(event_id, row(ts, event_id)) AS event_id FROM events e"
    " WHERE NOT EXISTS (FROM old WHERE old.user_id = e.user_id AND old.event_type = e.event_type) GROUP BY ALL"
)
def write_new(spark, sf_dir):
    old, new = _twice(spark, sf_dir)
    return writes.insert_new(old, new, KEYS, F.col("ts"), F.col("event_id")).select(*KEYS, "event_id")


@query(_TWICE + "SELECT event_id, (user_id, event_type) IN (SELECT (user_id, event_type) FROM old) AS existed FROM events")
def write_if_absent(spark, sf_dir):
    old, new = _twice(spark, sf_dir)
    return writes.insert_if_absent(old, new, KEYS).select("event_id", "existed")


@query(
    _TWICE + ", offered AS (SELECT user_id, event_type, arg_min(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY ALL)"
    " SELECT user_id, event_type, coalesce(old.event_id, offered.event_id) AS event_id FROM offered LEFT JOIN old USING (user_id, event_type)"
)
def write_first_wins(spark, sf_dir):
    old, new = _twice(spark, sf_dir)
    return writes.first_write_wins(old, new, KEYS, F.col("ts"), F.col("event_id")).select(*KEYS, "event_id")


@query("SELECT count(*) FILTER (event_type = 'click' AND event_id % 4 <> 0) AS affected FROM events")
def write_guarded(spark, sf_dir):
    """A compare-and-set whose precondition is null on some rows: those are not touched."""
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("state"))
    return writes.guarded_update(e, F.col("state") == "click", {"state": F.lit("done")})[1]


@query("""SELECT event_id, event_type AS type, 1 AS payload_version, user_id::VARCHAR AS payload, 'PENDING' AS status, 0 AS attempts,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS available_at FROM events""")
def outbox_emit(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    row = writes.outbox_row(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id"), F.col("ts"))
    return e.select(row.alias("r")).select("r.*").withColumn("available_at", _shown(F.col("available_at")))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'w' || event_id % 3 END AS held, 'w' || event_id % 2 AS told, event_id % 5 AS word FROM events),
  a AS (SELECT *, coalesce(held = told, false) AND word < 4 AS hit FROM e)
SELECT event_id, CASE WHEN NOT hit THEN held END AS claim_token, CASE WHEN hit AND word = 0 THEN '2026-01-05 00:00:00' END AS delivered_at,
  CASE WHEN hit AND word > 0 THEN strftime(TIMESTAMP '2026-01-05' + to_seconds(word * 90), '%Y-%m-%d %H:%M:%S') ELSE '2026-01-01 00:00:00' END AS available_at FROM a""")
def outbox_ack(spark, sf_dir):
    """Answers by workers of whom some no longer hold the claim; one in five events gets no answer."""
    n = F.col("event_id")
    none = F.lit(None).cast("timestamp_ntz")
    e = load(spark, sf_dir, "events").select(n, F.when(n % 3 > 0, F.concat(F.lit("w"), n % 3)).alias("claim_token"), _now().alias("claim_until"), none.alias("delivered_at"), _now("2026-01-01").alias("available_at"))
    answers = e.filter(n % 5 < 4).select(n, F.concat(F.lit("w"), n % 2).alias("claim_token"), F.when(n % 5 > 0, n % 5 * 90).alias("delay_s"))
    out = writes.ack(e, answers, _now())
    return out.select(n, "claim_token", _shown(F.col("delivered_at")).alias("delivered_at"), _shown(F.col("available_at")).alias("available_at"))


@query("SELECT c_custkey AS k, [409, 404, 400, 500][c_custkey % 4 + 1] AS status, c_custkey::VARCHAR AS data, 'r' || c_custkey AS request_id FROM customer")
def response_envelope(spark, sf_dir):
    body = writes.envelope(_k().cast("string"), F.concat(F.lit("r"), _k()))
    code = _one_of(_k(), "UNIQUE_VIOLATION", "ROW_MISSING", "INVALID_INPUT", "ANYTHING_ELSE")
    return _customers(spark, sf_dir).select("k", writes.error_status(code).alias("status"), body["data"].alias("data"), body["request_id"].alias("request_id"))


# --- leases, deliveries, retries

_STATUS = ("QUEUED", "RUNNING", "FINALIZING", "COMPLETED", "FAILED", "CANCELLED")
_RUNS_SQL = """WITH r AS (SELECT c_custkey AS k, ['QUEUED', 'RUNNING', 'FINALIZING', 'COMPLETED', 'FAILED', 'CANCELLED'][c_custkey % 6 + 1] AS status,
  c_custkey % 7 AS token, CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2026-01-01' + to_days((c_custkey % 9)::INT) END AS expires, c_custkey % 6 < 3 AS active FROM customer) """


def _leased(spark, sf_dir):
    expires = F.when(_k() % 5 > 0, _day(_k() % 9))
    return _customers(spark, sf_dir).select(_k().alias("run_id"), _one_of(_k(), *_STATUS).alias("status"), (_k() % 7).alias("lease_token"), expires.alias("lease_expires_at"))


@query(_RUNS_SQL + """, a AS (SELECT *, active AND (expires IS NULL OR expires <= TIMESTAMP '2026-01-05') AS acquired FROM r)
SELECT k AS run_id, CASE WHEN acquired AND status <> 'FINALIZING' THEN 'RUNNING' ELSE status END AS status, token + acquired::BIGINT AS lease_token,
  strftime(CASE WHEN acquired THEN TIMESTAMP '2026-01-05 00:01:00' ELSE expires END, '%Y-%m-%d %H:%M:%S') AS lease_expires_at, acquired FROM a""")
def lease_acquire(spark, sf_dir):
    return operations.acquire_leases(_leased(spark, sf_dir), _now(), 60).withColumn("lease_expires_at", _shown(F.col("lease_expires_at")))


@query(_RUNS_SQL + """, a AS (SELECT *, active AND k % 4 > 0 AND token = k % 3 AS renewed FROM r)
SELECT k AS run_id, strftime(CASE WHEN renewed THEN TIMESTAMP '2026-01-05 00:01:00' ELSE expires END, '%Y-%m-%d %H:%M:%S') AS lease_expires_at, renewed FROM a""")
def lease_renew(spark, sf_dir):
    """Holders of whom some have been fenced off by a greater token; every fourth run has no holder."""
    runs = _leased(spark, sf_dir)
    held = runs.filter("run_id % 4 > 0").select("run_id", (F.col("run_id") % 3).alias("token"))
    return operations.renew_leases(runs, held, _now(), 60).select("run_id", _shown(F.col("lease_expires_at")).alias("lease_expires_at"), "renewed")


@query("SELECT user_id AS run_id, arg_max(event_type, event_id) AS worker, max(event_id) AS token FROM events GROUP BY user_id")
def lease_current(spark, sf_dir):
    claims = load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("worker"), F.col("event_id").alias("token"), F.col("ts").alias("expires_at"))
    return operations.current_lease(claims).select("run_id", "worker", "token")


@query(_RUNS_SQL + """SELECT k AS run_id, CASE status WHEN 'CANCELLED' THEN 'ALREADY_FINISHED' WHEN 'COMPLETED' THEN 'CONFLICT' WHEN 'FAILED' THEN 'CONFLICT' WHEN 'QUEUED' THEN 'IMMEDIATE'
  ELSE CASE WHEN expires IS NOT NULL AND expires > TIMESTAMP '2026-01-05' THEN 'COOPERATIVE' ELSE 'IMMEDIATE' END END AS outcome FROM r""")
def crawl_cancel(spark, sf_dir):
    return _leased(spark, sf_dir).select("run_id", operations.cancel(F.col("status"), F.col("lease_expires_at"), _now()).alias("outcome"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 8 > 5 THEN 'FAILED' WHEN c_custkey % 3 = 0 THEN 'DELIVERED' ELSE 'PENDING' END AS status,
  CASE WHEN c_custkey % 8 <= 5 AND c_custkey % 3 > 0 THEN 90 ELSE 0 END AS delay_s, CASE WHEN c_custkey % 8 <= 2 THEN c_custkey % 8 * 5 END AS fetch_wait_s FROM customer""")
def delivery_outcome(spark, sf_dir):
    d = operations.delivery(_k() % 8, _k() % 3 == 0)
    return _customers(spark, sf_dir).select("k", d["status"].alias("status"), d["delay_s"].alias("delay_s"), operations.fetch_retry(_k() % 8).alias("fetch_wait_s"))


# --- frontier

_STATES = ("PENDING", "FETCHING", "DONE", "FAILED")
_FRONTIER_SQL = """WITH f AS (SELECT user_id AS run_id, event_id, event_id % 3 AS depth, ['PENDING', 'FETCHING', 'DONE', 'FAILED'][event_id % 4 + 1] AS state,
  CASE WHEN event_id % 5 > 0 THEN ts END AS due FROM events) """


def _frontier(spark, sf_dir):
    n = F.col("event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), n.alias("url_key"), (n % 3).alias("depth"), _one_of(n, *_STATES).alias("state"), F.when(n % 5 > 0, F.col("ts")).alias("next_attempt_at"))


@query(_FRONTIER_SQL + """SELECT run_id, count(*) AS total, count(*) FILTER (state IN ('PENDING', 'FETCHING')) AS pending, 0::BIGINT AS fetching,
  count(*) FILTER (state = 'DONE') AS done, count(*) FILTER (state = 'FAILED') AS failed FROM f GROUP BY run_id""")
def frontier_states(spark, sf_dir):
    """Rows by state after a crash put back what was being fetched."""
    return frontier.state_counts(operations.recovered(_frontier(spark, sf_dir)))


@query(_FRONTIER_SQL + "SELECT run_id, strftime(min(due), '%Y-%m-%d %H:%M:%S') AS next_attempt_at FROM f WHERE state = 'PENDING' AND due IS NOT NULL GROUP BY run_id")
def frontier_retry(spark, sf_dir):
    return frontier.earliest_retry(_frontier(spark, sf_dir)).withColumn("next_attempt_at", _shown(F.col("next_attempt_at")))


@query(_FRONTIER_SQL + "SELECT event_id AS url_key, 1000 * (row_number() OVER (PARTITION BY run_id ORDER BY depth, event_id) - 1) AS start_ms FROM f")
def frontier_pace(spark, sf_dir):
    return frontier.paced(_frontier(spark, sf_dir)).select("url_key", F.col("start_ms").cast("bigint").alias("start_ms"))


@query("""WITH a AS (SELECT c_custkey AS k, i, i <= 3 AS https, [200, 404, 410, 503, 429, 401, 403, 301, NULL, NULL, NULL][(c_custkey + c_custkey // 11 * i) % 11 + 1] AS s,
    (c_custkey + c_custkey // 11 * i) % 11 AS kind, (c_custkey + i) % 5 > 0 AS has_body FROM customer, unnest([1, 2, 3, 4]) u(i)),
  j AS (SELECT *, CASE WHEN s = 200 AND has_body THEN 'RULES' WHEN s IN (401, 403) THEN 'DENIED' WHEN s IN (404, 410) AND NOT https THEN 'ALLOW_ALL'
    WHEN s IN (404, 410) OR s = 429 OR s >= 500 THEN NULL WHEN s IS NOT NULL OR kind = 10 THEN 'UNAVAILABLE' END AS ends FROM a),
  t AS (SELECT k, arg_min(ends, i) FILTER (https AND ends IS NOT NULL) AS https_end, bool_or(https AND s IS NOT NULL AND s NOT IN (404, 410)) AS answered, max(ends) FILTER (NOT https) AS http_end FROM j GROUP BY k)
SELECT k, coalesce(https_end, CASE WHEN coalesce(answered, false) THEN 'UNAVAILABLE' END, http_end, 'UNAVAILABLE') AS robots FROM t""")
def robots_acquire(spark, sf_dir):
    """Three https attempts and one http attempt per site, of every kind of answer."""
    i = F.col("i")
    kind = ((_k() + F.floor(_k() / 11) * i) % 11).cast("int")
    tries = _customers(spark, sf_dir).select("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("i"))
    status = F.get(F.array(*map(F.lit, (200, 404, 410, 503, 429, 401, 403, 301))), kind)
    outcome = F.when(kind < 8, "HTTP_RESPONSE").when(kind == 8, "NETWORK_ERROR").when(kind == 9, "TIMEOUT").otherwise("REDIRECT_LIMIT")
    scheme = F.when(i < 4, "https").otherwise("http")
    attempts = tries.select("k", scheme.alias("scheme"), F.when(i < 4, i).otherwise(1).alias("attempt"), outcome.alias("outcome"), status.alias("status"), ((_k() + i) % 5 > 0).alias("has_body"))
    return robots.acquired(attempts, "k")


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'https://h/sitemap.xml' WHEN 1 THEN 'https://h/a.xml https://h/sitemap.xml' ELSE 'https://h/sitemap.xml https://h/a.xml' END AS sources,
  CASE c_custkey % 2 WHEN 0 THEN '10.0.0.1 ::1' ELSE '::1' END AS addresses FROM customer""")
def sitemap_origin(spark, sf_dir):
    """Declared sitemaps and the customary one, and addresses of both kinds, each without repeats."""
    a, own = F.lit("https://h/a.xml"), F.lit("https://h/sitemap.xml")
    declared = F.when(_k() % 3 == 1, F.array(a, a)).when(_k() % 3 == 2, F.array(own, a))
    v4 = F.when(_k() % 2 == 0, F.array(F.lit("10.0.0.1")))
    found = urls.sitemap_sources(declared, F.lit("https://h")), urls.addresses(v4, F.array(F.lit("::1")))
    return _customers(spark, sf_dir).select("k", F.array_join(found[0], " ").alias("sources"), F.array_join(found[1], " ").alias("addresses"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'shop-' || c_custkey || '.example.com' WHEN 4 THEN 'x' || c_custkey || '.de' WHEN 7 THEN repeat('a', 63) || '.com' END AS hostname FROM customer""")
def hostname_valid(spark, sf_dir):
    """Names of which some are too long, unqualified, local or hold what no name may."""
    s = _k().cast("string")
    raw = (F.concat(F.lit(" Shop-"), s, F.lit(".Example.COM. ")), F.concat(F.lit("-bad"), s, F.lit(".com")), F.lit("a..b"), F.lit("host.localhost"), F.concat(F.lit("X"), s, F.lit(".de")), F.lit("unqualified"),
           F.concat(F.repeat(F.lit("a"), 64), F.lit(".com")), F.concat(F.repeat(F.lit("a"), 63), F.lit(".com")))
    return _customers(spark, sf_dir).select("k", urls.valid_hostname(F.element_at(F.array(*raw), (_k() % 8 + 1).cast("int"))).alias("hostname"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'TIMEOUT' WHEN octet_length(encode(html)) > 4096 THEN 'BODY_TOO_LARGE' ELSE 'HTTP_RESPONSE' END AS outcome FROM pages""")
def body_capped(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    outcome = F.when(F.col("page_id") % 3 == 0, "TIMEOUT").otherwise("HTTP_RESPONSE")
    return p.select("page_id", frontier.capped(outcome, F.col("html"), 4096).alias("outcome"))


@query("""WITH p AS (SELECT page_id, page_id % 2 = 0 AND page_id % 7 <> 0 AND page_id % 3 > 0 AND html IS NOT NULL AS fine, page_id % 5 > 0 AS answered FROM pages)
SELECT page_id, fine, CASE WHEN fine THEN 'KNOWN' WHEN answered THEN 'NOT_APPLICABLE' ELSE 'UNKNOWN' END AS title, 5 AS fields FROM p""")
def page_validity(spark, sf_dir):
    """Pages by content type, status, redirects and body, and the state of their fields."""
    n = F.col("page_id")
    kind = F.when(n % 2 == 0, "text/html; charset=utf-8").otherwise("application/json")
    status = F.when(n % 7 != 0, 200).when(n % 14 == 0, 404)
    hops = F.when(n % 3 == 0, F.array(F.lit("https://h/x"))).when(n % 3 == 1, F.array().cast("array<string>"))
    fine = html.eligible(kind, status, hops, F.col("html"))
    state = html.validity(F.when(n % 5 > 0, "HTTP_RESPONSE").otherwise("TIMEOUT"), fine)
    return load(spark, sf_dir, "pages").select("page_id", fine.alias("fine"), state["title"].alias("title"), F.size(state).alias("fields"))


# --- guards

_REQUEST = """WITH r AS (SELECT c_custkey AS k, ['OWNER', 'ADMIN', 'MEMBER', 'VIEWER'][c_custkey % 4 + 1] AS role, CASE WHEN c_custkey % 13 > 0 THEN repeat('k', (c_custkey * 3 % 211)::INT) END AS key FROM customer) """


@query(_REQUEST + """SELECT k, CASE WHEN role = 'VIEWER' THEN 'FORBIDDEN' WHEN key IS NULL OR length(key) = 0 OR length(key) > 200 THEN 'IDEMPOTENCY_KEY_REQUIRED' WHEN k % 17 = 0 THEN NULL
  WHEN k % 19 = 0 THEN 'NOT_FOUND' WHEN k % 11 = 0 THEN 'ARCHIVED' WHEN k % 7 = 0 THEN 'NOT_VERIFIED' WHEN k % 23 = 0 THEN 'NO_POLICY' WHEN k % 5 = 0 THEN 'ALREADY_ACTIVE' WHEN k % 12 >= 10 THEN 'DAILY_LIMIT'
  WHEN k % 600 < 300 THEN 'SPACING' END AS error FROM r""")
def crawl_create(spark, sf_dir):
    r = _customers(spark, sf_dir).select(
        "k", _one_of(_k(), *control.ROLES).alias("role"), F.when(_k() % 13 > 0, F.repeat(F.lit("k"), (_k() * 3 % 211).cast("int"))).alias("key"), (_k() % 17 == 0).alias("replay"), (_k() % 19 != 0).alias("project_exists"),
        (_k() % 11 == 0).alias("archived"), F.when(_k() % 7 == 0, "NOT_VERIFIED").alias("block_reason"), (_k() % 23 != 0).alias("has_policy"), (_k() % 5 == 0).alias("active"), (_k() % 12).alias("runs_today"),
        (_k() % 600).alias("seconds_since_last"),
    )
    return operations.create_crawl(r).select("k", "error")


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 9 <= 4 AS gone FROM customer)
SELECT k, CASE WHEN gone THEN 'INVALID_INVITATION' WHEN k % 4 = 0 THEN 'EMAIL_UNVERIFIED' WHEN k % 3 = 0 THEN 'EMAIL_MISMATCH' WHEN k % 13 = 0 THEN 'CONFLICT' WHEN k % 2 = 0 THEN 'ALREADY_MEMBER' END AS error,
  CASE WHEN gone THEN 400 WHEN k % 4 = 0 OR k % 3 = 0 THEN 403 WHEN k % 13 = 0 OR k % 2 = 0 THEN 409 ELSE 200 END AS status FROM r""")
def invitation_accept(spark, sf_dir):
    r = _customers(spark, sf_dir).select(
        "k", (_k() % 11 != 0).alias("found"), (_k() % 7 == 0).alias("revoked"), (_k() % 5 == 0).alias("consumed"), _day(_k() % 9).alias("expires_at"), (_k() % 4 != 0).alias("email_verified"), F.lit("A@x.example").alias("email"),
        F.when(_k() % 3 == 0, "b@x.example").otherwise("a@X.example").alias("invited_email"), (_k() % 13 == 0).alias("lost_race"), (_k() % 2 == 0).alias("already_member"),
    )
    return control.accept_invitation(r, _now()).select("k", "error", "status")


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS policy_id FROM customer),
  v AS (SELECT o_custkey AS k, max(o_orderkey) AS version, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT k, policy_id AS current_policy_id, n_name AS policy_name, version AS challenge_version FROM p LEFT JOIN nation ON n_nationkey = policy_id LEFT JOIN v USING (k)""")
def project_views(spark, sf_dir):
    """Customers as projects, nations as policies, orders as verifications."""
    projects = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("current_policy_id"))
    policies = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("policy_id"), F.lit("any").alias("project_id"), F.col("n_name").alias("policy_name"))
    checks = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("challenge_version"))
    return control.project_view(projects, policies, checks).select(F.col("project_id").alias("k"), "current_policy_id", "policy_name", "challenge_version")


@query("""SELECT c_nationkey AS workspace_id, count(*) FILTER (c_custkey % 4 = 0) AS owners, max(n_name) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey""")
def workspace_owners(spark, sf_dir):
    """Owners of each workspace that has members, through the memberships with their user and workspace."""
    c = load(spark, sf_dir, "customer")
    members = c.select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("user_id"), _one_of(F.col("c_custkey"), *control.ROLES).alias("role"))
    users = c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    spaces = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("name"))
    joined = control.memberships(members, users, spaces)
    return control.owners(joined).join(joined.groupBy("workspace_id").agg(F.max("name").alias("name")), "workspace_id")


@query("SELECT o_custkey AS project_id, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY o_custkey")
def verification_next(spark, sf_dir):
    checks = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("challenge_version"))
    return control.next_challenge_version(checks)


@query("""SELECT c_custkey AS k, upper(['get', 'HEAD', 'options', 'POST', 'DELETE'][c_custkey % 5 + 1]) IN ('GET', 'HEAD', 'OPTIONS') OR c_custkey % 4 IN (0, 1) AS passes FROM customer""")
def origin_guard(spark, sf_dir):
    origin = F.when(_k() % 4 == 1, "https://APP.example").when(_k() % 4 == 2, "null").when(_k() % 4 == 3, "https://evil.example")
    return _customers(spark, sf_dir).select("k", control.same_origin(_one_of(_k(), "get", "HEAD", "options", "POST", "DELETE"), origin, F.lit("https://app.example")).alias("passes"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey = 7 THEN '2026-01-05 00:00:00' WHEN c_custkey % 3 = 0 THEN '2026-01-02 00:00:00' END AS suppressed_until,
  CASE WHEN c_custkey % 2 = 0 THEN '2026-01-02 00:00:00' WHEN c_custkey = 9 THEN '2026-01-05 00:00:00' END AS archived_at FROM customer""")
def overlays(spark, sf_dir):
    """One issue suppressed, two projects archived of which one was so already: that one keeps its time."""
    rows = _customers(spark, sf_dir).select("k", F.when(_k() % 3 == 0, _day(F.lit(1))).alias("suppressed_until"), F.when(_k() % 2 == 0, _day(F.lit(1))).alias("archived_at"), _k().alias("issue_id"), _k().alias("project_id"))
    out = control.archive(control.archive(control.suppress(rows, 7, _now()), 9, _now()), 10, _now())
    return out.select("k", _shown(F.col("suppressed_until")).alias("suppressed_until"), _shown(F.col("archived_at")).alias("archived_at"))


# --- codecs


@query("""SELECT c_custkey AS k, '_check.host' || c_custkey || '.example' AS name, c_custkey % 4 IN (0, 1) AS matches, c_custkey % 40 > 4 AS valid FROM customer""")
def challenge_check(spark, sf_dir):
    """Records in chunks with white space around, in another case, or of someone else; verified 31 to -8 days ago."""
    value = F.concat(F.lit("v="), _k())
    chunks = F.when(_k() % 4 == 0, F.array(F.lit("\t v="), _k().cast("string"), F.lit(" \r\n"))).when(_k() % 4 == 1, F.array(value)).when(_k() % 4 == 2, F.array(F.upper(value))).otherwise(F.array(value, F.lit("0")))
    matches = codec.matches_challenge(F.array(F.array(F.lit("spf")), chunks), value)
    valid = codec.is_verified(_day(_k() % 40), _now("2026-02-04"))
    return _customers(spark, sf_dir).select("k", codec.challenge_name("_check", F.concat(F.lit("HOST"), _k(), F.lit(".Example"))).alias("name"), matches.alias("matches"), valid.alias("valid"))


@query("""SELECT c_custkey AS k, sha256('t' || c_custkey) AS token_hash, c_custkey % 9 <= 1 AS expired, sha256('POST' || chr(31) || c_custkey) AS request_hash FROM customer""")
def invitation_token(spark, sf_dir):
    """Tokens given out up to eight days ago: 72 hours are over at their end."""
    return _customers(spark, sf_dir).select(
        "k", codec.token_hash(F.concat(F.lit("t"), _k())).alias("token_hash"), codec.is_expired(codec.invitation_expiry(_day(_k() % 9)), _now()).alias("expired"), codec.request_hash(F.lit("POST"), _k().cast("string")).alias("request_hash")
    )


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 AND c_custkey > 0 THEN c_custkey / 2 ELSE 20 END::DOUBLE AS timeout FROM customer")
def policy_number(spark, sf_dir):
    """A number, a negative one, zero, a string, a truth value, null, nothing."""
    s = _k().cast("string")
    value = F.when(_k() % 7 == 0, (_k() / 2).cast("string")).when(_k() % 7 == 1, F.concat(F.lit("-"), s)).when(_k() % 7 == 2, "0").when(_k() % 7 == 3, F.concat(F.lit('"'), s, F.lit('"'))).when(_k() % 7 == 4, "true").when(_k() % 7 == 5, "null")
    config = F.when(value.isNull(), "{}").otherwise(F.concat(F.lit('{"timeout": '), value, F.lit("}")))
    return _customers(spark, sf_dir).select("k", codec.positive_number(config, "timeout", 20).alias("timeout"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '10.0.0.' || c_custkey WHEN 1 THEN '' WHEN 2 THEN 'peer' WHEN 3 THEN 'peer' ELSE 'unknown' END AS client,
  CASE WHEN c_custkey % 150 = 0 OR c_custkey % 2 = 1 THEN 50 ELSE least(c_custkey % 150, 100) END::BIGINT AS take FROM customer""")
def request_params(spark, sf_dir):
    forwarded = F.when(_k() % 5 == 0, F.concat(F.lit(" 10.0.0."), _k(), F.lit(" , 1.1.1.1"))).when(_k() % 5 == 1, " , 1.1.1.1").when(_k() % 5 == 2, "")
    size = F.when(_k() % 2 == 0, _k() % 150 + F.lit(0.5) * (_k() % 150 > 0).cast("int"))
    return _customers(spark, sf_dir).select("k", codec.client_key(forwarded, F.when(_k() % 5 < 4, "peer")).alias("client"), codec.page_size(size).alias("take"))
