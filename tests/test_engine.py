"""Fixture cases of the operators, as small DataFrames."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import codec, netclass, urls
from tidewatch.functions.html import eligible, extract_page, index_state, is_html, page_index_state
from tidewatch.functions.robots import acquisition, parse_robots, specificity
from tidewatch.functions.sitemap import parse_sitemap
from tidewatch.operators import control, diff, frontier, health, operations, publish, reports, rules, writes

SNAP = "url string, status_code int, robots string, canonical string, title string, meta_description string, internal_links_count int"


def snap(url, **kw):
    base = {"status_code": 200, "robots": "index", "canonical": url, "title": "Title", "meta_description": "Description", "internal_links_count": 10} | kw
    return (url, *base.values())


def test_snapshot_diff(spark):
    prev = spark.createDataFrame([snap("a"), snap("removed")], SNAP)
    cur = spark.createDataFrame([snap("a", status_code=404, robots="noindex", title="New title"), snap("new")], SNAP)
    events = diff.snapshot_diff(prev, cur)
    got = {(r.url, r.change_type, r.severity) for r in events.collect()}
    assert got == {("a", "HTTP_STATUS_CHANGED", "CRITICAL"), ("a", "ROBOTS_CHANGED", "CRITICAL"), ("a", "TITLE_CHANGED", "WARNING"), ("new", "URL_ADDED", "INFO"), ("removed", "URL_REMOVED", "INFO")}
    s = diff.summarize(events, page=None).collect()[0]
    assert (s.total, s.critical, s.warning, s.info) == (5, 2, 1, 2)
    assert diff.snapshot_diff(prev, prev).count() == 0
    gone = diff.snapshot_diff(spark.createDataFrame([snap("a")], SNAP), spark.createDataFrame([snap("a", status_code=410)], SNAP)).collect()
    assert [(r.change_type, r.severity) for r in gone] == [("HTTP_STATUS_CHANGED", "INFO")]


OBS = (
    "project_id string, policy_id string, run_id string, run_no long, page_id string, identity_url string, fetch_outcome string, initial_status int, title string, meta_description string, "
    "canonical struct<raw:array<string>,resolved:array<string>>, robots struct<raw:array<string>,index:string>, internal_links_count long, field_validity map<string,string>, base_run_id string, fetched_at timestamp_ntz"
)
FIELDS = ("title", "metaDescription", "canonical", "robots", "internalLinksCount")


def obs(page, run=2, base="r1", validity="KNOWN", policy="p1", project="w", **kw):
    v = {f: validity for f in FIELDS} if isinstance(validity, str) else validity
    base_row = {
        "fetch_outcome": "HTTP_RESPONSE", "initial_status": 200, "title": "Title", "meta_description": "D", "canonical": {"raw": ["u"], "resolved": ["u"]}, "robots": {"raw": [], "index": "ALLOWED"}, "internal_links_count": 1,
    } | kw
    return (project, policy, f"r{run}", run, page, f"https://x/{page}", *base_row.values(), v, base, dt.datetime(2026, 1, run))


def diffs(spark, base_rows, rows):
    d = diff.observation_diff(spark.createDataFrame(rows, OBS), spark.createDataFrame(base_rows, OBS))
    return sorted((r.page_id, r.change_type, r.severity) for r in d.collect())


def test_observation_diff(spark):
    base = [obs("a", 1), obs("b", 1)]
    assert diffs(spark, base, [obs("a", initial_status=404, title="New"), obs("b", robots={"raw": ["noindex"], "index": "DISALLOWED"})]) == [
        ("a", "HTTP_STATUS_CHANGED", "CRITICAL"), ("a", "TITLE_CHANGED", "WARNING"), ("b", "ROBOTS_CHANGED", "CRITICAL"),
    ]
    empty = {"title": None, "meta_description": None, "canonical": None, "robots": None, "internal_links_count": None}
    assert diffs(spark, base, [obs("a", initial_status=500, validity="UNKNOWN", **empty)]) == [("a", "HTTP_STATUS_CHANGED", "CRITICAL")]
    assert diffs(spark, base, [obs("a", initial_status=301, validity="NOT_APPLICABLE", **empty)]) == [("a", "HTTP_STATUS_CHANGED", "INFO")]
    assert diffs(spark, base, [obs("a"), obs("new")]) == [("new", "URL_ADDED", "INFO")]
    assert diffs(spark, [], [obs("a", base=None)]) == []
    assert diffs(spark, [obs("a", 1, validity={"title": "UNKNOWN"})], [obs("a", title="New")]) == []
    two = {"raw": [], "resolved": ["a", "b"]}
    assert diffs(spark, [obs("a", 1, canonical=two)], [obs("a", canonical={"raw": [], "resolved": ["b", "a", "a"]})]) == []
    assert diffs(spark, [obs("a", 1, canonical=two)], [obs("a", canonical={"raw": [], "resolved": ["a"]})]) == [("a", "CANONICAL_CHANGED", "WARNING")]
    assert diffs(spark, base, [obs("a"), obs("b")]) == []


def test_rules(spark):
    rows = [
        obs("404", initial_status=404), obs("301", initial_status=301), obs("lost", fetch_outcome="NETWORK_ERROR", initial_status=None, validity=None, robots=None, title=None, canonical=None),
        obs("no", robots={"raw": ["a", "noindex"], "index": "DISALLOWED"}), obs("dim", robots={"raw": [], "index": "UNKNOWN"}), obs("untitled", title=None, canonical={"raw": [], "resolved": []}),
        obs("bad", canonical={"raw": ["::bad::"], "resolved": []}), obs("two", canonical={"raw": ["x", "y"], "resolved": ["x", "y"]}), obs("same", canonical={"raw": ["x", "x"], "resolved": ["x", "x"]}),
    ]
    got = {(r.page_id, r.rule_key): (r.verdict, r.evidence) for r in rules.evaluate(rules.rule_input(spark.createDataFrame(rows, OBS))).collect()}
    v = lambda p, k: got[p, k][0]
    assert (v("404", "http_4xx_5xx"), v("301", "http_4xx_5xx"), v("lost", "http_4xx_5xx")) == ("PRESENT", "ABSENT", "UNKNOWN")
    assert (v("no", "noindex_on_indexable"), v("404", "noindex_on_indexable"), v("dim", "noindex_on_indexable"), v("lost", "noindex_on_indexable")) == ("PRESENT", "ABSENT", "UNKNOWN", "UNKNOWN")
    assert (v("untitled", "missing_title"), v("404", "missing_title"), v("lost", "missing_title")) == ("PRESENT", "ABSENT", "UNKNOWN")
    assert [v(p, "canonical_conflict") for p in ("untitled", "bad", "two", "same", "lost")] == ["ABSENT", "PRESENT", "PRESENT", "ABSENT", "UNKNOWN"]
    assert got["no", "noindex_on_indexable"][1] == {"robots": "a, noindex"} and got["bad", "canonical_conflict"][1]["problem"] == "invalid"


def test_state_machine(spark):
    cases = [(None, "PRESENT", "OPEN", False), (None, "ABSENT", None, False), ("OPEN", "UNKNOWN", "OPEN", False), ("OPEN", "ABSENT", "RESOLVED", False), ("RESOLVED", "UNKNOWN", "RESOLVED", False), ("RESOLVED", "PRESENT", "OPEN", True), ("OPEN", "PRESENT", "OPEN", False), ("RESOLVED", "ABSENT", "RESOLVED", False)]
    df = spark.createDataFrame(cases, "s string, v string, want string, again boolean")
    for r in df.select("*", rules.next_state(F.col("s"), F.col("v")).alias("got"), rules.reopens(F.col("s"), F.col("v")).alias("re")).collect():
        assert (r.got, r.re) == (r.want, r.again)


def test_health(spark):
    cases = [
        (10, 10, {}, 100), (5, 5, {"http_4xx_5xx": 1}, 60), (20, 20, {"http_4xx_5xx": 1}, 90), (6, 6, {"http_4xx_5xx": 1, "noindex_on_indexable": 1}, 46),
        (10, 10, dict.fromkeys(health.WEIGHTS, 10), 0), (2, 2, {"http_4xx_5xx": 5}, 60), (1, 3, {"http_4xx_5xx": 1}, None), (1, 2, {}, 100), (0, 0, {}, None), (0, 4, {"missing_title": 2}, None),
        (10, 10, {"future_rule": 10}, 100), (-5, 2.7, {"http_4xx_5xx": -3}, None),
    ]
    df = spark.createDataFrame([(float(e), float(o), {k: float(x) for k, x in m.items()}, s) for e, o, m, s in cases], "evaluated double, observed double, open_by_rule map<string,double>, want int")
    rows = health.health(df).collect()
    assert all(r.score == r.want for r in rows)
    assert rows[10].unrecognized == ["future_rule"] and rows[6].reason == "INSUFFICIENT_COVERAGE"
    grades = spark.createDataFrame([(100,), (90,), (89,), (75,), (74,), (50,), (49,), (0,)], "s int").select(health.grade(F.col("s"))).collect()
    assert [g[0] for g in grades] == ["good", "good", "fair", "fair", "poor", "poor", "critical", "critical"]


def golden():
    status = {("/gone-later", 2): 404}
    noindex = {("/b", 1), ("/b", 4), *(("/noindex-page", n) for n in range(1, 5))}
    out = []
    for run in range(1, 5):
        for path in ("/", "/a", "/b", "/gone-later", "/noindex-page", "/c"):
            if path == "/c" and run == 1:
                continue
            code = status.get((path, run), 200)
            blocked = (path, run) in noindex
            kw = {"initial_status": code, "title": ("A v1" if run == 1 else "A v2") if path == "/a" else path, "internal_links_count": (1 if run == 1 else 2) if path == "/" else 0}
            kw["robots"] = {"raw": ["noindex"] if blocked else [], "index": "DISALLOWED" if blocked else "ALLOWED"}
            if code != 200:
                kw |= {"title": None, "meta_description": None, "canonical": None, "robots": None, "internal_links_count": None, "validity": "NOT_APPLICABLE"}
            out.append(obs(path, run, None, **kw))
    return out


def test_golden_four_crawls(spark):
    p = publish.publish(spark.createDataFrame(golden(), OBS).drop("base_run_id"))
    s = {r.run_no: r for r in p.summary.collect()}
    assert [(s[n].comparison_mode, s[n].base_run_id) for n in s] and s[1].comparison_mode == "BASELINE" and s[2].base_run_id == "r1" and s[4].base_run_id == "r3"
    assert [(s[n].total, s[n].critical, s[n].warning, s[n].info, s[n].affected_pages) for n in range(1, 5)] == [(0, 0, 0, 0, 0), (5, 1, 1, 3, 5), (1, 0, 0, 1, 1), (1, 1, 0, 0, 1)]
    assert [(s[n].issues_open, s[n].issues_resolved) for n in range(1, 5)] == [(2, 0), (2, 1), (1, 1), (2, 0)]
    assert [s[n].health_score for n in range(1, 5)] == [75, 46, 79, 75]
    b = p.states.filter("page_id = '/b' and run_no = 4 and rule_key = 'noindex_on_indexable'").collect()[0]
    assert (b.state, b.occurrence) == ("OPEN", 2)
    assert rules.transitions(p.states).filter("page_id = '/b'").count() == 3


def test_urls_and_addresses(spark):
    n = urls.normal
    assert n("HTTPS://Example.COM:443/a/?utm_source=x&b=2&a=1&a=1#top") == "https://example.com/a/?utm_source=x&b=2&a=1&a=1"
    assert n("https://example.com/a/?UTM_Source=x&b=2", strip=True) == "https://example.com/a/?b=2"
    assert n("http://Example.com:80/a") == "http://example.com/a" and n("../pricing/", "https://example.com/docs/start") == "https://example.com/pricing/"
    blocked = "localhost localhost. app.localhost 127.0.0.1 10.2.3.4 172.16.0.2 192.168.1.2 169.254.169.254 0.0.0.0 100.64.1.1 192.0.2.4 198.51.100.7 203.0.113.5 198.18.0.5 224.0.0.1 240.1.2.3 0x7f000001 2130706433 0177.0.0.1 127.1 [::1] [::] [::ffff:127.0.0.1] [::10.2.3.4] [fe80::1] [FC00::1] [ff02::1] [64:ff9b::7f00:1] [2002:7f00:1::] [2001::1] [2001:db8::1]".split()
    assert all(urls.safety(f"https://{h}/") == "BLOCKED_HOST" for h in blocked), [h for h in blocked if urls.safety(f"https://{h}/") != "BLOCKED_HOST"]
    assert all(urls.safety(f"https://{h}/") is None for h in ("fcbank.example.com", "example.com.", "8.8.8.8", "[2606:4700::6810:85e5]", "172.32.1.1")) and urls.safety("http://example.com:80/") is None
    assert [urls.safety(u) for u in ("ftp://x/", "https://u:p@x.example/", "https://x.example:8443/")] == ["UNSUPPORTED_PROTOCOL", "CREDENTIALS_NOT_ALLOWED", "NON_DEFAULT_PORT"]
    assert [netclass.classify(a) for a in ("8.8.8.8", "10.0.0.1", "::ffff:127.0.0.1", "64:ff9b::7f00:1", "2002:7f00:1::", "fd12:3456:789a::1", "fe80::1", "name")] == ["PUBLIC", "PRIVATE", "LOOPBACK", "LOOPBACK", "LOOPBACK", "PRIVATE", "LINK_LOCAL", None]
    r = random.Random(5)
    cases = [("".join(r.choice(["HTTP://", "https://"])) + r.choice(["Ex.com", "a.b-c.org"]) + r.choice(["", ":80", ":443", ":8080"]) + r.choice(["", "/", "/A/b?x=1&utm_source=q", "?q", "/a#f", "#f"]),) for _ in range(60)]
    rows = spark.createDataFrame(cases, "u string").select("u", urls.identity(F.col("u")).alias("i"), urls.strip_tracking(urls.identity(F.col("u"))).alias("s")).collect()
    assert all(x.i == urls.normal(x.u) and x.s == urls.normal(x.u, strip=True) for x in rows), [(x.u, x.i, urls.normal(x.u)) for x in rows if x.i != urls.normal(x.u)][:3]
    dns = spark.createDataFrame([([],), (["PUBLIC"],), (["PUBLIC", "PRIVATE"],)], "c array<string>").select(netclass.dns_outcome(F.col("c"))).collect()
    assert [d[0] for d in dns] == ["NETWORK_ERROR", None, "SECURITY_BLOCKED"]


def test_extraction_and_sitemaps(spark):
    page = (
        '<html><head><base href="/docs/"><title> Docs Home </title><meta name="description" content="Guide"><link rel="canonical" href="https://example.com/docs"><link rel="canonical" href="/other">'
        '<meta name="robots" content="index, follow"></head><body><a href="start">s</a><a href="/pricing/">p</a><a href="/pricing/">p</a><a href="https://ext.example/">e</a><a href="mailto:a@b">m</a><a href="#top">t</a></body></html>'
    )
    got = extract_page(page, "https://example.com/docs/")
    assert got == ("Docs Home", "Guide", ["https://example.com/docs", "/other"], ["https://example.com/docs", "https://example.com/other"], ["index, follow"], ["https://example.com/docs/start", "https://example.com/pricing/"], 2)
    assert extract_page("", "https://x/") == (None, None, [], [], [], [], 0)
    df = spark.createDataFrame([([],), (["follow"],), (["noindex, follow"],), (["none"],), (["index", "noindex"],)], "s array<string>")
    assert [r[0] for r in df.select(index_state(F.col("s"))).collect()] == ["UNKNOWN", "ALLOWED", "DISALLOWED", "DISALLOWED", "DISALLOWED"]
    assert df.select(page_index_state(F.col("s"), F.lit(None).cast("string"))).collect()[0][0] == "ALLOWED"
    types = spark.createDataFrame([("text/html; charset=utf-8",), ("application/xhtml+xml",), ("application/pdf",), (None,)], "t string").select(is_html(F.col("t"))).collect()
    assert [t[0] for t in types] == [True, True, False, False]
    assert spark.range(1).select(eligible(F.lit("text/html"), F.lit(200), F.array().cast("array<string>"), F.lit("x"))).collect()[0][0]
    assert parse_sitemap("<urlset xmlns='x'><url><loc> a </loc></url><url><loc>b</loc></url></urlset>") == ("URLSET", ["a", "b"])
    assert parse_sitemap("<sitemapindex><sitemap><loc>s1.xml</loc></sitemap></sitemapindex>") == ("INDEX", ["s1.xml"]) and parse_sitemap("<html></html>")[0] == parse_sitemap("<a")[0] == "UNKNOWN"


def test_robots(spark):
    groups, maps = parse_robots("Disallow: /early\nUser-agent: A\nUser-agent: B\nDisallow: /x # c\nUser-agent: *\nDisallow:\nSitemap: s")
    assert [g["agents"] for g in groups] == [["a", "b"], ["*"]] and groups[1]["rules"] == [{"allow": False, "path": ""}] and maps == ["s"]
    odd = spark.createDataFrame([(r"/a\Eb(", r"/a\Eb(c", 6), ("/a.b", "/axb", -1), ("/**x", "/qqx", 4)], "p string, u string, n int")
    assert all(r[0] == r[1] for r in odd.select(specificity(F.col("p"), F.col("u")), "n").collect())
    a = lambda *x: acquisition(*(F.lit(v) for v in x))
    row = spark.range(1).select(a("https", 1, "HTTP_RESPONSE", 200, True), a("https", 3, "HTTP_RESPONSE", 404, True), a("http", 1, "HTTP_RESPONSE", 404, True), a("https", 1, "HTTP_RESPONSE", 403, True), a("https", 1, "TIMEOUT", None, False), a("https", 3, "HTTP_RESPONSE", 503, True)).collect()[0]
    assert list(row) == ["RULES", "FALLBACK_HTTP", "ALLOW_ALL", "DENIED", "RETRY", "UNAVAILABLE"]


def test_frontier(spark):
    links = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("t", "a", "z")], "scope string, source string, target string")
    start = spark.createDataFrame([("s", "a"), ("t", "a")], "scope string, node string")
    got = {(r.scope, r.node, r.depth) for r in frontier.breadth_first(start, links, 2).collect()}
    assert got == {("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("t", "a", 0), ("t", "z", 1)}
    docs = spark.createDataFrame([(f"i{n}", "INDEX", [f"i{n + 1}"]) for n in range(6)], "url string, kind string, urls array<string>")
    found, state = frontier.sitemap_walk(spark.createDataFrame([("s", "i0")], "scope string, root string"), docs)
    assert found.count() == 0 and (state.collect()[0].documents, state.collect()[0].truncated) == (4, True)
    big = spark.createDataFrame([("r", "URLSET", [f"u{i}" for i in range(20_050)])], "url string, kind string, urls array<string>")
    found, state = frontier.sitemap_walk(spark.createDataFrame([("s", "r")], "scope string, root string"), big)
    assert found.count() == 20_000 and state.collect()[0].truncated


def test_operations(spark):
    base = dt.datetime(2026, 9, 1)
    times = [(i, "p", base + dt.timedelta(minutes=6 * i)) for i in range(12)] + [(20, "q", base), (21, "q", base + dt.timedelta(minutes=4))]
    got = {r.id: r.refused for r in operations.crawl_quota(spark.createDataFrame(times, "id long, project_id string, created_at timestamp_ntz")).collect()}
    assert [got[i] for i in (0, 9, 10, 11, 20, 21)] == [None, None, "DAILY_LIMIT", "DAILY_LIMIT", None, "SPACING"]
    tries = [(i, "u", base + dt.timedelta(seconds=i)) for i in range(22)] + [(30, "u", base + dt.timedelta(seconds=901)), (31, "o", base)]
    ok = {r.id: r.allowed for r in operations.rate_limit(spark.createDataFrame(tries, "id long, subject string, ts timestamp_ntz"), *operations.LIMITS["sign-in/email"]).collect()}
    assert [ok[i] for i in (0, 19, 20, 21, 30, 31)] == [True, True, False, False, True, True]
    s = [("p", dt.datetime(2026, 1, 1), 7, True, False, False, True, True), ("busy", dt.datetime(2026, 1, 15), 7, True, False, True, True, True), ("off", dt.datetime(2026, 1, 15), 7, False, False, False, True, True)]
    occ = operations.schedule_scan(spark.createDataFrame(s, "project_id string, next_run_at timestamp_ntz, interval_days int, enabled boolean, archived boolean, busy boolean, has_policy boolean, verified boolean"), F.lit("2026-01-15").cast("timestamp_ntz"))
    assert sorted(r.status for r in occ.filter("project_id = 'p'").collect()) == ["SKIPPED_MISSED", "SKIPPED_MISSED", "TRIGGERED"] and [r.status for r in occ.filter("project_id = 'busy'").collect()] == ["SKIPPED_BUSY"]
    runs = [(f"r{i}", "p", "COMPLETED", base - dt.timedelta(days=60 - i), None, None) for i in range(3)]
    r = spark.createDataFrame(runs, "run_id string, project_id string, status string, finished_at timestamp_ntz, base_run_id string, details_expired_at timestamp_ntz")
    prot = operations.protected_runs(spark.createDataFrame([("p", "r2")], "project_id string, latest_published_run_id string"), r)
    now = F.lit(base).cast("timestamp_ntz")
    assert {x.run_id for x in operations.retention_plan(r, prot, now, days=30).collect()} == {"r0", "r1"} == {x.run_id for x in operations.retention_plan(r, prot, now, days=90, keep=1).collect()}
    q = [(1, "k", base, "h"), (2, "k", base + dt.timedelta(hours=1), "h"), (3, "k", base + dt.timedelta(hours=2), "x"), (4, "k", base + dt.timedelta(hours=24), "x")]
    req = spark.createDataFrame([(i, "a", "w", "r", k, t, h) for i, k, t, h in q], "id long, actor_id string, workspace_id string, route string, key string, ts timestamp_ntz, request_hash string")
    assert {x.id: x.outcome for x in operations.idempotency(req).collect()} == {1: "RUN", 2: "REPLAY", 3: "CONFLICT", 4: "RUN"}


def test_codecs_and_control(spark):
    assert [codec.clamp_page_size(x) for x in (None, 0, -5, 10, 500, 0.5)] == [50, 50, 50, 10, 100, 0]
    two = spark.createDataFrame([(dt.datetime(2026, 9, 6, 10), "abc123"), (dt.datetime(2026, 9, 6, 10), "abc|123")], "t timestamp, i string")
    back = [r.c for r in two.select(codec.decode_cursor(codec.encode_cursor(F.col("t"), F.col("i"))).alias("c")).collect()]
    assert back[0].id == "abc123" and back[1] is None  # the last | separates, so an id with one leaves no time before it
    bad = spark.createDataFrame([(None,), ("",), ("!!!not-base64url",), ("bm8gcGlwZQ",)], "c string").select(codec.decode_cursor(F.col("c"))).collect()
    assert all(b[0] is None for b in bad)
    entries = [("authToken", "string", "x"), ("note", "string", "n" * 300), ("deep", "object", "{}"), ("ok", "boolean", "true")] + [(f"k{i}", "number", "1") for i in range(30)]
    got = spark.createDataFrame([(entries,)], "e array<struct<key:string,kind:string,value:string>>").select(codec.redact(F.col("e")).alias("d")).collect()[0].d
    assert set(got) == {"note", "ok", *(f"k{i}" for i in range(16))} and len(got["note"]) == 201
    match = spark.createDataFrame([([["a", "b "]],), ([["AB"]],)], "r array<array<string>>").select(codec.matches_challenge(F.col("r"), F.lit("ab"))).collect()
    assert [m[0] for m in match] == [True, False]
    m = {(r.role, r.action): r.allowed for r in control.role_matrix(spark).collect()}
    assert len(m) == 20 and m["VIEWER", "view"] and not m["VIEWER", "run-crawl"] and m["ADMIN", "manage-members"] and not m["ADMIN", "manage-owners"]
    now = F.lit("2026-08-31 00:00:01").cast("timestamp_ntz")
    g = spark.createDataFrame([(None, "ACTIVE"), (dt.datetime(2026, 8, 1), "PENDING"), (dt.datetime(2026, 8, 1), "ACTIVE"), (dt.datetime(2026, 8, 2), "ACTIVE")], "v timestamp_ntz, s string").select(control.crawl_block_reason(F.col("v"), F.col("s"), now)).collect()
    assert [x[0] for x in g] == ["NOT_VERIFIED", "NOT_ACTIVE", "VERIFICATION_EXPIRED", None]


def test_paging_visits_each_row_once(spark):
    same = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(f"{i:03d}", same if i % 3 else same + dt.timedelta(days=i)) for i in range(60)], "id string, created_at timestamp_ntz")
    seen, cursor = [], None
    for _ in range(10):
        rows = reports.page(df, 13, cursor).collect()
        seen += [r.id for r in rows]
        if not rows[0].has_more:
            break
        last = min(rows, key=lambda r: (r.created_at, r.id))
        cursor = (F.lit(last.created_at).cast("timestamp_ntz"), last.id)
    assert sorted(seen) == [f"{i:03d}" for i in range(60)]


def test_writes(spark):
    have = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    assert sorted((r.k, r.v) for r in writes.first_write_wins(have, new, ["k"], F.col("v")).collect()) == [(1, "a"), (2, "c")]
    out, n = writes.guarded_update(have, F.col("k") == 1, {"v": F.lit("z")})
    assert out.collect()[0].v == "z" and n.collect()[0].affected == 1


@pytest.mark.parametrize("case", [("forced", "ROBOTS_DENIED", "FAILED"), ("cancelled", True, "CANCELLED")])
def test_completeness_cascade(spark, case):
    base = {"forced_failure": None, "cancelled": False, "http_count": 3, "security_blocked": True, "body_exceeded": True, "limit_reached": True, "unrecovered": True}
    base["forced_failure" if case[0] == "forced" else case[0]] = case[1]
    df = spark.createDataFrame([tuple(base.values())], "forced_failure string, cancelled boolean, http_count int, security_blocked boolean, body_exceeded boolean, limit_reached boolean, unrecovered boolean")
    assert publish.completeness(df).collect()[0].status == case[2]


def test_crawl_loop(spark):
    from tidewatch.operators.crawl import crawl

    link = lambda *to: "<title>t</title>" + "".join(f'<a href="{t}">x</a>' for t in to)
    site = {"/": link("/a", "/blocked"), "/a": link("/b", "/missing"), "/b": link("/"), "/blocked": link(), "/pdf": "x"}
    rows = [(f"https://s.example{p}", 200, "application/pdf" if p == "/pdf" else "text/html", None, [], b) for p, b in site.items()]
    responses = spark.createDataFrame(rows, "url string, status int, content_type string, x_robots_tag string, redirects array<string>, body string")
    rules = spark.createDataFrame([("s.example", "/blocked", False)], "host string, rule_path string, allow boolean")
    seeds = spark.createDataFrame([("r", "https://s.example/"), ("r", "https://s.example/pdf")], "run_id string, url string")
    done, state = crawl(seeds, responses, rules)
    got = {r.url.removeprefix("https://s.example"): (r.fetch_outcome, r.depth, r.field_validity["title"]) for r in done.collect()}
    assert got == {
        "/": ("HTTP_RESPONSE", 0, "KNOWN"), "/pdf": ("HTTP_RESPONSE", 0, "NOT_APPLICABLE"), "/a": ("HTTP_RESPONSE", 1, "KNOWN"), "/blocked": ("ROBOTS_BLOCKED", 1, "UNKNOWN"),
        "/b": ("HTTP_RESPONSE", 2, "KNOWN"), "/missing": ("NETWORK_ERROR", 2, "UNKNOWN"),
    }
    assert [(r.observed, r.limit_reached) for r in state.collect()] == [(6, False)]
    assert [(r.observed, r.limit_reached) for r in crawl(seeds, responses, rules, max_pages=2)[1].collect()] == [(2, True)]


def crawled_one_by_one(seeds, site, blocked, pages, size, frontier_size, ms):
    """The reference's loop over single URLs for one run: (outcome and depth by URL, limit reached, body budget exceeded)."""
    from tidewatch.functions.html import extract_page

    key = lambda u: hashlib.sha256(u.encode()).hexdigest()
    waiting, known, out = {}, set(), {}
    truncated = False

    def add(u, depth):
        nonlocal truncated
        if u in known:
            return
        if len(known) >= frontier_size:
            truncated = True
            return
        known.add(u)
        waiting[u] = depth

    for u in sorted(seeds, key=key):
        add(u, 0)
    n = total = tries = 0
    body_over = False
    while waiting:
        if n >= pages or (tries - 1) * 1000 >= ms:
            break
        if total >= size:
            body_over = True
            break
        u = min(waiting, key=lambda u: (waiting[u], key(u)))
        depth = waiting.pop(u)
        n += 1
        tries += 1
        if u in blocked:
            out[u] = ("ROBOTS_BLOCKED", depth)
        elif u not in site:
            out[u] = ("NETWORK_ERROR", depth)
            tries += 2
        else:
            out[u] = ("HTTP_RESPONSE", depth)
            total += len(site[u].encode())
            for v in extract_page(site[u], u)[5]:
                add(v, depth + 1)
    return out, truncated or bool(waiting), body_over or total > size


@pytest.mark.parametrize("budgets", [False, True])
def test_crawl_goes_on_until_nothing_is_left_or_a_budget_ends_it(spark, budgets):
    from tidewatch.operators.crawl import crawl

    chain = {f"https://c.example/{i}": f'<title>t</title><a href="/{i + 1}">x</a>' for i in range(7)}
    r = random.Random(4)
    wide = {f"https://w.example/{i}": "<title>t</title>" + "".join(f'<a href="/{r.choice(["x/", "", ""])}{r.randrange(24)}">x</a>' for _ in range(r.randrange(6))) for i in range(20)}
    site = chain | wide
    responses = spark.createDataFrame([(u, 200, "text/html", None, [], b) for u, b in site.items()], "url string, status int, content_type string, x_robots_tag string, redirects array<string>, body string")
    rules = spark.createDataFrame([("w.example", "/x/", False)], "host string, rule_path string, allow boolean")
    first = {"c": ["https://c.example/0"], "w": [f"https://w.example/{i}" for i in range(12)]}
    seeds = spark.createDataFrame([(k, u) for k, v in first.items() for u in v], "run_id string, url string")
    blocked = {f"https://w.example/x/{i}" for i in range(60)}
    whole = {"max_pages": 5000, "body_bytes": 500 << 20, "max_frontier": 20_000, "max_ms": 7_200_000}
    cuts = [{}, {"max_pages": 8, "body_bytes": 4000}, {"body_bytes": 300}, {"max_frontier": 14, "max_ms": 13_000}]
    for cut in cuts[1:] if budgets else cuts[:1]:
        runs = ["w"] if cut else ["c", "w"]
        done, state = crawl(seeds.filter(F.col("run_id").isin(runs)), responses, rules, **cut)
        rows = done.collect()
        flags = {s.run_id: (s.observed, s.limit_reached, s.body_budget_exceeded) for s in state.collect()}
        for run in runs:
            want, left, over = crawled_one_by_one(first[run], site, blocked, *(whole | cut).values())
            assert {x.url: (x.fetch_outcome, x.depth) for x in rows if x.run_id == run} == want, (cut, run)
            assert flags[run] == (len(want), left, over), (cut, run)
        if not cut:
            assert max(x.depth for x in rows if x.run_id == "c") == 7


def test_response_bodies(spark):
    import gzip
    import zlib

    from tidewatch.sources.responses import BODY_CAP, config, decode_body, decoded

    cases = [(b"x", None), (gzip.compress(b"abc"), "gzip"), (zlib.compress(b"abc"), "deflate"), (b"zz", "gzip"), (None, None)]
    rows = spark.createDataFrame(cases, "b binary, e string").select(decode_body("b", "e").alias("d")).collect()
    assert [(None if r.d.body is None else bytes(r.d.body), r.d.outcome) for r in rows] == [(b"x", "OK"), (b"abc", "OK"), (b"abc", "OK"), (None, "NETWORK_ERROR"), (None, "NETWORK_ERROR")]
    assert decoded(gzip.compress(b"0" * (BODY_CAP + 1)), "gzip", BODY_CAP)[1] == "BODY_TOO_LARGE"
    with pytest.raises(ValueError):
        config({"NODE_ENV": "production"})


def test_small_relations(spark):
    u = spark.createDataFrame([("https://A.example/x#y", "a.example"), ("https://b.example/", "a.example")], "u string, h string").select(urls.same_host_identity(F.col("u"), F.col("h"))).collect()
    assert [x[0] for x in u] == ["https://a.example/x", None]
    s = spark.range(1).select(urls.sitemap_sources(F.array(F.lit("a"), F.lit("a")), F.lit("o")), urls.addresses(F.lit(None).cast("array<string>"), F.array(F.lit("::1")))).collect()[0]
    assert s[0] == ["a", "o/sitemap.xml"] and s[1] == ["::1"]
    f = spark.createDataFrame([("r", "PENDING", dt.datetime(2026, 1, 2)), ("r", "PENDING", dt.datetime(2026, 1, 1)), ("r", "DONE", None)], "run_id string, state string, next_attempt_at timestamp_ntz")
    assert frontier.earliest_retry(f).collect()[0].next_attempt_at == dt.datetime(2026, 1, 1)
    assert (frontier.state_counts(f).collect()[0].pending, frontier.state_counts(f).collect()[0].done) == (2, 1)
    n = spark.createDataFrame([("a", 2), ("b", 3)], "run_id string, deleted long")
    assert operations.prune_counters(n, n).collect()[0].deleted == 10
    m = spark.createDataFrame([("w", "OWNER"), ("w", "ADMIN")], "workspace_id string, role string")
    assert control.owners(m).collect()[0].owners == 1
    e = spark.createDataFrame([([("password", "string", "x"), ("a", "string", "b")],)], "e array<struct<key:string,kind:string,value:string>>")
    row = e.select(writes.audit_row(F.lit("u"), F.lit("act"), F.col("e"), F.lit("2026-01-01").cast("timestamp")).alias("r")).collect()[0].r
    assert row.details == {"a": "b"}
    ok = spark.createDataFrame([("GET", "https://evil"), ("POST", None), ("POST", "https://me"), ("POST", "https://evil"), ("post", "null")], "m string, o string")
    assert [r[0] for r in ok.select(control.same_origin(F.col("m"), F.col("o"), F.lit("https://me"))).collect()] == [True, True, True, False, False]
