"""The catalogue's queries as DuckDB SQL. Only the derivation of the crawl observations is shared with the Spark side."""

from __future__ import annotations

from tidewatch.sources.crawl import OBSERVED_SQL

IDENTITY = "CASE WHEN regexp_matches(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]+$') THEN regexp_replace(url, '#.*$', '') || '/' ELSE regexp_replace(url, '#.*$', '') END"
_TITLE = "nullif(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '')"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"

_RUNS = """
facts AS (
  SELECT project_id, run_id, run_no, policy_id, scope_generation, rule_version, count(*) AS observed, count(*) FILTER (fetch_outcome = 'HTTP_RESPONSE') AS http_count,
    bool_or(fetch_outcome = 'SECURITY_BLOCKED') AS sec, bool_or(fetch_outcome = 'NETWORK_ERROR') AS lost FROM obs GROUP BY ALL
),
runs AS (
  SELECT *, CASE WHEN http_count = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CASE WHEN http_count = 0 THEN 'NONE' WHEN sec OR lost THEN 'PARTIAL' ELSE 'FULL' END AS completeness,
    CASE WHEN http_count = 0 THEN 'NO_OBSERVATIONS' WHEN sec THEN 'SECURITY_BLOCKED' WHEN lost THEN 'UNRECOVERED_FETCH_ERRORS' END AS failure_code FROM facts
),
based AS (
  SELECT *, last_value(CASE WHEN completeness = 'FULL' THEN run_id END IGNORE NULLS) OVER (
    PARTITION BY project_id, policy_id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_run_id FROM runs
),
pub AS (SELECT * FROM based WHERE completeness = 'FULL'),
c AS (
  SELECT *, CASE WHEN canonical_kind IS NULL THEN NULL WHEN canonical_kind IN (0, 2) THEN ''
    WHEN canonical_kind = 1 THEN least(identity_url, 'https://other.example/x') || ' ' || greatest(identity_url, 'https://other.example/x') ELSE identity_url END AS canonical FROM obs
)"""
_EVENTS = """
cur AS (SELECT c.*, base_run_id FROM c JOIN pub USING (run_id)),
pair AS (
  SELECT cur.project_id, cur.run_id, cur.page_id, cur.identity_url, cur.base_run_id, b.run_id IS NOT NULL AS met,
    met AND cur.validity = 'KNOWN' AND b.validity = 'KNOWN' AS known, met AND cur.fetch_outcome = 'HTTP_RESPONSE' AND b.fetch_outcome = 'HTTP_RESPONSE' AS answered,
    b.initial_status AS s0, cur.initial_status AS s1, b.robots_index AS r0, cur.robots_index AS r1, b.title AS t0, cur.title AS t1, b.meta_description AS m0, cur.meta_description AS m1,
    b.canonical AS c0, cur.canonical AS c1, b.internal_links_count AS l0, cur.internal_links_count AS l1
  FROM cur LEFT JOIN c b ON b.run_id = cur.base_run_id AND b.page_id = cur.page_id
),
ev AS (
  SELECT project_id, run_id, page_id, 'URL_ADDED' AS change_type, 'INFO' AS severity, NULL::VARCHAR AS before, identity_url AS after FROM pair WHERE NOT met AND base_run_id IS NOT NULL
  UNION ALL SELECT project_id, run_id, page_id, 'HTTP_STATUS_CHANGED', CASE WHEN s0 BETWEEN 200 AND 299 AND (s1 IN (404, 410) OR s1 >= 500) THEN 'CRITICAL' ELSE 'INFO' END, s0::VARCHAR, s1::VARCHAR
    FROM pair WHERE answered AND s0 IS DISTINCT FROM s1
  UNION ALL SELECT project_id, run_id, page_id, 'ROBOTS_CHANGED', CASE WHEN r1 = 'DISALLOWED' THEN 'CRITICAL' ELSE 'INFO' END, r0, r1 FROM pair WHERE known AND r0 IS DISTINCT FROM r1
  UNION ALL SELECT project_id, run_id, page_id, 'TITLE_CHANGED', 'WARNING', t0, t1 FROM pair WHERE known AND t0 IS DISTINCT FROM t1
  UNION ALL SELECT project_id, run_id, page_id, 'META_DESCRIPTION_CHANGED', 'WARNING', m0, m1 FROM pair WHERE known AND m0 IS DISTINCT FROM m1
  UNION ALL SELECT project_id, run_id, page_id, 'CANONICAL_CHANGED', 'WARNING', c0, c1 FROM pair WHERE known AND c0 IS DISTINCT FROM c1
  UNION ALL SELECT project_id, run_id, page_id, 'INTERNAL_LINKS_CHANGED', 'INFO', l0::VARCHAR, l1::VARCHAR FROM pair WHERE known AND l0 IS DISTINCT FROM l1
)"""
#: The four rules over rows of {src}; kept apart from publication so that single runs can be judged too.
_RULES = """
SELECT project_id, scope_generation, rule_version, run_id, run_no, page_id, 'http_4xx_5xx' AS rule_key,
    CASE WHEN fetch_outcome <> 'HTTP_RESPONSE' OR initial_status IS NULL THEN 'UNKNOWN' WHEN initial_status IN (404, 410) OR initial_status >= 500 THEN 'PRESENT' ELSE 'ABSENT' END AS verdict,
    CASE WHEN fetch_outcome <> 'HTTP_RESPONSE' OR initial_status IS NULL THEN 'fetchOutcome=' || fetch_outcome ELSE 'status=' || initial_status END AS evidence FROM {src}
  UNION ALL SELECT project_id, scope_generation, rule_version, run_id, run_no, page_id, 'noindex_on_indexable', CASE WHEN validity <> 'KNOWN' THEN 'UNKNOWN' WHEN robots_index = 'DISALLOWED' THEN 'PRESENT' ELSE 'ABSENT' END,
    CASE WHEN validity <> 'KNOWN' THEN 'fieldValidity=' || validity WHEN robots_index = 'DISALLOWED' THEN 'robots=noindex' ELSE 'robots=' END FROM {src}
  UNION ALL SELECT project_id, scope_generation, rule_version, run_id, run_no, page_id, 'missing_title', CASE WHEN validity <> 'KNOWN' THEN 'UNKNOWN' WHEN title IS NULL OR title = '' THEN 'PRESENT' ELSE 'ABSENT' END,
    CASE WHEN validity <> 'KNOWN' THEN 'fieldValidity=' || validity ELSE 'title=' || coalesce(title, '') END FROM {src}
  UNION ALL SELECT project_id, scope_generation, rule_version, run_id, run_no, page_id, 'canonical_conflict', CASE WHEN validity <> 'KNOWN' THEN 'UNKNOWN' WHEN canonical_kind IN (1, 2) THEN 'PRESENT' ELSE 'ABSENT' END,
    CASE WHEN validity <> 'KNOWN' THEN 'fieldValidity=' || validity WHEN canonical_kind = 0 THEN 'canonicalCount=0' WHEN canonical_kind = 2 THEN 'problem=invalid;raw=::bad::'
      WHEN canonical_kind = 1 THEN 'problem=conflict;raw=' || identity_url || ', https://other.example/x' ELSE 'canonical=' || identity_url END FROM {src}
"""
_STATES = f"""
seen AS (SELECT obs.* FROM obs JOIN pub USING (run_id)),
verdicts AS ({_RULES.format(src="seen")}),
st0 AS (
  SELECT *, max((verdict = 'PRESENT')::INT) OVER w AS began, last_value(CASE WHEN verdict <> 'UNKNOWN' THEN verdict END IGNORE NULLS) OVER w AS decisive FROM verdicts
  WINDOW w AS (PARTITION BY project_id, scope_generation, rule_version, page_id, rule_key ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
st1 AS (SELECT *, CASE WHEN began = 1 THEN CASE WHEN decisive = 'PRESENT' THEN 'OPEN' ELSE 'RESOLVED' END END AS state FROM st0),
st2 AS (SELECT *, lag(state) OVER (PARTITION BY project_id, scope_generation, rule_version, page_id, rule_key ORDER BY run_no) AS old_state FROM st1),
states AS (
  SELECT * FROM (SELECT *, sum((state = 'OPEN' AND old_state IS DISTINCT FROM 'OPEN')::INT) OVER (PARTITION BY project_id, scope_generation, rule_version, page_id, rule_key ORDER BY run_no) AS occurrence FROM st2) WHERE state IS NOT NULL
)"""
_SUMMARY = """
sup AS (SELECT DISTINCT project_id, page_id, rule_key, TIMESTAMP '2026-01-12' + to_days((7 * (page_id % 4))::INT) AS until FROM obs, (VALUES ('missing_title'), ('noindex_on_indexable')) k(rule_key) WHERE page_id % 3 = 1),
weights(rule_key, weight) AS (VALUES ('http_4xx_5xx', 40), ('noindex_on_indexable', 25), ('missing_title', 20), ('canonical_conflict', 15)),
stood AS (
  SELECT pub.run_id, s.page_id, s.rule_key, arg_max(s.state, s.run_no) AS state FROM pub JOIN states s
    ON s.project_id = pub.project_id AND s.scope_generation = pub.scope_generation AND s.rule_version = pub.rule_version AND s.run_no <= pub.run_no GROUP BY ALL
),
live AS (
  SELECT stood.run_id, stood.rule_key, count(*) AS n FROM stood JOIN pub USING (run_id) LEFT JOIN sup ON sup.project_id = pub.project_id AND sup.page_id = stood.page_id AND sup.rule_key = stood.rule_key
  WHERE stood.state = 'OPEN' AND (sup.until IS NULL OR sup.until < TIMESTAMP '2026-01-05' + to_days((7 * (pub.run_no - 1))::INT)) GROUP BY ALL
),
opened AS (SELECT pub.run_id, weights.rule_key, coalesce(live.n, 0) AS open FROM pub CROSS JOIN weights LEFT JOIN live ON live.run_id = pub.run_id AND live.rule_key = weights.rule_key),
comp AS (
  SELECT pub.run_id, opened.rule_key, open, pub.http_count >= 1 AND pub.http_count / pub.observed >= 0.5 AS sufficient,
    CASE WHEN pub.http_count >= 1 AND pub.http_count / pub.observed >= 0.5 THEN
      floor(CASE rule_key WHEN 'http_4xx_5xx' THEN 40 WHEN 'noindex_on_indexable' THEN 25 WHEN 'missing_title' THEN 20 ELSE 15 END::DOUBLE
        * least(1.0::DOUBLE, least(1.0::DOUBLE, open::DOUBLE / pub.http_count) / 0.2::DOUBLE) + 0.5)::BIGINT ELSE 0 END AS deduction
  FROM opened JOIN pub USING (run_id)
),
score AS (SELECT run_id, CASE WHEN bool_and(sufficient) THEN greatest(0, 100 - sum(deduction))::BIGINT END AS health_score, sum(open)::BIGINT AS issues_open FROM comp GROUP BY run_id),
chg AS (
  SELECT run_id, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info,
    count(DISTINCT page_id) AS affected_pages FROM ev GROUP BY run_id
),
res AS (SELECT run_id, count(*) AS n FROM states WHERE state = 'RESOLVED' AND old_state = 'OPEN' GROUP BY run_id),
summary AS (
  SELECT project_id, run_id, run_no, CASE WHEN base_run_id IS NULL THEN 'BASELINE' ELSE 'DIFF' END AS comparison_mode, base_run_id, http_count AS urls_crawled, observed,
    coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info, coalesce(affected_pages, 0) AS affected_pages, issues_open,
    coalesce(res.n, 0) AS issues_resolved, health_score, CASE WHEN health_score IS NOT NULL THEN 1::BIGINT END AS health_score_version, CASE WHEN health_score IS NULL THEN 'INSUFFICIENT_COVERAGE' ELSE 'OK' END AS reason
  FROM pub LEFT JOIN score USING (run_id) LEFT JOIN chg USING (run_id) LEFT JOIN res USING (run_id)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join((OBSERVED_SQL, *parts)) + " "


_OBS, _TO_RUNS, _TO_EVENTS, _TO_STATES = _with(), _with(_RUNS), _with(_RUNS, _EVENTS), _with(_RUNS, _STATES)
_ALL = _with(_RUNS, _EVENTS, _STATES, _SUMMARY)
_CURRENT = """, scope AS (SELECT project_id, arg_max(scope_generation, run_no) AS scope_generation, arg_max(rule_version, run_no) AS rule_version FROM runs GROUP BY project_id),
issues AS (
  SELECT project_id, page_id, rule_key, arg_max(state, run_no) AS state, arg_max(occurrence, run_no)::BIGINT AS occurrence, arg_max(evidence, run_no) AS evidence,
    min(run_no) AS first_run_no, max(run_no) AS last_run_no FROM states SEMI JOIN scope USING (project_id, scope_generation, rule_version) GROUP BY project_id, page_id, rule_key
) """
#: Each run next to the one before it.
_PAIRS = """, a AS (SELECT *, run_no + 1 AS pair FROM obs WHERE run_no < 4), b AS (SELECT *, run_no AS pair FROM obs WHERE run_no > 1) """
_PAGES = "pt AS (SELECT project_id, page_id, identity_url, arg_min(run_id, run_no) AS first_seen_run_id, arg_max(run_id, run_no) AS last_seen_run_id FROM obs GROUP BY ALL)"


def _ipv4(n: str) -> str:
    blocks = (
        (0, 8, "UNSPECIFIED"), (10, 8, "PRIVATE"), ((172 << 24 | 16 << 16) >> 20, 12, "PRIVATE"), (192 << 8 | 168, 16, "PRIVATE"), (127, 8, "LOOPBACK"), (169 << 8 | 254, 16, "LINK_LOCAL"), ((100 << 24 | 64 << 16) >> 22, 10, "PRIVATE"),
        (192 << 16, 24, "RESERVED"), (192 << 16 | 2, 24, "RESERVED"), ((198 << 24 | 18 << 16) >> 17, 15, "RESERVED"), (198 << 16 | 51 << 8 | 100, 24, "RESERVED"), (203 << 16 | 113, 24, "RESERVED"), (14, 4, "MULTICAST"), (15, 4, "RESERVED"),
    )
    return "CASE " + " ".join(f"WHEN ({n}) >> {32 - size} = {head} THEN '{name}'" for head, size, name in blocks) + " ELSE 'PUBLIC' END"


_ADDRESS = "(event_id * 2654435761) % 4294967296"
_SCHEDULES = """WITH s AS (SELECT c_custkey AS k, TIMESTAMP '2026-01-01' + to_days((c_custkey % 45)::INT) AS nxt, 7 + c_custkey % 3 * 7 AS gap FROM customer),
slots AS (SELECT k, nxt + to_days((i * gap)::INT) AS slot, gap FROM s, unnest(range(0, 40)) u(i) WHERE k % 10 <> 0 AND nxt + to_days((i * gap)::INT) <= TIMESTAMP '2026-02-01'),
occ AS (SELECT k AS project_id, slot, CASE WHEN slot + to_days(gap::INT) <= TIMESTAMP '2026-02-01' THEN 'SKIPPED_MISSED' WHEN k % 17 = 0 THEN 'SKIPPED_ARCHIVED' WHEN k % 5 = 0 THEN 'SKIPPED_BUSY'
  WHEN k % 19 <> 0 AND k % 4 = 0 THEN 'SKIPPED_UNVERIFIED' WHEN k % 19 <> 0 THEN 'TRIGGERED' END AS status FROM slots) """
_ORDERS = """WITH r AS (
  SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS run_id, o_custkey % 50 AS project_id, o_orderdate AS finished_at, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'CRAWLING' END AS status,
    CASE WHEN o_orderkey % 11 = 0 THEN lpad(((o_orderkey * 7) % 1000)::VARCHAR, 10, '0') END AS base_run_id, CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS details_expired_at FROM orders
) """
RETENTION = _ORDERS + """, prot AS (SELECT min(run_id) AS run_id FROM r GROUP BY project_id UNION SELECT base_run_id FROM r WHERE status = 'CRAWLING' AND base_run_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, run_id DESC) - 1 AS rank FROM r WHERE status <> 'CRAWLING' AND details_expired_at IS NULL),
plan AS (SELECT run_id, project_id, rank FROM ranked WHERE (finished_at < TIMESTAMP '2000-06-01' - INTERVAL 900 DAY OR rank >= 100) AND run_id NOT IN (SELECT run_id FROM prot)) """
_CURSOR = "rtrim(translate(to_base64(encode(strftime({t}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || {i})), '+/', '-_'), '=')"
_TREE = f"WITH t AS (SELECT page_id, {HOST} AS scope, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS n FROM pages) "
_CHECKED = "WITH c AS (SELECT c_custkey AS k, ['OWNER', 'ADMIN', 'MEMBER', 'VIEWER'] AS roles FROM customer), m AS (SELECT k, k % 2 = 0 AS chg, k % 6 AS actor_id, k % 5 AS target_id, roles[k % 4 + 1] AS actor, roles[(k // 4) % 4 + 1] AS target, roles[(k // 16) % 4 + 1] AS new, k % 3 AS owners FROM c) "

ORACLES: dict[str, str] = {
    "url_identity": f"SELECT page_id, {IDENTITY} AS identity FROM pages",
    "url_key": f"SELECT page_id, sha256({IDENTITY}) AS url_key FROM pages",
    "url_strip_tracking": f"""SELECT page_id, CASE WHEN len(q) = 0 THEN b ELSE b || '?' || array_to_string(q, '&') END AS stripped FROM (
        SELECT page_id, regexp_extract(i, '^([^?]*)', 1) AS b, list_filter(string_split(regexp_extract(i, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_(source|medium|campaign|term|content)|gclid|fbclid)(=|$)')) AS q
        FROM (SELECT page_id, {IDENTITY} AS i FROM pages))""",
    "url_scope": f"SELECT page_id, {HOST} AS host, {HOST} LIKE 'm.%' AS on_mobile_host FROM pages",
    "url_safety": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'NON_DEFAULT_PORT' WHEN page_id % 3 = 1 AND page_id % 2 = 1 THEN 'NON_DEFAULT_PORT' WHEN page_id % 7 = 0 THEN 'BLOCKED_HOST' ELSE 'OK' END AS verdict FROM pages""",
    "ipv4_class": f"SELECT event_id, {_ipv4(_ADDRESS)} AS address_class FROM events",
    "dns_policy": f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NETWORK_ERROR' WHEN {_ipv4(_ADDRESS)} <> 'PUBLIC' OR {_ipv4("(event_id * 40503) % 4294967296")} <> 'PUBLIC' THEN 'SECURITY_BLOCKED' ELSE 'PASS' END AS outcome FROM events""",
    "extract_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "extract_link_count": """SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))::BIGINT AS n_links FROM pages""",
    "extract_full": f"""SELECT page_id, {_TITLE} AS title, NULL::VARCHAR AS meta_description, '' AS canonical, 'ALLOWED' AS index_state,
        len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))::BIGINT AS internal_links_count FROM pages""",
    "ipv6_class": f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'LINK_LOCAL' WHEN 1 THEN 'PRIVATE' WHEN 2 THEN 'MULTICAST' WHEN 3 THEN 'PUBLIC' WHEN 4 THEN 'RESERVED' ELSE {_ipv4(_ADDRESS)} END AS address_class FROM events""",
    "robots_index_state": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'ALLOWED' WHEN 2 THEN 'DISALLOWED' WHEN 3 THEN 'DISALLOWED' WHEN 4 THEN 'UNKNOWN' ELSE 'ALLOWED' END AS state FROM pages",
    "html_content_type": "SELECT page_id, page_id % 5 IN (0, 1, 3) AS html FROM pages",
    "robots_match": "SELECT * FROM (VALUES ('/admin', '/admin/login', 6), ('/admin$', '/admin', 7), ('/admin$', '/admin/login', -1), ('/*.php$', '/a/b.php', 7), ('/*.php$', '/a/b.php?x=1', -1), ('/a*/c', '/a/b/c/d', 5), ('/*.php', '/page.php?secret=1', 6), ('', '/x', -1), ('/x', '/y', -1)) t(pattern, path, specificity)",
    "robots_allowed": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1) AS path FROM pages),
        r(re, n, allow) AS (VALUES ('^/en/', 4, false), ('^/en/.*5', 6, true), ('^/.*/8', 4, false), ('^/fr/', 4, true), ('^/.*[?]page', 7, false)),
        best AS (SELECT page_id, arg_max(allow, n * 2 + allow::INT) AS allow FROM p JOIN r ON regexp_matches(path, re) GROUP BY page_id)
        SELECT page_id, coalesce(allow, true) AS allowed FROM p LEFT JOIN best USING (page_id)""",
    "robots_parse": "SELECT '-/x,+/x/y' AS rules, 'https://e.example/s.xml' AS sitemaps",
    "sitemap_parse": "SELECT page_id, 'URLSET' AS kind, regexp_replace(url, '#.*$', '') AS urls FROM pages",
    "frontier_priority": _TREE + "SELECT scope, page_id AS url_key, row_number() OVER (PARTITION BY scope ORDER BY n % 3, page_id) AS fetch_order FROM t",
    "frontier_budget": _TREE + """SELECT scope, url_key FROM (SELECT scope, page_id AS url_key, row_number() OVER w AS rn, coalesce(sum(page_id % 7 * 10) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t
        WINDOW w AS (PARTITION BY scope ORDER BY n % 3, page_id)) WHERE rn <= 12 AND b <= 150""",
    "frontier_seeds": "SELECT page_id AS url_key, CASE WHEN page_id % 10 = 0 THEN 'ENTRY' WHEN page_id % 4 = 0 THEN 'MONITORED' ELSE 'SITEMAP' END AS source FROM pages",
    "sitemap_walk": "SELECT 's' AS scope, 20::BIGINT AS documents, true AS truncated, 570::BIGINT AS urls",
    "redirect_walk": """SELECT * FROM (VALUES ('https://a.example/0', 301, 200, 'https://a.example/1', 1, 'HTTP_RESPONSE'), ('https://b.example/0', 302, 302, NULL, 1, 'REDIRECT_BLOCKED'),
        ('https://p.example/', NULL, NULL, NULL, 0, 'SECURITY_BLOCKED'), ('https://n.example/', NULL, NULL, NULL, 0, 'NETWORK_ERROR'), ('https://l.example/0', 302, 302, NULL, 6, 'REDIRECT_LIMIT')) t(start, initial_status, final_status, final_url, chain, outcome)""",
    "observation_diff": _TO_EVENTS + "SELECT * FROM ev",
    "snapshot_diff": _TO_RUNS + """, s AS (SELECT run_no, project_id, page_id, initial_status AS st, CASE robots_index WHEN 'DISALLOWED' THEN 'noindex' WHEN 'ALLOWED' THEN 'index' END AS rb, canonical AS cn, title AS tt, meta_description AS md, internal_links_count AS ln
          FROM c WHERE fetch_outcome = 'HTTP_RESPONSE'),
        x AS (SELECT *, (run_no + 1) || '|' || project_id || '|' || page_id AS url FROM s WHERE run_no < 4), y AS (SELECT *, run_no || '|' || project_id || '|' || page_id AS url FROM s WHERE run_no > 1),
        j AS (SELECT coalesce(x.url, y.url) AS url, x.url IS NOT NULL AS was, y.url IS NOT NULL AS now, x.st AS st0, y.st AS st1, x.rb AS rb0, y.rb AS rb1, x.cn AS cn0, y.cn AS cn1, x.tt AS tt0, y.tt AS tt1, x.md AS md0, y.md AS md1, x.ln AS ln0, y.ln AS ln1
          FROM x FULL JOIN y ON x.url = y.url)
        SELECT url, 'URL_ADDED' AS change_type, 'INFO' AS severity, NULL::VARCHAR AS before, url AS after FROM j WHERE NOT was
        UNION ALL SELECT url, 'URL_REMOVED', 'INFO', url, NULL FROM j WHERE NOT now
        UNION ALL SELECT url, 'HTTP_STATUS_CHANGED', CASE WHEN st0 BETWEEN 200 AND 299 AND (st1 = 404 OR st1 >= 500) THEN 'CRITICAL' ELSE 'INFO' END, st0::VARCHAR, st1::VARCHAR FROM j WHERE was AND now AND st0 IS DISTINCT FROM st1
        UNION ALL SELECT url, 'ROBOTS_CHANGED', CASE WHEN rb0 = 'index' AND rb1 = 'noindex' THEN 'CRITICAL' ELSE 'INFO' END, rb0, rb1 FROM j WHERE was AND now AND rb0 IS DISTINCT FROM rb1
        UNION ALL SELECT url, 'CANONICAL_CHANGED', 'WARNING', cn0, cn1 FROM j WHERE was AND now AND cn0 IS DISTINCT FROM cn1
        UNION ALL SELECT url, 'TITLE_CHANGED', 'WARNING', tt0, tt1 FROM j WHERE was AND now AND tt0 IS DISTINCT FROM tt1
        UNION ALL SELECT url, 'META_DESCRIPTION_CHANGED', 'WARNING', md0, md1 FROM j WHERE was AND now AND md0 IS DISTINCT FROM md1
        UNION ALL SELECT url, 'INTERNAL_LINKS_CHANGED', 'INFO', ln0::VARCHAR, ln1::VARCHAR FROM j WHERE was AND now AND ln0 IS DISTINCT FROM ln1""",
    "change_summary": _TO_EVENTS + """SELECT project_id, run_id, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info,
        count(DISTINCT page_id) AS affected_pages FROM ev GROUP BY ALL""",
    "change_by_type": _TO_EVENTS + "SELECT project_id, string_agg(change_type || '=' || n, ';' ORDER BY change_type) AS by_type FROM (SELECT project_id, change_type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY project_id",
    "change_sets": _OBS.rstrip() + _PAIRS + """SELECT pair, project_id, page_id, 'ADDED' AS kind FROM (SELECT pair, project_id, page_id FROM b EXCEPT SELECT pair, project_id, page_id FROM a)
        UNION ALL SELECT pair, project_id, page_id, 'REMOVED' FROM (SELECT pair, project_id, page_id FROM a EXCEPT SELECT pair, project_id, page_id FROM b)""",
    "issue_verdicts": _TO_STATES + "SELECT run_id, page_id, rule_key, verdict FROM verdicts",
    "issue_evidence": _OBS + f"SELECT run_id, page_id, rule_key, evidence FROM ({_RULES.format(src='obs')})",
    "issue_step": _OBS.rstrip() + f""", v AS ({_RULES.format(src='obs')}), i AS (SELECT run_no + 1 AS run_no, page_id, rule_key, CASE verdict WHEN 'PRESENT' THEN 'OPEN' ELSE 'RESOLVED' END AS state FROM v WHERE verdict <> 'UNKNOWN'),
        n AS (SELECT run_no, v.page_id, v.rule_key, state AS old_state, CASE WHEN verdict = 'PRESENT' THEN 'OPEN' WHEN verdict = 'ABSENT' AND state IS NOT NULL THEN 'RESOLVED' ELSE state END AS new_state, verdict
          FROM v LEFT JOIN i USING (run_no, page_id, rule_key) WHERE run_no > 1)
        SELECT run_no AS pair, page_id, rule_key, old_state, new_state,
          CASE WHEN new_state IS NULL THEN NULL WHEN old_state IS NULL THEN 1 WHEN old_state = 'RESOLVED' AND verdict = 'PRESENT' THEN 2 ELSE 1 END::BIGINT AS occurrence, old_state IS DISTINCT FROM new_state AS changed FROM n""",
    "issue_history": _TO_STATES + "SELECT run_id, page_id, rule_key, old_state, state, occurrence::BIGINT AS occurrence FROM states",
    "issue_transitions": _TO_STATES + """SELECT project_id, run_id, page_id, rule_key, old_state AS from_state, state AS to_state, CASE WHEN old_state IS NULL THEN run_id || ':' || page_id || ':' || rule_key || ':open'
        ELSE run_id || ':' || page_id || ':' || rule_key || ':' || state END AS idempotency_key FROM states WHERE state IS DISTINCT FROM old_state""",
    "issue_stale_touch": _OBS.rstrip() + f""", v AS ({_RULES.format(src='obs')}), p AS (SELECT run_no + 1 AS pair, page_id, rule_key FROM v WHERE verdict = 'PRESENT' AND run_no < 4)
        SELECT pair, page_id, rule_key FROM p WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.run_no = p.pair AND obs.page_id = p.page_id)""",
    "run_completeness": _TO_RUNS + "SELECT run_id, observed, http_count, status, completeness, failure_code FROM runs",
    "baseline_asof": _TO_RUNS + "SELECT run_id, completeness, base_run_id FROM based",
    "publish_summary": _ALL + "SELECT run_id, comparison_mode, base_run_id, urls_crawled, total, critical, warning, info, affected_pages, issues_open, issues_resolved, health_score, health_score_version, reason FROM summary",
    "health_score": _ALL + "SELECT run_id, health_score, round(urls_crawled / observed, 9) AS coverage, floor(urls_crawled / observed * 100 + 0.5)::BIGINT AS percent FROM summary",
    "health_components": _ALL + "SELECT run_id, rule_key, open::BIGINT AS open, deduction FROM comp WHERE deduction > 0",
    "health_grade": _ALL + "SELECT CASE WHEN health_score >= 90 THEN 'good' WHEN health_score >= 75 THEN 'fair' WHEN health_score >= 50 THEN 'poor' WHEN health_score IS NOT NULL THEN 'critical' ELSE 'none' END AS grade, count(*) AS runs FROM summary GROUP BY ALL",
    "report_overview": _ALL.rstrip() + _CURRENT + f""", {_PAGES}, s AS (SELECT project_id, arg_max(summary, run_no) AS s FROM summary GROUP BY project_id),
        hosts AS (SELECT project_id, count(DISTINCT page_id) AS known FROM obs GROUP BY project_id),
        more(rest, run_no, status, code) AS (VALUES (0, 5, 'CRAWLING', NULL), (1, 5, 'FAILED', 'LEASE_LOST'), (1, 6, 'QUEUED', NULL), (2, 5, 'FAILED', 'NO_OBSERVATIONS'), (2, 6, 'CANCELLED', NULL)),
        every AS (SELECT project_id, run_no, run_id, status, failure_code AS code, observed AS done FROM runs
          UNION ALL SELECT project_id, run_no, project_id || '#' || run_no, status, code, CASE WHEN status = 'CRAWLING' THEN known - 1 ELSE 0 END FROM hosts JOIN more ON length(project_id) % 5 = rest),
        act AS (SELECT * FROM every WHERE status NOT IN ('COMPLETED', 'FAILED', 'CANCELLED') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY run_no DESC) = 1),
        f AS (SELECT * FROM every WHERE status IN ('FAILED', 'CANCELLED') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY run_no DESC) = 1),
        o AS (SELECT i.project_id, count(*) AS n FROM issues i LEFT JOIN sup USING (project_id, page_id, rule_key) WHERE state = 'OPEN' AND (until IS NULL OR until <= TIMESTAMP '2026-01-26') GROUP BY ALL)
        SELECT k.project_id, pages_known, s.s.run_id AS run_id, s.s.health_score AS health_score, s.s.total AS changes, s.s.critical AS critical, s.s.urls_crawled AS urls_crawled, coalesce(o.n, 0) AS open_issues,
          act.run_id AS active_run_id, act.status AS active_status, act.done AS active_done, f.run_id AS failed_run_id, f.status AS failed_status, f.code AS failed_code
        FROM (SELECT project_id, count(*) AS pages_known FROM pt GROUP BY ALL) k LEFT JOIN s USING (project_id) LEFT JOIN act USING (project_id) LEFT JOIN f USING (project_id) LEFT JOIN o USING (project_id)""",
    "report_changes": _ALL + f""", {_PAGES} SELECT ev.project_id, ev.run_id, ev.page_id, pt.identity_url, change_type, before, after FROM ev JOIN (SELECT project_id, arg_max(run_id, run_no) AS run_id FROM summary GROUP BY project_id) l USING (project_id, run_id)
        JOIN pt USING (project_id, page_id) WHERE severity = 'CRITICAL'""",
    "report_issues": _ALL + _CURRENT + "SELECT project_id, page_id, rule_key, state, occurrence, first_run_no, last_run_no, evidence FROM issues WHERE state = 'OPEN'",
    "report_pages": _OBS + f", {_PAGES} SELECT pt.page_id, first_seen_run_id, last_seen_run_id, fetch_outcome, initial_status, title FROM pt JOIN obs ON obs.page_id = pt.page_id AND obs.run_id = last_seen_run_id",
    "report_page_one": _ORDERS + f""", x AS (SELECT *, row_number() OVER (ORDER BY finished_at DESC, run_id DESC) AS n, count(*) OVER () > 25 AS more FROM r WHERE project_id = 7), y AS (SELECT {_CURSOR.format(t='finished_at', i='run_id')} AS cur FROM x WHERE n = 25)
        SELECT run_id, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, more AS has_more, CASE WHEN more THEN (SELECT cur FROM y) END AS next_cursor FROM x WHERE n <= 25""",
    "report_page_two": _ORDERS + """SELECT run_id, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at FROM r WHERE project_id = 7 AND (finished_at < TIMESTAMP '2000-01-01' OR (finished_at = TIMESTAMP '2000-01-01' AND run_id < '0000005000'))
        ORDER BY r.finished_at DESC, run_id DESC LIMIT 25""",
    "report_page_numbers": _ORDERS + "SELECT run_id, ((row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, run_id DESC) - 1) // 50)::BIGINT AS page_no FROM r",
    "crawl_list": _ORDERS + "SELECT run_id, project_id, status, base_run_id FROM r WHERE status IN ('COMPLETED', 'FAILED') AND base_run_id IS NOT NULL",
    "scan_unique": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7",
    "scan_first": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 3 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1",
    "scan_ready": "SELECT 1::INT AS ok",
    "suppression": """SELECT c_custkey, u IS NULL OR u < TIMESTAMP '2026-01-03' AS at_publish, u IS NULL OR u <= TIMESTAMP '2026-01-03' AS in_overview
        FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2026-01-01' + to_days((c_custkey % 5)::INT) END AS u FROM customer)""",
    "crawl_quota": """WITH e AS (SELECT event_id AS id, user_id AS k, floor(epoch(ts))::BIGINT AS t FROM events),
        n AS (SELECT id, t, count(*) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY k, t) + row_number() OVER (PARTITION BY k, t ORDER BY id) - 1 AS n, lag(t) OVER (PARTITION BY k ORDER BY t, id) AS p FROM e)
        SELECT id, CASE WHEN n >= 10 THEN 'DAILY_LIMIT' WHEN p + 300 > t THEN 'SPACING' END AS refused FROM n""",
    "rate_limit": """SELECT user_id AS subject, count(*) AS attempts, len(list_reduce(list([floor(epoch(ts))::BIGINT] ORDER BY ts, event_id),
        lambda a, x: CASE WHEN len(list_filter(a, lambda y: y > x[1] - 21600)) < 2 THEN list_concat(a, x) ELSE a END))::BIGINT AS allowed FROM events GROUP BY user_id""",
    "idempotency_replay": """WITH RECURSIVE a AS (SELECT event_id AS id, user_id AS u, event_type AS k, floor(epoch(ts))::BIGINT AS t, event_id % 2 AS h, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
        s AS (SELECT u, k, n, id, t, h, 'RUN' AS outcome FROM a WHERE n = 1
          UNION ALL SELECT a.u, a.k, a.n, a.id, CASE WHEN a.t < s.t + 86400 THEN s.t ELSE a.t END, CASE WHEN a.t < s.t + 86400 THEN s.h ELSE a.h END, CASE WHEN a.t >= s.t + 86400 THEN 'RUN' WHEN a.h = s.h THEN 'REPLAY' ELSE 'CONFLICT' END
          FROM s JOIN a ON a.u = s.u AND a.k = s.k AND a.n = s.n + 1)
        SELECT id, outcome FROM s""",
    "outbox_claim": "SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 2 <> 0 AND event_id % 3 <> 0 AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 40",
    "schedule_scan": _SCHEDULES + "SELECT project_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS scheduled_for, status FROM occ WHERE status IS NOT NULL",
    "schedule_tick": _SCHEDULES + """, first AS (SELECT DISTINCT project_id FROM occ ORDER BY project_id LIMIT 20)
        SELECT project_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS scheduled_for, status FROM occ SEMI JOIN first USING (project_id) WHERE status IS NOT NULL""",
    "schedule_next": _SCHEDULES + """SELECT k AS project_id, strftime(CASE WHEN nxt > TIMESTAMP '2026-02-01' THEN nxt ELSE nxt + to_days(((date_diff('day', nxt, TIMESTAMP '2026-02-01') // gap + 1) * gap)::INT) END, '%Y-%m-%d %H:%M:%S') AS next_run_at FROM s""",
    "schedule_counters": _SCHEDULES + "SELECT count(*) FILTER (status = 'TRIGGERED') AS triggered, count(*) FILTER (status = 'SKIPPED_MISSED') AS missed, count(*) FILTER (status LIKE 'SKIPPED%' AND status <> 'SKIPPED_MISSED') AS skipped FROM occ",
    "retention_plan": RETENTION + "SELECT * FROM plan",
    "retention_effect": RETENTION + "SELECT run_id, count(*) AS deleted FROM lineitem JOIN plan ON run_id = lpad(l_orderkey::VARCHAR, 10, '0') GROUP BY run_id",
    "role_matrix": """SELECT r AS role, a AS action, rn <= ln AS allowed FROM (VALUES ('OWNER', 1), ('ADMIN', 2), ('MEMBER', 3), ('VIEWER', 4)) r(r, rn), (VALUES ('view', 4), ('run-crawl', 3), ('manage-project', 2), ('manage-members', 2), ('manage-owners', 1)) a(a, ln)""",
    "member_guard": _CHECKED + """SELECT k AS id, CASE WHEN CASE WHEN target = 'OWNER' OR new = 'OWNER' THEN actor <> 'OWNER' ELSE actor NOT IN ('OWNER', 'ADMIN') END THEN 'FORBIDDEN' WHEN NOT chg AND actor_id = target_id THEN 'SELF_REMOVAL'
        WHEN target = 'OWNER' AND (NOT chg OR new <> 'OWNER') AND owners <= 1 THEN 'LAST_OWNER' END AS error FROM m""",
    "invitation_state": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'REVOKED' WHEN c_custkey % 7 = 0 THEN 'ACCEPTED' WHEN c_custkey % 9 <= 4 THEN 'EXPIRED' ELSE 'PENDING' END AS state FROM customer",
    "crawl_guard": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NOT_VERIFIED' WHEN c_custkey % 3 = 0 THEN 'NOT_ACTIVE' WHEN TIMESTAMP '2026-09-10' >= TIMESTAMP '2026-08-01' + to_days((c_custkey % 40 + 30)::INT) THEN 'VERIFICATION_EXPIRED' END AS reason FROM customer""",
    "verification_state": """SELECT project_id, challenge_version, CASE WHEN challenge_version % 3 = 0 THEN 'VERIFIED' WHEN challenge_version % 5 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS state, CASE WHEN challenge_version % 5 < 3 THEN challenge_version % 5 * 60 END AS wait_s
        FROM (SELECT c_custkey % 100 AS project_id, max(c_custkey) AS challenge_version FROM customer GROUP BY 1)""",
    "audit_redact": "SELECT event_id, 'who=' || user_id || ';note=' || CASE WHEN length(event_type) * 50 > 200 THEN repeat(event_type, 50)[1:200] || '…' ELSE repeat(event_type, 50) END AS details FROM events",
    "cursor_codec": f"SELECT o_orderkey, {_CURSOR.format(t='o_orderdate', i='o_orderkey')} AS cursor, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, o_orderkey::VARCHAR AS id FROM orders",
    "tenancy_semi_join": "SELECT o_orderkey, o_custkey AS project_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "write_relations": _OBS.rstrip() + _PAIRS + """SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.page_id, b.page_id) AS page_id,
          coalesce(a.run_id, b.run_id) AS first_seen_run_id, coalesce(b.run_id, a.run_id) AS last_seen_run_id
        FROM a FULL JOIN b ON a.pair = b.pair AND a.project_id = b.project_id AND a.page_id = b.page_id""",
}
ORACLES["frontier_bfs"] = f"""WITH RECURSIVE t AS (SELECT {HOST} AS scope, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS n FROM pages),
  b AS (SELECT scope, n AS node, 0 AS depth FROM t WHERE n = 0 UNION ALL SELECT t.scope, t.n, depth + 1 FROM b JOIN t ON t.scope = b.scope AND t.n > 0 AND (t.n - 1) // 3 = b.node WHERE depth < 3)
  SELECT scope, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY depth, node) AS k FROM b) WHERE k <= 20"""
ORACLES["crawl_run"] = f"""WITH p AS (SELECT DISTINCT {HOST} AS host, {IDENTITY} AS u FROM pages)
  SELECT host AS run_id, count(*) AS observed, count(*) FILTER (NOT regexp_matches(u, '^[a-z]+://[^/]+/en/')) AS answered, count(*) FILTER (regexp_matches(u, '^[a-z]+://[^/]+/en/')) AS blocked,
    count(*) FILTER (NOT regexp_matches(u, '^[a-z]+://[^/]+/en/')) AS titled FROM p GROUP BY host"""
