"""The crawl as a stream against a loop that visits one URL after the other."""

import hashlib
import random
import re
from urllib.parse import urljoin, urlsplit

import pytest

from tidewatch.functions.html import extract_page
from tidewatch.functions.robots import parse_robots
from tidewatch.functions.sitemap import parse_sitemap
from tidewatch.streaming.visits import visit

ARCHIVE = "url string, try int, status int, location string, content_type string, body string, error string, elapsed_ms int, host_class string"


def page(*links, title="t"):
    return f"<html><head><title>{title}</title></head><body>{''.join(f'<a href={x}>x</a>' for x in links)}</body></html>"


def answer(url, status=200, body=None, location=None, error=None, n=1, kind="text/html", ms=0, where="PUBLIC"):
    return url, n, status, location, kind, body, error, ms, where


class Loop:
    """One run, one URL at a time, in plain Python."""

    def __init__(self, host, monitored, answers, pages=5000, body=500 << 20, frontier=20_000, ms=120 * 60_000, interval=1000, cap=2 << 20):
        self.host, self.answers, self.max_pages, self.max_bytes, self.max_frontier, self.max_ms, self.interval, self.cap = host, {}, pages, body, frontier, ms, interval, cap
        for a in answers:
            self.answers.setdefault(a[0], {})[a[1]] = a
        self.clock = self.next = self.bytes = 0
        self.limit = self.over = False
        self.seen, self.state = [], {}
        self.robots = self.failure = None
        self.monitored = monitored

    def pace(self):
        self.clock = max(self.clock, self.next)
        self.next = self.clock + self.interval

    def get(self, url, n):
        """(outcome, initial, final, final_url, chain, type, body)"""
        at, chain, initial, final, last = url, 0, None, None, None
        while True:
            if urlsplit(at).hostname != self.host:
                return ("REDIRECT_BLOCKED" if chain else "SCOPE_BLOCKED"), initial, final, None, chain, None, None
            tries = self.answers.get(at, {})
            a = tries.get(max((k for k in tries if k <= n), default=0))
            if a is None or a[8] == "NONE":
                return "NETWORK_ERROR", initial, final, last, chain, None, None
            if a[8] != "PUBLIC":
                return "SECURITY_BLOCKED", initial, final, last, chain, None, None
            if a[7] > 20_000 or a[6]:
                return ("TIMEOUT" if a[7] > 20_000 else a[6]), initial, final, last, chain, None, None
            initial, final, last = initial or a[2], a[2], at
            if a[2] in (301, 302, 303, 307, 308) and a[3]:
                target = urljoin(at, a[3]).split("#")[0]
                parts = urlsplit(target)
                if parts.scheme not in ("http", "https") or parts.port or parts.hostname == "localhost":
                    return "SECURITY_BLOCKED", initial, final, last, chain, None, None
                chain += 1
                if chain > 5:
                    return "REDIRECT_LIMIT", initial, final, last, chain, None, None
                at = target
                continue
            if a[5] is not None and len(a[5].encode()) > self.cap:
                return "BODY_TOO_LARGE", initial, final, last, chain, a[4], None
            return "HTTP_RESPONSE", initial, final, last, chain, a[4], a[5]

    def acquire(self):
        fall = True
        for n in (1, 2, 3):
            self.pace()
            out, _, status, last, _, _, body = self.get(f"https://{self.host}/robots.txt", n)
            self.bytes += len((body or "").encode())
            if out == "HTTP_RESPONSE":
                if status == 200 and body is not None:
                    return "RULES", body, "https://" + urlsplit(last).netloc
                if status in (401, 403):
                    return "DENIED", None, None
                fall = fall and status in (404, 410)
                if status != 429 and status < 500 and status not in (404, 410):
                    return "UNAVAILABLE", None, None
            elif out not in ("NETWORK_ERROR", "TIMEOUT"):
                return "UNAVAILABLE", None, None
            if n < 3:
                self.clock += 2000
        if not fall:
            return "UNAVAILABLE", None, None
        self.pace()
        out, _, status, last, _, _, body = self.get(f"http://{self.host}/robots.txt", 1)
        self.bytes += len((body or "").encode())
        if out == "HTTP_RESPONSE" and status == 200 and body is not None:
            return "RULES", body, "http://" + urlsplit(last).netloc
        if out == "HTTP_RESPONSE" and status in (404, 410):
            return "ALLOW_ALL", None, f"http://{self.host}"
        return ("DENIED" if status in (401, 403) else "UNAVAILABLE"), None, None

    def allowed(self, url):
        path = re.sub(r"^[a-z]+://[^/]+", "", url)
        best = (-1, True)
        for allow, pattern in self.rules:
            rx = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$")) + ("$" if pattern.endswith("$") else "")
            if pattern and re.match(rx, path, re.S):
                best = max(best, (len(pattern), allow))
        return best[1]

    def add(self, url, depth):
        if urlsplit(url).hostname != self.host or url in self.state:
            return
        if len(self.state) >= self.max_frontier:
            self.limit = True
            return
        self.state[url] = [depth, hashlib.sha256(url.encode()).hexdigest(), 0, 0, False]

    def go(self):
        self.robots, text, origin = self.acquire()
        if self.robots in ("DENIED", "UNAVAILABLE"):
            self.failure = f"ROBOTS_{self.robots}"
            return self
        groups, sitemaps = parse_robots(text)
        own = [g for g in groups if "tidewatch" in g["agents"]] or [g for g in groups if "*" in g["agents"]]
        self.rules = [(r["allow"], r["path"]) for g in own for r in g["rules"]]
        self.add(origin + "/", 0)
        for u in sorted(self.monitored, key=lambda u: hashlib.sha256(u.encode()).hexdigest()):
            self.add(u, 0)
        found, queue = {}, [*dict.fromkeys([*sitemaps, origin + "/sitemap.xml"])]
        for u in queue:
            if urlsplit(u).hostname == self.host:
                self.pace()
                out, _, status, _, _, _, body = self.get(u, 1)
                if out == "HTTP_RESPONSE" and status == 200 and body is not None:
                    found |= dict.fromkeys(x for x in parse_sitemap(body)[1] if urlsplit(x).hostname == self.host)
        for u in sorted(found, key=lambda u: hashlib.sha256(u.encode()).hexdigest()):
            self.add(u, 0)
        self.loop()
        self.limit |= any(not s[4] for s in self.state.values())
        self.over |= self.bytes > self.max_bytes
        return self

    def loop(self):
        while pending := [u for u, s in self.state.items() if not s[4]]:
            if len(self.seen) >= self.max_pages or self.bytes >= self.max_bytes or self.clock >= self.max_ms:
                self.over |= len(self.seen) < self.max_pages and self.bytes >= self.max_bytes
                return
            due = [u for u in pending if self.state[u][3] <= self.clock]
            if not due:
                first = min(self.state[u][3] for u in pending)
                if first > self.max_ms:
                    return
                self.clock = first
                continue
            url = min(due, key=lambda u: self.state[u][:2])
            s = self.state[url]
            self.pace()
            if not self.allowed(url):
                s[4] = True
                self.seen.append((url, self.clock, s[0], 0, "ROBOTS_BLOCKED", None, None, None))
                continue
            if self.clock >= self.max_ms:
                return
            s[2] += 1
            out, initial, final, last, chain, kind, body = self.get(url, s[2])
            if out in ("NETWORK_ERROR", "TIMEOUT") and s[2] < 3:
                s[3] = self.clock + 5000 * s[2]
                continue
            s[4] = True
            self.bytes += len((body or "").encode())
            title = None
            if out == "HTTP_RESPONSE" and kind.startswith("text/html") and 200 <= final < 300 and not chain and body is not None:
                facts = extract_page(body, last)
                title = facts[0]
                for link in facts[5]:
                    self.add(link, s[0] + 1)
            if out == "HTTP_RESPONSE" and chain:
                self.add(last, s[0])
            self.seen.append((url, self.clock, s[0], s[2], out, initial, final, title))


def site(seed, host):
    r = random.Random(seed)
    at = lambda i: f"https://{host}/p{i}"
    out = []
    n = 18
    for i in range(n):
        links = [f"/p{r.randint(0, n + 3)}" for _ in range(r.randint(0, 4))] + r.choice(([], ["https://other.example/x"], ["mailto:a@b.c", "#x"], ["/private/a"]))
        body = page(*links, title=f"title {i}") + "x" * r.randint(0, 300)
        kind = r.random()
        if kind < 0.15:
            target = r.choice((f"/p{r.randint(0, n)}", f"/p{(i + 1) % n}", "https://other.example/", "https://localhost/", f"p{i}", f"https://{host}:8080/x", "/p0#frag"))
            out.append(answer(at(i), r.choice((301, 302, 307)), location=target))
        elif kind < 0.3:  # answers that are lost at first
            lost = r.randint(1, 3)
            out += [answer(at(i), error=r.choice(("NETWORK_ERROR", "TIMEOUT")), n=k) for k in range(1, lost + 1)]
            if lost < 3:
                out.append(answer(at(i), body=body, n=lost + 1))
        elif kind < 0.36:
            out.append(answer(at(i), body=body, ms=25_000))
        elif kind < 0.42:
            out.append(answer(at(i), r.choice((404, 503)), body=body))
        elif kind < 0.46:
            out.append(answer(at(i), body=body, kind="application/pdf"))
        elif kind < 0.48:
            out.append(answer(at(i), body=body, where="PRIVATE"))
        else:
            out.append(answer(at(i), body=body))
    out.append(answer(f"https://{host}/private/a", body=page()))
    out.append(answer(f"https://{host}/", body=page("/p1", "/p2", "/private/a")))
    monitored = [at(i) for i in r.sample(range(n + 2), 4)]
    return out, monitored


ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/b$\nSitemap: https://{h}/map.xml\n"


def sites():
    """Hosts of every kind: (answers, monitored by host)."""
    answers, monitored = [], {}
    for k in range(9):
        h = f"h{k}.example.com"
        a, m = site(k, h)
        answers += a
        monitored[h] = m
        robots = f"https://{h}/robots.txt"
        if k < 3:
            answers += [answer(robots, body=ROBOTS.format(h=h), kind="text/plain"), answer(f"https://{h}/map.xml", body=f"<urlset><url><loc>https://{h}/p7</loc></url><url><loc>https://{h}/p9</loc></url></urlset>", kind="application/xml")]
        elif k == 3:  # lost, then there
            answers += [answer(robots, error="TIMEOUT"), answer(robots, body=ROBOTS.format(h=h), n=2)]
        elif k == 4:  # nothing over https, nothing over http
            answers += [answer(robots, 404, body="no"), answer(f"http://{h}/robots.txt", 404, body="none"), answer(f"http://{h}/", body=page("/p3"))]
        elif k == 5:
            answers.append(answer(robots, 403))
        elif k == 6:
            answers.append(answer(robots, 503))
        elif k == 7:  # nobody answers over https; http redirects home
            answers += [answer(f"http://{h}/robots.txt", 301, location=f"http://{h}/r.txt"), answer(f"http://{h}/r.txt", body=ROBOTS.format(h=h))]
        else:  # moved within https
            answers += [answer(robots, 302, location="/r.txt"), answer(f"https://{h}/r.txt", body="User-agent: tidewatch\nDisallow: /p2\n")]
    for i in range(8):  # a chain that is too long, and one that is just short enough
        answers.append(answer(f"https://h0.example.com/c{i}", 301, location=f"/c{i + 1}"))
    answers.append(answer("https://h0.example.com/c8", body=page()))
    monitored["h0.example.com"] += ["https://h0.example.com/c1", "https://h0.example.com/c3"]
    return answers, monitored


@pytest.mark.parametrize("budgets", [{}, {"interval_ms": 3000, "max_ms": 40_000, "max_pages": 9, "max_frontier": 12, "body_bytes": 3000}])
def test_equals_the_loop_over_single_urls(spark, tmp_path, budgets):
    answers, monitored = sites()
    hosts = spark.createDataFrame([(h,) for h in monitored], "host string")
    m = spark.createDataFrame([(h, u) for h, us in monitored.items() for u in us * 2], "host string, url string")
    seen, runs = visit(hosts, m, spark.createDataFrame(answers, ARCHIVE), f"file://{tmp_path}/crawl", **budgets)
    names = {"max_pages": "pages", "body_bytes": "body", "max_frontier": "frontier", "max_ms": "ms", "interval_ms": "interval"}
    loops = {h: Loop(h, us, answers, **{names[k]: v for k, v in budgets.items()}).go() for h, us in monitored.items()}
    got = {}
    for x in seen.orderBy("run_id", "seq").collect():
        got.setdefault(x.run_id, []).append((x.url, x.at_ms, x.depth, x.tries, x.fetch_outcome, x.initial_status, x.final_status, x.title))
    for h, loop in loops.items():
        assert got.get(h, []) == loop.seen, h
    for x in runs.collect():
        loop = loops[x.run_id]
        assert (x.robots, x.pages, x.bytes, x.limit_reached, x.body_budget_exceeded) == (loop.robots, len(loop.seen), loop.bytes, loop.limit, loop.over), x.run_id
        assert x.failure_code == loop.failure or loop.failure is None
    assert runs.count() == 9
    if not budgets:
        outcomes = {x[4] for loop in loops.values() for x in loop.seen}
        assert outcomes >= {"HTTP_RESPONSE", "ROBOTS_BLOCKED", "NETWORK_ERROR", "TIMEOUT", "REDIRECT_LIMIT", "SECURITY_BLOCKED", "REDIRECT_BLOCKED"}
