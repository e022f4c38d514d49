"""Robots rules as tries: the same decisions as one regular expression a rule, at a cost of the path's length."""

import random
import re
import time

from pyspark.sql import functions as F

from tidewatch.functions import robots
from tidewatch.functions.robots import RuleTrie


def brute(rules, path):
    best = (-1, True)
    for pattern, allow in rules:
        rx = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$")) + ("$" if pattern.endswith("$") else "")
        if pattern and re.match(rx.replace("$", r"\Z") if pattern.endswith("$") else rx, path, re.S):
            best = max(best, (len(pattern), allow))
    return best[1]


def some(r, n, alphabet="ab/*$?."):
    return ["/" + "".join(r.choice(alphabet) for _ in range(r.randint(0, 7))) for _ in range(n)] + ["", "*", "$", "*$", "/*/", "a"]


def test_tries_against_regular_expressions():
    r = random.Random(3)
    for _ in range(300):
        rules = [(p, r.random() < 0.5) for p in r.sample(some(r, 12), 9)]
        rules = [(p, a) for p, a in rules if "$" not in p[:-1]]  # an inner $ is a character
        trie = RuleTrie()
        for p, a in rules:
            trie.add(p, a)
        for path in some(r, 20, "ab/?.")[:20]:
            assert trie.allowed(path) == brute(rules, path), (rules, path)


def rule_rows(r, host, n):
    kinds = (lambda i: f"/dir{i % 40}/page{i}", lambda i: f"/*/{i}.pdf$", lambda i: f"/q{i}*x", lambda i: f"/*?s{i}=", lambda i: f"/end{i}$")
    return [(host, kinds[i % 5](i), r.random() < 0.4) for i in range(n)]


def test_five_thousand_rules_on_a_host(spark, monkeypatch):
    monkeypatch.setattr(robots, "GROUP_PATHS", 300)  # several groups of the large host
    r = random.Random(5)
    rules = rule_rows(r, "big", 5000) + rule_rows(r, "small", 20) + [("big", "", True), ("big", "/", False)]
    paths = [r.choice((f"/dir{i % 40}/page{i % 5003}/x", f"/a/{i % 5003}.pdf", f"/q{i}yyx", f"/p?s{i}=1", f"/end{i}", f"/end{i}/", "/", "", None)) for i in range(3000)]
    urls = spark.createDataFrame([(i, r.choice(("big", "big", "small", "none", None)), p) for i, p in enumerate(paths)], "id long, host string, path string")
    df = spark.createDataFrame(rules, "host string, rule_path string, allow boolean")
    got = {x.id: x.allowed for x in robots.allowed(urls, df, "host").collect()}
    by = {h: [(p, a) for k, p, a in rules if k == h] for h in ("big", "small", "none", None)}
    tries = {h: RuleTrie() for h in by}
    for h, rs in by.items():
        for p, a in rs:
            tries[h].add(p, a)
    assert got == {x.id: tries[x.host].allowed(x.path or "") for x in urls.collect()}
    slow = urls.filter("host = 'big'").limit(60)
    want = {x.id: x.allowed for x in robots._by_fold(slow, df, "host", "path").collect()}
    assert {i: got[i] for i in want} == {i: w if w is not None else True for i, w in want.items()}


def test_the_cost_follows_the_path():
    """Five thousand rules cost a walk hardly more than fifty."""
    took = {}
    for n in (50, 5000):
        trie = RuleTrie()
        for _, p, a in rule_rows(random.Random(1), "h", n):
            trie.add(p, a)
        began = time.perf_counter()
        for i in range(3000):
            trie.allowed(f"/dir{i % 40}/page{i}/and/more/of/it.pdf")
        took[n] = time.perf_counter() - began
    assert took[5000] < 4 * took[50]


def test_few_rules_stay_in_the_engine(spark):
    urls = spark.createDataFrame([("h", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a", False)], "host string, rule_path string, allow boolean")
    plan = robots.allowed(urls, rules, "host").select(F.col("allowed"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
