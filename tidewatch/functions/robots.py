"""robots.txt: parsing (Arrow function), pattern matching and decisions (Columns), acquisition policy."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RULE = T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType())])
_GROUP = T.StructType([T.StructField("agents", T.ArrayType(T.StringType())), T.StructField("rules", T.ArrayType(_RULE))])
PARSED = T.StructType([T.StructField("groups", T.ArrayType(_GROUP)), T.StructField("sitemaps", T.ArrayType(T.StringType()))])


def parse_robots(text: str | None) -> tuple[list[dict], list[str]]:
    """Groups in order and the sitemaps. Agents in a row share a group; rules before any agent are dropped."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            if value:
                sitemaps.append(value)
        elif key == "user-agent":
            if not groups or groups[-1]["rules"]:
                groups.append({"agents": [], "rules": []})
            groups[-1]["agents"].append(value.lower())
        elif key in ("allow", "disallow") and groups:
            groups[-1]["rules"].append({"allow": key == "allow", "path": value})
    return groups, sitemaps


@F.pandas_udf(PARSED)
def robots_groups(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_robots(t) for t in texts], columns=["groups", "sitemaps"])


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: * any run, a last $ the end, else a prefix."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    parts = F.transform(F.split(body, r"\*"), lambda p: F.regexp_replace(p, r"([\\.\[\]{}()+?^$|&~#-])", r"\\$1"))
    return F.concat(F.lit("(?s)^"), F.array_join(parts, ".*"), F.when(anchored, "$").otherwise(""))


def specificity(pattern: Column, path: Column) -> Column:
    """Length of the pattern if it matches the path, else -1; an empty pattern matches nothing."""
    return F.when((pattern != "") & F.regexp_like(path, pattern_regex(pattern)), F.length(pattern)).otherwise(-1)


def rules_for(groups: Column, agent: str) -> Column:
    """All rules of the groups that name the agent, else of all * groups."""
    named = F.filter(groups, lambda g: F.array_contains(g["agents"], agent.lower()))
    every = F.filter(groups, lambda g: F.array_contains(g["agents"], "*"))
    return F.flatten(F.transform(F.when(F.size(named) > 0, named).otherwise(every), lambda g: g["rules"]))


#: Sites with more rules than this are matched by tries; paths in a group of these.
FEW_RULES, GROUP_PATHS = 64, 50_000


class RuleTrie:
    """The patterns of a site as one trie: characters and, for *, a node that any character leads back to. A path is walked once,
    with all nodes at a time that some pattern can have reached, so it costs its length times those, not the number of rules."""

    __slots__ = ("next", "star", "loops", "best", "last")

    def __init__(self, loops: bool = False):
        self.next: dict[str, RuleTrie] = {}
        self.star: RuleTrie | None = None
        self.loops = loops
        self.best = self.last = (-1, True)  # of patterns that end here; of those that also end the path

    def add(self, pattern: str, allow: bool) -> None:
        if not pattern:
            return
        anchored = pattern.endswith("$")
        node = self
        for c in pattern[:-1] if anchored else pattern:
            if c != "*":
                node = node.next.setdefault(c, RuleTrie())
            elif not node.loops:
                node.star = node.star or RuleTrie(loops=True)
                node = node.star
        mine = (len(pattern), allow)
        if anchored:
            node.last = max(node.last, mine)
        else:
            node.best = max(node.best, mine)

    def allowed(self, path: str) -> bool:
        """The longest pattern that matches decides, allow wins ties, no match allows."""
        best, now = (-1, True), {self}
        if self.star:
            now.add(self.star)
        for n in now:
            best = max(best, n.best)
        for c in path:
            reached = set()
            for n in now:
                if n.loops:
                    reached.add(n)
                if child := n.next.get(c):
                    reached.add(child)
                    if child.star:
                        reached.add(child.star)
            now = reached
            for n in now:
                if n.best > best:
                    best = n.best
            if not now:
                break
        for n in now:
            best = max(best, n.last)
        return best[1]


def _by_trie(paths: pa.Table, rules: pa.Table) -> pa.Table:
    trie = RuleTrie()
    for pattern, allow in zip(rules.column("__pattern").to_pylist(), rules.column("__allow").to_pylist(), strict=True):
        trie.add(pattern or "", bool(allow))
    return pa.table([paths.column("__on"), paths.column("__path"), pa.array([trie.allowed(p or "") for p in paths.column("__path").to_pylist()], pa.bool_())], names=["__on", "__path", "allowed"])


def allowed_by_trie(urls: DataFrame, rules: DataFrame, on: str, path: str = "path") -> DataFrame:
    """As allowed(), for sites with many rules: each distinct path meets its site's trie. A site's paths are dealt to groups of
    about GROUP_PATHS, each of which builds the trie once, so a large site is no large task and no URL carries rules."""
    pairs = urls.select(F.col(on).alias("__on"), F.col(path).alias("__path")).distinct()
    groups = pairs.groupBy("__on").agg(F.ceil(F.count(F.lit(1)) / GROUP_PATHS).cast("int").alias("__groups"))
    dealt = pairs.join(groups, "__on").select("__on", "__path", F.pmod(F.xxhash64("__path"), F.col("__groups")).cast("int").alias("__part"))
    own = rules.select(F.col(on).alias("__on"), F.col("rule_path").alias("__pattern"), F.col("allow").alias("__allow"))
    given = own.join(groups, "__on").select("__on", "__pattern", "__allow", F.explode(F.sequence(F.lit(0), F.col("__groups") - 1)).alias("__part"))
    ddl = f"__on {urls.schema[on].dataType.simpleString()}, __path string, allowed boolean"
    judged = dealt.groupBy("__on", "__part").cogroup(given.groupBy("__on", "__part")).applyInArrow(_by_trie, ddl)
    same = (F.col(on) == F.col("__on")) & F.col(path).eqNullSafe(F.col("__path"))
    return urls.join(judged, same, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("__on", "__path")


def allowed(urls: DataFrame, rules: DataFrame, on: str, path: str = "path", few: int = FEW_RULES) -> DataFrame:
    """urls with allowed: the longest matching rule of its site decides, allow wins ties, no match allows.

    rules: on, rule_path, allow. Of sites with at most `few` rules these are gathered into one row first, so this is an
    equi-join and an array fold per URL, not a join on the match; the URLs of other sites meet tries.
    """
    many = rules.groupBy(F.col(on).alias("__many")).count().filter(F.col("count") > few).select("__many")
    if many.isEmpty():
        return _by_fold(urls, rules, on, path)
    large = lambda df, how: df.join(many, F.col(on) == F.col("__many"), how)
    small = _by_fold(large(urls, "left_anti"), large(rules, "left_anti"), on, path)
    return small.unionByName(allowed_by_trie(large(urls, "left_semi"), large(rules, "left_semi"), on, path))


def _by_fold(urls: DataFrame, rules: DataFrame, on: str, path: str) -> DataFrame:
    per_site = rules.groupBy(on).agg(F.collect_list(F.struct("rule_path", "allow")).alias("__rules"))
    scored = lambda p: F.transform("__rules", lambda r: F.struct(specificity(r["rule_path"], p).alias("n"), r["allow"].alias("allow")))
    best = F.array_max(F.filter(scored(F.col(path)), lambda s: s["n"] >= 0))
    return urls.join(per_site, on, "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("__rules")


def acquisition(scheme: Column, attempt: Column, outcome: Column, status: Column, has_body: Column) -> Column:
    """What one robots.txt answer means: RULES, ALLOW_ALL, DENIED, UNAVAILABLE, RETRY, FALLBACK_HTTP."""
    https = scheme == "https"
    retry = attempt < 3
    http_answer = outcome == "HTTP_RESPONSE"
    missing = http_answer & status.isin(404, 410)
    lost = outcome.isin("NETWORK_ERROR", "TIMEOUT")
    return (
        F.when(http_answer & (status == 200) & has_body, "RULES").when(https & (missing | lost), F.when(retry, "RETRY").otherwise("FALLBACK_HTTP")).when(missing, "ALLOW_ALL")
        .when(http_answer & status.isin(401, 403), "DENIED").when(http_answer & ((status == 429) | (status >= 500)) & https & retry, "RETRY").otherwise("UNAVAILABLE")
    )


def acquired(attempts: DataFrame, *keys: str) -> DataFrame:
    """Per key what its robots.txt attempts come to: a final https answer decides; where all three found nothing or nobody, and
    none got any other answer, the one http attempt does; RETRY while https attempts are left.

    attempts: keys, scheme, attempt (from 1 per scheme), outcome, status, has_body.
    """
    c = F.col
    https = c("scheme") == "https"
    verdict = acquisition(c("scheme"), c("attempt"), c("outcome"), c("status"), c("has_body"))
    other = https & (c("outcome") == "HTTP_RESPONSE") & ~F.coalesce(c("status"), F.lit(0)).isin(404, 410)
    facts = attempts.withColumns({"__v": verdict, "__https": https, "__other": other}).groupBy(*keys).agg(
        F.min_by("__v", F.when(c("__https") & c("__v").isin("RULES", "DENIED", "UNAVAILABLE"), c("attempt"))).alias("final"),
        F.bool_or(c("__https") & (c("__v") == "FALLBACK_HTTP")).alias("fell"), F.bool_or("__other").alias("other"),
        F.max(F.when(~c("__https"), c("__v"))).alias("plain"),
    )
    rest = F.when(~c("fell"), "RETRY").when(c("other"), "UNAVAILABLE").otherwise(F.coalesce("plain", F.lit("UNAVAILABLE")))
    return facts.select(*keys, F.coalesce("final", rest).alias("robots"))
