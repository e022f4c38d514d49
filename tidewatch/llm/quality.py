"""Quality rules (native): per-document rules, host failure rates shrunk by an empirical beta prior, host verdicts joined back.

Only built-in functions run on the rows. All arrays of a document are bound once (`let`), so every rule is linear
(or n log n where a document repeats itself) in its words. Hosts are aggregated with map-side partial sums: a host that
holds a third of all rows adds one partial row per task.

Defined results: a null text counts as empty (no words, so base_failed); a null source is a host of its own, with the
other rows of null source; repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import let, materialised, private, text_of

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A host whose shrunk failure rate is above this loses all its documents.
HOST_RATE = 0.9


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words inside gram-word windows that occur twice or more among these words, the first occurrence included."""

    def marked(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.transform(s, lambda p, j: F.when((p["g"] == F.get(s, j - 1)["g"]) | (p["g"] == F.get(s, j + 1)["g"]), p["i"]))
            return F.sort_array(F.filter(twin, lambda x: x.isNotNull()))

        def covered(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, j: F.least(F.lit(gram), F.coalesce(F.get(at, j + 1) - p, F.lit(gram)))),
                F.lit(0).cast("bigint"), lambda a, x: a + x,
            )

        return let(let(pairs, places), covered)

    def counted(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(gram)]))
        return F.when(F.size(w) <= gram, F.lit(0).cast("bigint")).otherwise(
            let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(marked(g)))
        )

    return counted(words)


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_columns(text: str = "text") -> Column:
    """One struct of all counts of a document."""
    whole = text_of(text)
    return let(
        whole,
        lambda t: F.struct(
            let(
                words_of(t),
                lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
            ).alias("w"),
            F.length(F.translate(t, SPACES, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            dup_lines(t).alias("n_dup_lines"),
        ),
    )


def failed(c: Column) -> Column:
    return (c["w"]["n_words"] < MIN_WORDS) | (100 * c["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * c["w"]["n_words"])


def host_of(docs: DataFrame, host: str) -> Column:
    return (F.col(host) if host in docs.columns else F.lit(None)).cast("string")


def rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """key, host, the counts and base_failed of every document."""
    c = docs.select(F.col(key).alias("key"), host_of(docs, host).alias("host"), rule_columns(text).alias("c"))
    inner = {"n_words": F.col("c.w.n_words"), "n_repeat_words": F.col("c.w.n_repeat_words")}
    return c.select("key", "host", *[inner.get(n, F.col(f"c.{n}")).alias(n) for n in COUNTS], failed(F.col("c")).alias("base_failed"))


def host_verdicts(counts: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """host, n, failed, rate shrunk towards the mean of all hosts, host_failed.

    The beta prior comes from the hosts themselves by the method of moments over their rates, each host counting once:
    mean m and variance v give a + b = m(1 - m)/v - 1, held to at least 1; with no spread between hosts the prior takes
    over (a + b = 10^6). rate = (failed + a) / (n + a + b).
    """
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    found = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).collect()[0]  # two numbers
    m, v = found.m or 0.0, found.v or 0.0
    weight = 1e6 if v <= 1e-12 else max(1.0, min(1e6, m * (1 - m) / v - 1))
    shrunk = (F.col("failed") + m * weight) / (F.col("n") + weight)
    return hosts.select("host", "n", "failed", shrunk.alias("rate"), (shrunk > host_rate).alias("host_failed"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", host_rate: float = HOST_RATE) -> DataFrame:
    """One row per document: key, host, its counts, base_failed, host_rate, host_failed, kept.

    The counts are computed once and kept in the shared folder; hosts are aggregated from there and joined back.
    """
    counts = materialised(rules(docs, text, host, key))
    verdicts = host_verdicts(counts, host_rate).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_failed")
    return counts.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The documents that pass, with their own columns: rows that fail a rule or whose host's shrunk failure rate is too high go."""
    h, c, bad = private(docs, "host", "failed", "bad")
    judged = materialised(docs.withColumns({h: host_of(docs, host), c: failed(rule_columns(text))}))
    verdicts = host_verdicts(judged.select(F.col(h).alias("host"), F.col(c).alias("base_failed")), host_rate).filter("host_failed").select(F.col("host").alias(bad))
    return judged.filter(~F.col(c)).join(verdicts, F.col(h).eqNullSafe(F.col(bad)), "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])
