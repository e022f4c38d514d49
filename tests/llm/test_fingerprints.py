import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import merkle

SPACE = " \t\n\x0b\f\r"
PARAGRAPH = re.compile(r"[^.!?\n]{1,64}[^.!? \t\n\x0B\f\r]{0,32}[.!? \t\n\x0B\f\r]{0,64}|[.!? \t\n\x0B\f\r]{1,64}")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def brute_tree(text):
    """(root, [(node, [(node, text)])]): the definition, word for word."""
    groups, now = [], []
    paragraphs = PARAGRAPH.findall(text)
    for i, p in enumerate(paragraphs):
        now.append((sha(p), p))
        if sha(p)[0] in "08" or "\n\n" in p or i == len(paragraphs) - 1:
            groups += [now[k : k + 32] for k in range(0, len(now), 32)]
            now = []
    sections = [(sha("".join(n for n, _ in g)), g) for g in groups]
    return sha("".join(n for n, _ in sections)), sections


def brute_levels(text):
    _, sections = brute_tree(text)
    n = sum(len(g) for _, g in sections)
    words = re.findall(f"[^{SPACE}]+", text)
    return (
        [md5(text[i : i + 2])[:8] for i in range(max(1, len(text) - 1))] if 0 < len(text) <= 48 else [],
        [md5(w)[:8] for w in words] if n <= 64 and len(words) <= 64 else [],
        [x[:8] for _, g in sections for x, _ in g] if n <= 256 else [],
        [x[:8] for x, _ in sections],
    )


def brute_printed(text):
    root, sections = brute_tree(text)
    pairs, words, paragraphs, _ = brute_levels(text)
    listed = [x[:8] + (":" + ".".join(y[:8] for y, _ in g) if paragraphs else "") for x, g in sections]
    return "/".join([root, ",".join(listed), ".".join(words), ".".join(pairs)])


def brute_likeness(a, b):
    if a == b:
        return 1.0
    for x, y in zip(brute_levels(a), brute_levels(b), strict=True):
        if x and y:
            return 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y))
    return 0.0


def brute_next(rows):
    """The rows in order: nulls first, then by key, digest and text; each with the text that follows."""
    tie = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest() >> 33
    ordered = sorted(((k is not None, k or 0, tie(t or ""), t or "") for k, t in rows))
    texts = [x[3] for x in ordered]
    return [(x[1] if x[0] else None, t, n) for x, t, n in zip(ordered, texts, texts[1:] + texts[:1], strict=True)]


def some_texts(n, seed):
    r = random.Random(seed)
    parts = ["one", "two", "thé", "字" * 5, "x" * 40, "🙂", "a.", "b!", "\n", "\n\n", " ", "  ", "\t", "3.14", "end.\n", "\x0b", "\x85", "longer", "words"]
    out = [" ".join(r.choice(parts) for _ in range(r.choice((0, 1, 3, 9, 40, 90, 400)))) for _ in range(n)]
    out += ["", " ", "a", "ab", "." * 500, "\n" * 300, "w" * 5000, "same line of text\n" * 300, "no stop at all " * 900]
    return out + [out[4], out[4] + " more"]


@pytest.fixture(scope="module")
def texts():
    return some_texts(60, 5)


def test_printed_trees_and_likeness_equal_the_definition(spark, texts):
    r = random.Random(2)
    pairs = [(t, r.choice(texts)) for t in texts] + [(t, t[: len(t) * 3 // 4] + u[: len(t) // 4]) for t, u in zip(texts, reversed(texts), strict=True)]
    df = spark.createDataFrame(pairs, "a string, b string").select("*", merkle.fingerprint(F.col("a")).alias("fa"), merkle.fingerprint(F.col("b")).alias("fb"))
    for x in df.withColumn("near", merkle.likeness(F.col("fa"), F.col("fb"))).collect():
        assert x.fa == brute_printed(x.a) and x.fb == brute_printed(x.b)
        assert x.near == brute_likeness(x.a, x.b)
        assert (x.fa == x.fb) == (x.a == x.b) == (x.fa.split("/")[0] == x.fb.split("/")[0])


def test_differing_branches_locate_edits(spark, texts):
    pairs = [(t, t[: len(t) // 2] + "EDITED" + t[len(t) // 2 + 3 :]) for t in texts if len(t) > 200]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"fa": merkle.fingerprint(F.col("a")), "fb": merkle.fingerprint(F.col("b"))})
    rows = df.select("*", merkle.edits(F.col("a"), F.col("fb")).alias("spans"), merkle.first_edit(F.col("fa"), F.col("fb")).alias("first")).collect()
    for x in rows:
        _, mine = brute_tree(x.a)
        _, _, theirs, sections = brute_levels(x.b)
        want, at, first = [], 0, None
        for i, (node, group) in enumerate(mine):
            for j, (p, text) in enumerate(group):
                if node[:8] not in sections and p[:8] not in theirs:
                    want.append((at, at + len(text)))
                at += len(text)
                other = brute_tree(x.b)[1]
                if first is None and (i >= len(other) or (other[i][0] != node and (j >= len(other[i][1]) or other[i][1][j][0] != p))):
                    first = (i, j)
        assert [(s.start, s.end) for s in x.spans] == want
        assert x.first.section == (first[0] if first else len(mine)) and (not theirs or x.first.paragraph is None or x.first.paragraph == first[1])
        if theirs and x.a[len(x.a) // 2 : len(x.a) // 2 + 3] != "EDI":  # the changed place lies in one of them, unless its paragraphs occur elsewhere too
            assert any(s.start <= len(x.a) // 2 + 3 and s.end >= len(x.a) // 2 for s in x.spans) or Counter(p for _, g in mine for p, _ in g).most_common(1)[0][1] > 1


def compared(df, **more):
    return [(x.key, x.text, x.edited, x.near_edited, x.near_next) for x in merkle.compared(df, **more).collect()]


def wanted(rows):
    out = []
    for k, t, n in brute_next(rows):
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        out.append((k, t, e, brute_likeness(t, e), brute_likeness(t, n)))
    return out


def test_next_rows_over_ranges_ties_nulls_and_one_hot_key(spark, texts):
    r = random.Random(8)
    rows = [(r.choice((None, 7, 7, 7, -3, r.randint(-50, 500), 1 << 62)), r.choice([*texts, None])) for _ in range(300)]
    rows += rows[:40]  # whole rows repeat
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", F.lit("x")).withColumn("fingerprint", F.lit(1))
    order = lambda x: (x[0] is not None, x[0] or 0, *map(repr, x[1:]))
    for size in (3, 40, 10_000):
        assert sorted(compared(df, range_rows=size), key=order) == sorted(wanted(rows), key=order)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert compared(spark.createDataFrame([], schema)) == []
    assert compared(spark.createDataFrame([(4, "only one here")], schema)) == wanted([(4, "only one here")])
    assert compared(spark.createDataFrame([(4, None)], schema)) == [(4, "", "", 1.0, 1.0)]
    plain = spark.createDataFrame([(i, f"text {i}") for i in range(1500)], schema)
    got = {x.key: x.next_text for x in merkle.fingerprints(plain, range_rows=100).collect()}
    assert got == {i: f"text {(i + 1) % 1500}" for i in range(1500)}


def test_a_very_long_text(spark):
    r = random.Random(1)
    text = " ".join(f"w{r.randint(0, 10**9)}" + r.choice(("", "", "", ".")) for _ in range(200_000))
    ((_, _, e, near, _),) = compared(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert len(e) == len(text) and 0.7 < near < 0.8


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, "a b. c") for i in range(2000)], "doc_id long, text string")
    plan = merkle.compared(df, range_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
