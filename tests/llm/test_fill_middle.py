import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import fill_middle
from tidewatch.llm.fill_middle import restore, restored, transformed

PARTS = ["a", "b", "Z", "é", " ", "\n", "字", "🙂", "<", "P", ">", "<P>", "<S", "M>", "1", "<M", "S", "word", "[", "`", "@", "{", "\x00"]


def numbers(key):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute(key, text):
    t = text or ""
    h1, h2, h3, h4 = numbers(key)
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some(n, seed=3):
    r = random.Random(seed)
    return [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))) for i in range(n)]


def test_kernel_against_brute_force():
    rows = [*some(20_000), (20_000, "a" * 5000), (20_001, "")]
    out = transformed(pa.array([t for _, t in rows]), np.array([numbers(k) for k, _ in rows]))
    back = restored(out["output"], out["form"]).to_pylist()
    assert list(zip(*[out[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")], strict=True)) == [brute(k, t) for k, t in rows]
    assert back == [t for _, t in rows]


def test_slices_of_a_batch():
    rows = some(300, 9)
    whole = pa.array([t for _, t in rows])
    for a, b in ((0, 0), (17, 90), (299, 300)):
        part = whole.slice(a, b - a)
        out = transformed(part, np.array([numbers(k) for k, _ in rows[a:b]], np.int64).reshape(-1, 4))
        assert out["output"].to_pylist() == [brute(k, t)[4] for k, t in rows[a:b]]


def test_operator_and_round_trip(spark):
    rows = [*some(500), (None, "null key with words"), (7, None), (8, "twice"), (8, "twice"), (9, "long text " * 50_000)]
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, form string, draws long, N int").repartition(3)
    made = fill_middle.fill_middle(df, keep=("doc_id", "form", "N", "draws"))
    assert made.columns == ["doc_id", "form_", "N_", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    order = lambda x: tuple(map(repr, x))
    got = [(x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in made.collect()]
    assert sorted(got, key=order) == sorted(((k, *brute(k, t)) for k, t in rows), key=order)
    back = restore(made.withColumn("restored_from", F.lit(1)), keep=("doc_id", "restored_from"))
    assert sorted(((x.doc_id, x.restored) for x in back.collect()), key=order) == sorted(((k, t or "") for k, t in rows), key=order)
    assert fill_middle.fill_middle(df.limit(0)).count() == 0
    assert restore(made.limit(0)).count() == 0


def test_all_forms_occur(spark):
    df = spark.createDataFrame([(i, f"words of text {i}") for i in range(4000)], "doc_id long, text string")
    n = {x.form: x["count"] for x in fill_middle.fill_middle(df).groupBy("form").count().collect()}
    assert 300 < n["plain"] < 500 and 600 < n["spm"] < 850 and n["plain"] + n["spm"] + n["psm"] == 4000
