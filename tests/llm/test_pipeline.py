import random

import corpus_pipeline as cp
from tidewatch.llm.near_join import keep_one
from tidewatch.llm.pieces import model
from tidewatch.llm.pii import base_spans
from tidewatch.llm.queries import PIECE_MODEL, tokenizer_path


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_stages_in_order(spark, tmp_path):
    r = random.Random(9)
    item = prose(r, 30)
    base = [prose(r, 80) for _ in range(6)]
    words = base[0].split()
    near = " ".join([*words[:40], "zzz", *words[41:]])
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, near), (11, base[1]), (12, "too short"), (13, "again and again it is " * 40), (14, f"{prose(r, 40)} {item} {prose(r, 20)}"), (15, f"{prose(r, 40)} mail a.b@c.de now {prose(r, 20)}"), (16, None), (17, "")]
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    got = {x.doc_id: x for x in cp.run(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 15}
    assert "<EMAIL>" in got[15].decoded and not base_spans(got[15].decoded)
    m = model(tokenizer_path(PIECE_MODEL))
    assert all(m.encode([x.decoded])[0] == bytes(__import__("numpy").array(x.ids, "int32")) and x.n_tokens == len(x.ids) for x in got.values())  # an exact round trip
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def brute(rows, items):
    """The documents that the first three stages keep, by the rules' own words: doc_ids."""
    from tests.llm.test_near_join import grams
    from tests.llm.test_rows import brute_quality, edits

    good = [(i, t) for i, t in rows if (q := brute_quality(t))[0] >= 10 and 100 * q[4] <= 20 * q[0]]
    root = {i: i for i, _ in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: grams(t) for i, t in good}
    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    one = [(i, t) for i, t in good if find(i) == i]
    codes = lambda t: [ord(c) for c in " ".join(t.lower().split(" "))]
    return {i for i, t in one if not any(edits(codes(p), codes(t)) <= int(0.08 * len(p)) for p in items)}


def test_against_brute_force(spark, tmp_path):
    """Random documents with near copies, junk, repeats and near passages of items; columns that bear made names."""
    r = random.Random(21)
    items = [prose(r, 14) for _ in range(3)]
    texts = []
    for _ in range(14):
        t = prose(r, r.randint(4, 60)).split()
        for _ in range(r.randint(1, 3)):
            u = list(t)
            for _ in range(r.choice((0, 1, 1, 5))):
                u[r.randrange(len(u))] = "new"
            texts.append(" ".join(u))
    for p in items:
        q = list(p)
        q[5], q[30] = "#", "#"
        texts += [f"{prose(r, 12)} {''.join(q)} {prose(r, 9)}", f"{prose(r, 12)} {p[: len(p) // 2]} {prose(r, 9)}"]
    texts += ["so it is " * 12, prose(r, 9)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    made = [(i, t, "s", 1, 2, 3, 4, 5) for i, t in rows]
    names = "doc_id long, text string, source string, ids int, n_tokens int, failed int, k int, hits int"
    spark.createDataFrame(made, names).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "ids_", "n_tokens_", "failed", "k", "hits", "n_tokens", "ids", "decoded"]
    got = out.collect()
    assert {x.doc_id for x in got} == brute(rows, items)
    assert {(x.ids_, x.n_tokens_, x.failed, x.k, x.hits) for x in got} == {(1, 2, 3, 4, 5)}


def test_one_row_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "q"), (None, None), (3, None)], "doc_id long, text string")
    assert sorted((x.doc_id is None, x.doc_id, x.text) for x in keep_one(df).collect() if x.doc_id is not None) == [(False, 1, "a b c d e f g"), (False, 3, None)]
