import random
import re

import numpy as np

from tidewatch.llm import near_join as nj


def grams(text):
    w = re.findall(r"[^ \t-\r]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows]
    n = len(sets)
    root = list(range(n))
    links = [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) * 1.8 >= 0.8 * (len(a) + len(b)) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)), key=lambda r: sets[r][0])
                root[y] = x
    return sorted((sets[i][0], sets[find(i)][0], links[i]) for i in range(n))


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 12)):
            t = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t))
    rows += ["", None, "one", "one", "  ", "a b c d e", "a b c d e f"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 2048), (2, 3)):  # with tiny blocks every larger group is dealt out as pairs of blocks
        monkeypatch.setattr(nj, "BLOCK_SETS", block)
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, node string").repartition(3)
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in nj.near_join(df).collect())
        want = brute(rows)
        assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)  # the forest's recall
        assert sum(g[2] for g in got) >= 0.98 * sum(w[2] for w in want)
        assert all(g[2] <= w[2] for g, w in zip(got, want))


def test_empty_table(spark):
    assert nj.near_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_are_shortened_until_the_recall(spark):
    assert nj.prefix_depth(16, 6, 0.8, 0.9995) == 4 and nj.prefix_depth(16, 6, 0.95, 0.99) == 6 and nj.prefix_depth(16, 6, 0.3, 0.9995) == 1
    leaders = nj.Leaders()
    m = np.arange(96, dtype=np.uint32)
    far = m + 1000
    near = m.copy()
    near[:30] += 500  # 66 of 96 minima
    assert leaders.meet(1, m, np.array([1, 1], np.uint32)) == []
    assert leaders.meet(2, far, np.array([1, 2], np.uint32)) == []
    assert leaders.meet(3, near, np.array([9, 9], np.uint32)) == [(3, 1)] and len(leaders.node) == 3
    assert leaders.meet(4, m, np.array([1, 1], np.uint32)) == [(4, 1)]  # all but equal at the longest prefix: no further
    assert leaders.meet(5, m, np.array([9, 9], np.uint32)) == [(5, 3)]  # one join of each group
    assert len(leaders.node) == 3


def test_different_sets_are_different_nodes(spark):
    """Classes of documents that share doc_id, null doc_ids and clashing columns."""
    a, b = "a b c d e f g", "h i j k l m n"
    df = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (None, "q r", 4), (None, "q r", 5), (7, None, 6), (7, "", 7), (8, " ", 8)], "doc_id long, text string, k int")
    kept = sorted((r.doc_id or 0, r.text or "") for r in nj.keep_one(df).collect())
    assert kept == sorted([(3, a), (5, b), (0, "q r"), (7, ""), (8, " ")])
    assert nj.keep_one(df).columns == df.columns
