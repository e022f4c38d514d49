import random
import re
from collections import defaultdict

from tidewatch.llm.substring_dedup import dedup_substrings
from tidewatch.llm.suffix_dedup import dedup_suffixes

SCHEMA = "doc_id long, text string, k string, rid string"


def corpus(seed, words, n=60):
    r = random.Random(seed)
    passages = [" ".join(r.choice(words) for _ in range(r.randint(3, 14))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 5))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(n + i, rows[r.randrange(n)][1]) for i in range(12)]
    rows += [(n + 20, None), (n + 21, ""), (n + 22, "x " * 50), (None, passages[0] + " " + passages[1]), (n + 23, "\x00a\x00\x00a" * 9), (n + 24, "é" * 40 + passages[2])]
    r.shuffle(rows)
    return [(a, b, "c", "d") for a, b in rows]


def brute_words(rows, window):
    place = defaultdict(list)
    split = {}
    for i, t in [(r[0], r[1]) for r in rows]:
        w = re.findall(r"[^ \t-\r]+", t or "")
        split[i] = w
        for s in range(len(w) - window + 1):
            place[tuple(w[s : s + window])].append((-1 if i is None else i, s))
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if min(place[tuple(w[s : s + window])]) < (-1 if i is None else i, s):
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def brute_bytes(rows, window):
    count = defaultdict(int)
    for r in rows:
        b = (r[1] or "").encode()
        for s in range(len(b) - window + 1):
            count[b[s : s + window]] += 1
    out = {}
    for r in rows:
        b = (r[1] or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = [True] * window
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[r[0]] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_words_against_brute_force(spark):
    for seed, words in ((1, "a b c d".split()), (2, [f"w{i}" for i in range(300)]), (3, ["the", "of", "é", "x\x00", "x"])):
        rows = corpus(seed, words)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(df, window=6, gram=3).collect()}
        assert got == brute_words(rows, 6)


def test_passages_shorter_than_the_window_are_counted(spark):
    for seed, words in ((7, ["ab", "a", "b"]), (8, [f"w{i}" for i in range(300)]), (9, ["é", "\x00", "z"])):
        rows = corpus(seed, words)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {r.doc_id: r for r in dedup_suffixes(df, window=30, gram=6, report=14).collect()}
        assert {k: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for k, r in got.items()} == brute_bytes(rows, 30)
        short = brute_bytes(rows, 14)
        assert {k: r.n_shared for k, r in got.items()} == {k: v[1] for k, v in short.items()}
        assert all(r.longest_shared <= r.n_shared <= r.longest_shared * max(1, short[k][2]) and r.n_removed <= r.n_shared for k, r in got.items())


def test_passages_of_over_fifty_words_are_seen(spark):
    """Planted passages of 51 to 60 words with production parameters: removed from 400 bytes on, counted at every length."""
    r = random.Random(10)
    fresh = lambda n, longest=9: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, longest))) for _ in range(n))
    planted = [fresh(r.randint(51, 60), (5, 9, 14)[i % 3]) for i in range(30)]
    rows = [(i, f"{fresh(40)} {p} {fresh(30)}") for i, p in enumerate(planted + planted)] + [(100 + i, fresh(100)) for i in range(30)]
    got = {x.doc_id: x for x in dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {k: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for k, x in got.items()} == brute_bytes(rows, 400)
    sizes = [len(p) for p in planted]
    assert min(sizes) < 230 and max(sizes) > 400 and sum(n < 390 for n in sizes) >= 15  # most hold no repeated string of 400 bytes
    for i, p in enumerate(planted):
        for d in (i, 30 + i):
            assert got[d].longest_shared >= len(p) and (got[d].n_removed > 0 or len(p) < 400)
    assert all(got[100 + i].n_shared == 0 for i in range(30))


def test_words_that_collide_in_power_sums_stay_apart(spark):
    """Words whose polynomial fingerprints modulo 2**64 are equal for every odd base."""
    t = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = t.translate(str.maketrans("ab", "ba"))
    own = " ".join(f"v{i}" for i in range(19))
    rows = [(1, f"p {own} {t} q"), (2, f"r {own} {other} s")]
    got = {x.doc_id: x.n_removed for x in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_bytes_against_brute_force(spark):
    for seed, words in ((4, ["ab", "a", "b"]), (5, [f"w{i}" for i in range(300)]), (6, ["é", "\x00", "z"])):
        rows = corpus(seed, words)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_suffixes(df, window=20, gram=6).collect()}
        assert got == brute_bytes(rows, 20)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).count() == 0
    assert dedup_suffixes(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(200))
    twice = spark.createDataFrame([(1, text, "", ""), (1, text, "", "")], SCHEMA)
    assert [(r.n_words, r.n_removed) for r in dedup_substrings(twice).collect()] == [(200, 0)] * 2  # one and the same place
    assert [r.n_removed for r in dedup_suffixes(twice).collect()] == [len(text)] * 2


def test_buckets_far_above_the_limit(spark):
    """Every bucket is cut wherever its leading bytes change: nothing is lost between the parts."""
    rows = corpus(11, [f"w{i}" for i in range(40)], n=150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for held in (1, 2000):
        got = {r.doc_id: r for r in dedup_suffixes(df, window=30, gram=6, report=14, held=held).collect()}
        assert {k: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for k, r in got.items()} == brute_bytes(rows, 30)
        assert {k: r.n_shared for k, r in got.items()} == {k: v[1] for k, v in brute_bytes(rows, 14).items()}
