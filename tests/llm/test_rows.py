"""The operators that answer row by row: against brute force, the libraries, and the odd cases every operator must bear."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import decontaminate, licenses, pieces, pii, quality, token_counts
from tidewatch.llm.queries import PIECE_MODEL, WORD_MODEL, tokenizer_path

ALPHABET = ["a", "b", "th", "é", " ", "  ", "\n", "\t", "▁", "'s", "…", "ΣΑΣ", "12", "½", "①", "İ", "ß", "ń", "字", "<|endoftext|>", "\x00", "\x1c", "\x85", "　", "🙂", "aaaa", "@x.y", "+1 555 ", "4111111111111111", "1.2.3.4"]


def texts(n=150, seed=1):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", " ", "\n", "a" * 3000, "the cat " * 400, out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i % 40 else None, t, "x" * (i % 3) or None, i) for i, t in enumerate(texts())], "doc_id long, text string, source string, spans long").repartition(3)


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.decode_pieces(pieces.encode_pieces(docs, path, keep=("spans",)), path).collect()
    every = texts()
    for r in rows:
        want = sp.encode(every[r.spans] or "")
        assert r.ids == want and r.decoded == sp.decode(want)
    both = pieces.encode_pieces(docs, path, keep=("spans",), decoded="decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, rows))
    assert pieces.encode_pieces(docs.limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(WORD_MODEL))
    every = texts()
    for r in token_counts.count_tokens(docs, tokenizer_path(WORD_MODEL), keep=("spans",)).collect():
        assert r.n_tokens == len(lib.encode(every[r.spans] or "", add_special_tokens=False).ids)


def brute_pii(t):
    out = []
    for k, (name, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else 0, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs):
    every = texts()
    for r in pii.find_pii(docs, keep=("source",)).join(docs.select("source"), "source", "left_semi").limit(5).collect():
        assert r.base is not None
    r = random.Random(4)
    pieces_ = ["a.b@c-d.e", "@", "x@y", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (342) 555-8390", "+12", " ", "-", ".", "7", "é", "00", "+"]
    for _ in range(3000):
        t = "".join(r.choice(pieces_) for _ in range(r.randint(0, 9)))
        assert sorted(pii.base_spans(t)) == brute_pii(t), t
    own = pii.base_spans(t := "pay to IBAN DE89 3704 0044 0532 0130 00 NOW, ssn 123-45-6789, call 415-555-2671 or 415-555-2672")
    kinds = Counter(pii.KINDS[k] for _, k, _ in own + pii.more_spans(t, own))
    assert kinds["iban"] == 1 and kinds["ssn"] == 1 and kinds["tel"] >= 1
    assert not pii.more_spans("DE89 3704 0044 0532 0130 01, 123-45-6789 pieces", [])
    masked = [x.text for x in pii.mask_pii(spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4!"), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert masked == ["mail <EMAIL> or <IP>!", None, ""]
    assert len(every) == docs.count()


def brute_quality(t):
    w = re.findall(r"[^ \t-\r]+", t or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    covered = {j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    more = ["a b c d e a b c d e", "x y z\nx y z\n \nx y z", "# $ a|b <c> " * 30, "w " * 40, "a b c d e f g h i j a b c d e"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts(40) + more)], "doc_id long, text string, source string")
    every = texts(40) + more
    for r in quality.quality_rules(df).collect():
        want = brute_quality(every[r.key])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, every[r.key]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.quality_rules(docs.limit(0)).count() == 0
    good = "one two three four five six seven eight nine ten eleven"
    hosts = [(i, "x" if i < 500 else good, "bad") for i in range(501)] + [(1000 + i, good, "good") for i in range(300)]
    kept = quality.quality_filter(spark.createDataFrame(hosts, "doc_id long, text string, source string"))
    assert kept.count() == 300 and kept.columns == ["doc_id", "text", "source"]


def edits(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            cur[j] = min(prev[j - 1] + (p[i - 1] != t[j - 1]), prev[j] + 1, cur[j - 1] + 1)
        prev = cur
    return min(prev)


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    letters = "abcd efgh"
    items = [(i, "".join(r.choice(letters) for _ in range(r.randint(12, 80)))) for i in range(6)] + [(7, "abc"), (8, ""), (9, None)]
    index = decontaminate.Items(items, 5, 0.12)
    found = []
    for _ in range(120):
        p = list(r.choice(items[:6])[1])
        for _ in range(r.randint(0, 12)):
            j = r.randrange(len(p)) if p else 0
            p[j : j + r.randint(0, 1)] = r.choice(["", r.choice(letters)])
        found.append("".join(r.choice(letters) for _ in range(r.randint(0, 90))) + "".join(p) + "".join(r.choice(letters) for _ in range(r.randint(0, 60))))
    for x, hits in zip(found, index.search(found), strict=True):
        for k in range(6):
            least = edits(index.codes[k].tolist(), decontaminate.folded(x).tolist())
            own = [h for h in hits if h[0] == k]
            assert bool(own) == (least <= index.edits[k]) and (not own or min(h[3] for h in own) == least)
    df = spark.createDataFrame([(1, f"so {items[0][1].upper()} end", 5), (2, "clean", 5), (None, None, 5), (3, "xabcx", 5)], "doc_id long, text string, hits long")
    assert decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), keep=("doc_id", "hits")).columns == ["doc_id", "hits_", "hits"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: [(h.item_id, h.edits) for h in x.hits] for x in decontaminate.find_contamination(df, bench).collect()}
    assert (0, 0) in got[1] and got[2] == [] == got[None] and got[3] == [(7, 0)]
    assert all(x.hits == [] for x in decontaminate.find_contamination(df, bench.limit(0)).collect())


def test_repetitive_texts_stay_small():
    """A 1 MB text of one letter, one of two in turn and a separator line against items of the same."""
    import resource

    items = [(1, "a" * 500), (2, "-=" * 200), (3, "=" * 120)]
    index = decontaminate.Items(items, decontaminate.Q, decontaminate.RATE)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    one, two, three = index.search(["a" * 1_000_000, "b" + "-=" * 20_000, "x " + "=" * 300 + " y"])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
    assert 1_000_000 // (500 + 41) <= len(one) <= 2000  # a region per band of 41 diagonals, none that overlap
    assert {h[0] for h in one} == {0} and all(h[3] == 0 for h in one)
    assert {h[0] for h in two} == {1} and 40_000 // (400 + 33) <= len(two) <= 100 and [h[0] for h in three] == [2, 2]
    for found in (one, two, three):
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_item_blocks_give_one_answer(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} with its own words {i * 7919}") for i in range(20)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x item number 3 with its own words 23757 y"), (2, "none")], "doc_id long, text string")
    want = sorted((x.doc_id, sorted(h.item_id for h in x.hits)) for x in decontaminate.find_contamination(df, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert decontaminate.item_blocks(items)[0] > 1
    assert sorted((x.doc_id, sorted(h.item_id for h in x.hits)) for x in decontaminate.find_contamination(df, items).collect()) == want and 3 in want[0][1]


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE).scan
    two = scan("foo " + mit.replace("free", "at no") + " baz" * 30 + " " + mit)
    assert [x[2] for x in two] == ["MIT", "MIT"] and two[0][3] < 1 == two[1][3]
    assert [x[2] for x in scan("a b. Licensed under CC BY-NC 4.0. c")] == ["CC-BY-NC-4.0/line"] and scan("license of the software is to be granted") == []
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(licenses.increasing([ord(c) for c in a])) == brute_lis([ord(c) for c in a])
    df = spark.createDataFrame([(1, "Released under the MIT License.", "q"), (None, None, "q"), (3, "", "q")], "doc_id long, text string, licenses string")
    got = {x.doc_id: [f.license for f in x.licenses] for x in licenses.scan_licenses(df).collect()}
    assert got == {1: ["MIT/line"], None: [], 3: []}


def brute_lis(v):
    best = [1] * len(v)
    for i in range(len(v)):
        best[i] = max([best[j] + 1 for j in range(i) if v[j] < v[i]], default=1)
    return max(best, default=0)


def test_queries_derive_the_digests(spark, tmp_path):
    from tidewatch.llm.queries import QUERIES

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op4_sentencepiece"](spark, str(tmp_path)).collect()}
    assert got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = np.frombuffer(pieces.model(tokenizer_path(PIECE_MODEL)).encode(["a b"])[0], np.int32).tolist()
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[1].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
