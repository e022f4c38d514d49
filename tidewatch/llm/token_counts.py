"""Token counts of a word-end byte-pair vocabulary by heap and linked list: initial symbols minus merges, no identifiers.

The vocabulary file is a parameter and is read on each worker. Its special strings inside a text count one token each;
the rest is NFC-normalised, white space dropped, lower-cased and split into words, numbers' digits and other runs, and
each such token's bytes are merged: the pair of lowest rank (leftmost of equals) is popped from a heap, its two symbols
are joined in a linked list, and pairs that no longer stand are skipped when popped. Counts of white-space words are kept
in a bounded cache, so a frequent word is merged once.

Defined results: a null text counts as empty (0 tokens); repeated rows each get a row; extra columns are ignored; an empty
table gives no rows; a word of any length is merged whole (n log n).
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewatch.llm.base import carried, map_batches

#: Words kept in a worker's cache before it is emptied; bounds memory, not results.
CACHE = 400_000
#: Unicode's White_Space, which str.split() exceeds by U+001C to U+001F.
WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = regex.compile(f"[{WHITE}]+")
# The vocabulary's own pattern for tokens.
TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")


class Counter:
    """counter[word] is the number of tokens of a word without white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = model["vocab"]
        ids = self.ids
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hint = special[0][:2] if special else None
        letters = [c for r in (range(33, 127), range(161, 173), range(174, 256)) for c in r]
        others = [b for b in range(256) if b not in letters]
        shown = {b: chr(b) for b in letters} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.start = [ids[shown[b]] for b in range(256)]
        self.last = [ids[shown[b] + self.suffix] for b in range(256)]
        self.words: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def merged(self, token: str) -> int:
        raw = token.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n < 2:
            return n
        start, pairs = self.start, self.pairs
        sym = [start[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        heap = [(p[0], i, p[1], sym[i], sym[i + 1]) for i in range(n - 1) if (p := pairs.get((sym[i], sym[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            _, i, new, a, b = pop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if p := pairs.get((new, sym[k])):
                    push(heap, (p[0], i, p[1], new, sym[k]))
            if (h := before[i]) >= 0 and (p := pairs.get((sym[h], new))):
                push(heap, (p[0], h, p[1], sym[h], new))
        return left

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is not told apart
        total, kept = 0, self.tokens
        for token in TOKEN.findall(text.lower()):
            n = kept.get(token)
            if n is None:
                if len(kept) >= CACHE:
                    kept.clear()
                n = kept[token] = self.merged(token)
            total += n
        return total

    def count(self, text: str) -> int:
        words = SPLIT.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        total, kept = 0, self.words
        for w in words:
            n = kept.get(w)
            if n is None:
                if self.hint and self.hint in w:
                    n = sum(map(self.plain, self.special.split(w))) + len(self.special.findall(w))
                else:
                    n = self.plain(w)
                if len(kept) >= CACHE:
                    kept.clear()
                kept[w] = n
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens") -> DataFrame:
    """The columns named in keep and the number of tokens of every whole text, without added special tokens."""
    rows, ddl, rest, _ = carried(docs, text, keep, (out,))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        n = [counter.count(t) for t in batch.columns[-1].to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*rest, out])

    return map_batches(rows, counted, f"{ddl}, `{out}` bigint")
