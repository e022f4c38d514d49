"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters found with at most e edits shares at least m + 1 - q(e + 1) of its q-grams with that region of a
document, all on diagonals (document place minus item place) at most e apart. Shared q-grams are counted in overlapping
diagonal bands; bands that reach the bound are verified by banded alignment, the item whole against any part of the region.
e is RATE of the item's length, lowered where the bound would fall below one shared q-gram. Characters are compared in
lower case, and every white-space character as a space; places are code points of the text itself.

The items are broadcast in blocks of about BLOCK characters at most (their size is checked), one pass over the documents
per block, written out in between; a benchmark is small, so that is one block. Documents are never shuffled. Memory is that
of one Arrow batch and its bands, also where texts and items repeat one q-gram over and over (see Items.bands).

Defined results: a null text is empty; items that are null or empty match nothing; items shorter than q characters are
looked for exactly; repeated items each count; repeated rows each get a row; a null doc_id is kept; extra columns are
ignored, kept ones that bear the name of the hits are carried with _ appended; an empty benchmark or table finds nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import carried, dropped, map_batches, materialised, text_of
from tidewatch.llm.rolling import mix

Q, RATE = 10, 0.08
#: Characters of one block of items.
BLOCK = 8 << 20
#: Shared q-grams expanded at once.
SLICE = 1 << 20
TABLE_BITS = 22
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_FOLD = np.arange(0x10000, dtype=np.uint32)
_FOLD[:] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x10000)]
_FOLD[_WHITE] = 32


def folded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x10000, _FOLD[np.minimum(codes, 0xFFFF)], codes)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = codes[:n].astype(np.uint64)
    for j in range(1, q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return mix(h)


class Items:
    """A block of items, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float):
        rows = [(i, t) for i, t in rows if t]
        self.q = q
        self.ids = [i for i, _ in rows]
        self.codes = [folded(t) for _, t in rows]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size = size
        self.edits = np.maximum(0, np.minimum(np.floor(rate * size), (size - q) // q)).astype(np.int64)
        self.bound = size + 1 - q * (self.edits + 1)
        self.step = self.edits + 1
        self.short = [k for k in range(len(rows)) if size[k] < q]
        per = [grams(c, q) for c in self.codes]
        h = np.concatenate([*per, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(g) for g in per])
        place = np.concatenate([*(np.arange(len(g)) for g in per), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def distance(self, k: int, region: np.ndarray) -> tuple[int, int, int]:
        """Least edits of the whole item against a part of the region, and that part's start and end; banded over diagonals 0 to len(region) - m + e."""
        item, e = self.codes[k], int(self.edits[k])
        m, n = len(item), len(region)
        text, own = region.astype("<u4").tobytes(), item.astype("<u4").tobytes()
        at = text.find(own)
        while at % 4 and at >= 0:
            at = text.find(own, at + 1)
        if at >= 0:
            return 0, at // 4, at // 4 + m
        if e == 0 or n < m - e:
            return e + 1, 0, 0
        lo, width = -e, n - m + 2 * e + 1  # column j of row i is at i + lo + its place in the band
        big = m + n
        cols = np.arange(width)
        cost = np.where((cols + lo >= 0) & (cols + lo <= n), 0, big)
        start = np.clip(cols + lo, 0, n)
        padded = np.concatenate([np.full(e + 1, 0xFFFFFFFF, np.uint32), region, np.full(width + 2, 0xFFFFFFFF, np.uint32)])
        for i in range(1, m + 1):
            j = i + lo + cols
            inside = (j >= 0) & (j <= n)
            sub = cost + (padded[i + lo + e : i + lo + e + width] != item[i - 1])
            up = np.append(cost[1:] + 1, big)
            take = up < sub
            now = np.where(inside, np.where(take, up, sub), big)
            begin = np.where(take, np.append(start[1:], 0), start)
            run = now - cols  # along the row: insertions
            best = np.minimum.accumulate(run)
            source = np.maximum.accumulate(np.where(run == best, cols, 0))
            cost, start = best + cols, begin[source]
            cost = np.where(inside, cost, big)
            if cost.min() > e:
                return e + 1, 0, 0
        at = int(cost.argmin())
        return int(cost[at]), int(start[at]), min(n, m + lo + at)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item's place in ids, start, end, edits), one for each region that holds the item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        codes = [folded(t) for t in texts]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        offset = np.cumsum(size + 1) - size - 1
        flat = np.full(int((size + 1).sum()), 0xFFFFFFFF, np.uint32)
        for o, c in zip(offset.tolist(), codes, strict=True):
            flat[o : o + len(c)] = c
        for k in self.short:
            own = self.codes[k]
            for d, c in enumerate(codes):
                if len(c) >= len(own):
                    views = np.lib.stride_tricks.sliding_window_view(c, len(own))
                    out[d] += [(k, int(s), int(s) + len(own), 0) for s in np.flatnonzero((views == own).all(1))]
        h = grams(flat, self.q)
        if not len(h) or not len(self.grams):
            return out
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
        hit = self.grams[at] == h[maybe]
        place, at = maybe[hit], at[hit]
        if not len(place):
            return out
        pair, band, n = self.bands(place, at, offset)
        for p, b in zip(pair[n >= self.bound[pair % len(self.ids)]].tolist(), band[n >= self.bound[pair % len(self.ids)]].tolist(), strict=True):
            d, k = divmod(p, len(self.ids))
            step, m, e = int(self.step[k]), int(self.size[k]), int(self.edits[k])
            low = b * step - m  # the band's diagonals: low to low + 2 * step - 1
            a, z = max(0, low - e), min(int(size[d]), low + 2 * step - 1 + m + e)
            edits, s, t = self.distance(k, codes[d][a:z])
            if edits <= e:
                out[d].append((k, a + s, a + t, edits))
        return [_distinct(x) for x in out]

    def bands(self, place: np.ndarray, at: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document * items + item, band, shared q-grams) of the overlapping bands that share any; place: of the documents'
        q-grams that items have, at: their number there.

        A q-gram that stands x times in a text and y times in the items makes x * y hits. They are counted SLICE at a time,
        so memory is bound by the bands, not by the hits.
        """
        count = self.count[at]
        ends = np.cumsum(count)
        doc_of = np.searchsorted(offset, place, "right") - 1
        found: list[np.ndarray] = []
        for lo in range(0, int(ends[-1]), SLICE):
            hit = np.arange(lo, min(lo + SLICE, int(ends[-1])))
            own = np.searchsorted(ends, hit, "right")
            row = self.first[at[own]] + hit - (ends[own] - count[own])
            item, doc = self.item[row], doc_of[own]
            band = (place[own] - self.place[row] - offset[doc] + self.size[item]) // self.step[item]  # never negative
            found.append(_summed(doc * len(self.ids) + item, band, np.ones(len(hit), np.int64)))
            if len(found) > 16:
                found = [_summed(*np.concatenate(found, axis=1))]
        pair, band, n = np.concatenate(found, axis=1)
        # Each hit lies in its own band and, by the overlap, in the one before.
        return tuple(_summed(np.append(pair, pair), np.append(band, band - 1), np.append(n, n)))


def _summed(pair: np.ndarray, band: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows pair, band, n with the sum of n of each distinct pair and band, in order."""
    order = np.lexsort((band, pair))
    pair, band = pair[order], band[order]
    at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])))
    return np.stack([pair[at], band[at], np.add.reduceat(n[order], at)])


def _distinct(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping regions of one item the one of fewest edits, then the first."""
    out: list[tuple[int, int, int, int]] = []
    item, starts, ends = None, [], []  # of the item's regions so far, in order
    for x in sorted(set(found), key=lambda f: (f[0], f[3], f[1], f[2])):
        if x[0] != item:
            item, starts, ends = x[0], [], []
        i = bisect_left(starts, x[2])  # regions that begin before x ends: the last of them ends last
        if not i or ends[i - 1] <= x[1]:
            out.append(x)
            starts.insert(i, x[1])
            ends.insert(i, x[2])
    return sorted(out, key=lambda f: (f[1], f[0], f[2]))


HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:bigint>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """The number of blocks of about BLOCK characters at most, and a function that fetches one of them."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("i"), text_of(text).alias("t"))
    total = rows.agg(F.sum(F.length("t")).alias("n")).collect()[0].n or 0
    n = -(-2 * total // BLOCK) if total > BLOCK else 1

    def fetch(b: int) -> list[tuple[int, str]]:
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        return sorted((-1 if r.i is None else r.i, r.t) for r in own.collect())

    return n, fetch


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "hits"
) -> DataFrame:
    """The columns named in keep and out, the hits (item_id, start, end, edits) of every row."""
    rows, ddl, rest, own = carried(docs, text, keep, (out,))
    context = docs.sparkSession.sparkContext

    def one(block: list[tuple[int, str]], rows: DataFrame, earlier: bool, more: bool) -> DataFrame:
        """Adds one block's hits to those of earlier blocks; the text stays while more blocks follow."""
        sent = context.broadcast(block)  # about BLOCK characters at most
        items: list[Items] = []

        def searched(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not items:
                items.append(Items(sent.value, q, rate))
            found = items[0].search(batch.column(batch.schema.names.index(own)).to_pylist())
            cells = [[{"item_id": items[0].ids[k], "start": s, "end": t, "edits": e} for k, s, t, e in x] for x in found]
            if earlier:
                cells = [a + b for a, b in zip(batch.column(batch.schema.names.index(out)).to_pylist(), cells, strict=True)]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | {out: pa.array(cells, _HITS)}
            names = [*rest, *([own] if more else []), out]
            return pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

        return map_batches(rows, searched, f"{ddl}{f', `{own}` string' if more else ''}, `{out}` {HITS}")

    n, fetch = item_blocks(benchmark)
    for b in range(n):
        before = rows
        rows = one(fetch(b), rows, b > 0, b + 1 < n)
        if b + 1 < n:  # one block at a time on the driver and in the plan
            rows = materialised(rows)
            dropped(before)
    return rows
