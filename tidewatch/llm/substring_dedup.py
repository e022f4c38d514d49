"""Substring dedup by relative Lempel-Ziv parsing over words.

The corpus itself is the reference, cut into blocks: a block holds every window of WINDOW words that chose one anchor
(see anchors.py), wherever it stands, and blocks lie spread over the cluster. Every document is factored against every
block that can hold one of its windows: in text order, the document's windows of a block are looked up among the earlier
ones of that block, and a factor is the longest run of consecutive windows that all stand earlier. Each window belongs to
exactly one block, so windows across a factor's border are looked up too, by the neighbouring block; factors of at least
WINDOW words are the duplicate spans, and a document's spans from all blocks are joined before its words are removed.
Windows are compared within their anchor's block by 128 bits made of their words' digests (see rolling.word_symbols).

Earlier means: smaller doc_id, or the same document and an earlier start. Of texts equal as a whole only the first takes
part; in the others every word goes if there are WINDOW of them.

Scale: texts are shuffled once; per anchor one fingerprint, and for repeated anchors the windows' fingerprints. Within a
batch only the first of equal windows goes on (the others are answered at once), so a passage that a third of all rows
share sends a few rows per batch. A block is read as a sorted stream and only its distinct fingerprints are held.

Defined results: a null text has no words; a null doc_id comes before all others; rows that share doc_id and text are one
and the same place (neither is earlier), rows that share only doc_id are told apart by their text and at equal starts
neither is earlier; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.anchors import anchor_rows, keyed, longs, packed, portions, repeated_anchors, runs, unpacked, whole_copies
from tidewatch.llm.base import limits
from tidewatch.llm.rolling import BASES, Fingerprints, flat_texts, sliding_argmin, word_bounds, word_symbols

WINDOW, GRAM = 20, 8
#: Bytes of text worked on at once.
PORTION = 2 << 20


class Words:
    """A batch's words, anchors and windows."""

    def __init__(self, texts: list[str], window: int, gram: int):
        raw, offsets = flat_texts(texts)
        self.begin, self.end = word_bounds(raw)
        self.raw = raw
        self.symbols = word_symbols(raw)
        self.first = np.searchsorted(self.begin, offsets)  # of each document, one more at the end
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.grams = Fingerprints(self.symbols[1], BASES[1]).all(gram)
        chosen = sliding_argmin(self.grams, window - gram + 1)
        whole = self.doc[: len(chosen)] == self.doc[window - 1 : window - 1 + len(chosen)]
        self.starts = np.flatnonzero(whole)
        self.anchor = chosen[self.starts]

    def windows(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of each window, one from either half of its words' digests."""
        return Fingerprints(self.symbols[0], BASES[0]).of(starts, window), Fingerprints(self.symbols[1], BASES[1]).of(starts, window)


def joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Both halves as one sortable value of 16 bytes."""
    return np.stack([one, two], 1).view("S16").ravel()


def _found(window: int, gram: int):
    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column("text").to_pylist(), window, gram)
        at = w.anchor[runs(w.anchor)]
        return anchor_rows(w.grams[at], w.doc[at], batch.column("k").to_numpy(), batch.column("rid").to_numpy())

    return found


def _ranges(rows: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (of rows, ascending starts) as maximal runs of consecutive starts: row, and word ranges [from, to) in pairs."""
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(head)
    ends = np.append(at[1:], len(rows)) - 1
    return rows[at], starts[at], starts[ends] + window


BLOCKS = "route bigint, kind tinyint, k bigint, rid bigint, lo int, at binary, fp binary"


def _factored(window: int, gram: int):
    """Rows of the blocks, and ranges that the batch already answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, PORTION)):
            k, rid = batch.column("k").to_numpy(), batch.column("rid").to_numpy()
            hs = np.unique(batch.column("hs").flatten().to_numpy()).view(np.uint64)
            w = Words(batch.column("text").to_pylist(), window, gram)
            hs = np.sort(hs)
            own = w.grams[w.anchor]
            sel = hs[np.minimum(np.searchsorted(hs, own), len(hs) - 1)] == own if len(hs) else np.zeros(len(own), bool)
            s, a, h = w.starts[sel], w.anchor[sel], own[sel]
            if not len(s):
                continue
            one, two = w.windows(s, window)
            doc = w.doc[s]
            rel = (s - w.first[doc]).astype(np.int32)
            dk = k[doc]
            order = np.lexsort((rel, dk, two, one, h))
            head = runs(h[order], one[order], two[order])
            lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(s), bool)
            later[order] = (dk[order] != dk[lead]) | (rel[order] != rel[lead])
            if later.any():
                d, lo, hi = _ranges(doc[later], rel[later], window)
                at = np.flatnonzero(runs(d))
                counts = 2 * np.diff(np.append(at, len(d)))
                d = d[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[d] ^ k[d]), pa.array(np.ones(len(d), np.int8)), pa.array(k[d]), pa.array(rid[d]), pa.array(np.zeros(len(d), np.int32)),
                     packed(np.stack([lo, hi], 1).astype(np.int32).ravel(), counts), packed(np.zeros(0, np.uint64), np.zeros(len(d), np.int64))],
                    names=["route", "kind", "k", "rid", "lo", "at", "fp"],
                )
            go = ~later
            a, h, doc, rel, fp = a[go], h[go], doc[go], rel[go], joined(one[go], two[go])
            at = np.flatnonzero(runs(a, doc))
            counts = np.diff(np.append(at, len(a)))
            d = doc[at]
            yield pa.RecordBatch.from_arrays(
                [longs(h[at]), pa.array(np.zeros(len(at), np.int8)), pa.array(k[d]), pa.array(rid[d]), pa.array(rel[at]), packed(rel, counts), packed(fp, counts)],
                names=["route", "kind", "k", "rid", "lo", "at", "fp"],
            )

    return run


FACTORS = "k bigint, rid bigint, ranges binary"


def _looked_up(window: int):
    """From blocks sorted by (route, k, lo): the factors, as word ranges of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, seen_k, seen_at = None, np.zeros(0, "S16"), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            by = kind == 1
            if by.any():
                yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(by)) for n in ("k", "rid", "at")], names=["k", "rid", "ranges"])
            if by.all():
                continue
            batch = batch.filter(pa.array(~by))
            route, k, rid = (batch.column(n).to_numpy() for n in ("route", "k", "rid"))
            rel, counts = unpacked(batch.column("at"), np.int32)
            fp, _ = unpacked(batch.column("fp"), np.dtype("S16"))
            one, two = fp.view(np.uint64).reshape(-1, 2).T
            row = np.repeat(np.arange(len(k)), counts)
            h, dk = route[row], k[row]
            order = np.lexsort((np.arange(len(h)), two, one, h))
            head = runs(h[order], one[order], two[order])
            lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(h), bool)
            later[order] = (dk[order] != dk[lead]) | (rel[order] != rel[lead])
            mine = np.flatnonzero(h == block) if block is not None else np.zeros(0, np.int64)
            if len(mine) and len(seen):
                at = np.minimum(np.searchsorted(seen, fp[mine]), len(seen) - 1)
                later[mine] |= (seen[at] == fp[mine]) & ((seen_k[at] != dk[mine]) | (seen_at[at] != rel[mine]))
            last = np.flatnonzero(h == h[-1])
            fresh, first = np.unique(fp[last], return_index=True)
            fk, fa = dk[last][first], rel[last][first]
            if h[-1] == block:
                new = ~np.isin(fresh, seen)
                seen, seen_k, seen_at = np.append(seen, fresh[new]), np.append(seen_k, fk[new]), np.append(seen_at, fa[new])
                o = np.argsort(seen)
                seen, seen_k, seen_at = seen[o], seen_k[o], seen_at[o]
            else:
                block, seen, seen_k, seen_at = h[-1], fresh, fk, fa
            if later.any():
                r, lo, hi = _ranges(row[later], rel[later], window)
                at = np.flatnonzero(runs(r))
                counts = 2 * np.diff(np.append(at, len(r)))
                r = r[at]
                yield pa.RecordBatch.from_arrays([pa.array(k[r]), pa.array(rid[r]), packed(np.stack([lo, hi], 1).astype(np.int32).ravel(), counts)], names=["k", "rid", "ranges"])

    return run


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = flat_texts(batch.column("text").to_pylist())
            begin, end = word_bounds(raw)
            first = np.searchsorted(begin, offsets)
            ranges, copy = batch.column("ranges").to_pylist(), batch.column("later_copy").to_pylist()
            data = raw.tobytes()
            n_words, n_removed, kept, spans = [], [], [], []
            for i in range(batch.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                n = b - a
                own = np.frombuffer(b"".join(ranges[i] or ()), np.int32).reshape(-1, 2)
                if copy[i] and n >= window:
                    own = np.array([[0, n]], np.int32)
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, own[:, 0], 1)
                np.add.at(cover, own[:, 1], -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                keep = np.flatnonzero(~gone) + a
                n_words.append(n)
                n_removed.append(n - len(keep))
                kept.append(b" ".join([data[x:y] for x, y in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
                spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, _SPAN)],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and spans (removed runs of words) of every row."""
    limits(docs.sparkSession)
    rows = keyed(docs, text, key)
    copies = whole_copies(rows)
    hits = repeated_anchors(rows, copies, _found(window, gram), PORTION)
    blocks = rows.join(hits, ["k", "rid"]).select("doc_id", "k", "rid", "text", "hs").mapInArrow(_factored(window, gram), BLOCKS)
    factors = blocks.repartition("route").sortWithinPartitions("route", "k", "lo").mapInArrow(_looked_up(window), FACTORS)
    ranges = factors.groupBy("k", "rid").agg(F.collect_list("ranges").alias("ranges"))
    later = copies.select("k", "rid", (~F.col("first")).alias("later_copy"))
    joined = rows.join(ranges, ["k", "rid"], "left").join(later, ["k", "rid"], "left")
    return joined.select("doc_id", "text", "ranges", "later_copy").mapInArrow(_removed(window), RESULT)
