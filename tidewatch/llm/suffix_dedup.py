"""Suffix-array dedup over bytes: strings of WINDOW bytes that start at two places anywhere are removed at both.

A sparse suffix array: of every text only the suffixes at repeated anchors are sorted (see anchors.py: each string of
REPORT bytes has one anchor, equal strings the same). Splitters sampled from the texts range-partition the suffixes by
their leading bytes into buckets. A bucket is sorted by multikey quicksort, eight bytes at a time, all groups of one depth
together: a group whose suffixes still agree is split by its next eight bytes, suffixes that stand alone leave. This gives
order and common-prefix lengths; the same sort over the reversed left contexts gives the common lengths to the left. A
string that begins l bytes left of its anchor repeats if another suffix agrees on its length - l bytes to the right and on
l bytes to the left; this is decided for each l from the two orders by equal classes, never by pairs of suffixes. Splitters
are not longer than an anchor, so equal anchors never part: at a bucket's border the neighbours' common prefix is shorter
than an anchor, and no string can repeat across it.

The same orders answer a second, shorter length: passages of REPORT bytes or more that repeat are counted (n_shared,
longest_shared) but stay. REPORT is what fifty short words take up, so a passage of more than fifty words that repeats is
seen even where it is shorter than WINDOW.

Texts equal as a whole are met first by digest, and suffixes whose whole context is equal within a batch send one witness.
The sample of splitters is bounded (SAMPLE pieces of 32 bytes), so there are at most 2 x SAMPLE buckets, whatever the corpus. A
bucket is read in the order of its leading bytes and sorted in parts of about HELD bytes, cut where these change, so a task's
memory does not grow with its bucket; only suffixes that have their first 32 bytes in common are held together.

Defined results: a null text is empty; a null doc_id is kept; a text that stands in several rows counts once per row (also
if the rows share doc_id); invalid UTF-8 cannot occur in a string column, and what is kept is returned as binary, as
removal may cut a character; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.anchors import anchor_rows, keyed, portions, repeated_anchors, runs, whole_copies
from tidewatch.llm.base import limits
from tidewatch.llm.rolling import BASES, Fingerprints, flat_texts, sliding_argmin

WINDOW, REPORT, GRAM = 400, 150, 32
SAMPLE, LEADING = 8192, 32
#: Bytes of text worked on at once: each takes some 80 bytes of arrays.
PORTION = 1 << 20
#: Bytes of contexts that are sorted at once; more only where they have their leading bytes in common.
HELD = 8 << 20


class Bytes:
    """A batch's bytes, anchors and windows."""

    def __init__(self, texts: list[str], window: int, gram: int):
        self.raw, self.offsets = flat_texts(texts)
        size = np.diff(self.offsets) - 1
        self.symbols = self.raw.astype(np.uint64) + np.uint64(1)
        self.grams = Fingerprints(self.symbols, BASES[1]).all(gram)
        chosen = sliding_argmin(self.grams, window - gram + 1)
        windows = np.maximum(size - window + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), windows)
        self.starts = np.repeat(self.offsets[:-1], windows) + np.arange(len(self.doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.anchor = chosen[self.starts]


def _found(window: int, gram: int):
    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Bytes(batch.column("text").to_pylist(), window, gram)
        head = runs(w.anchor, w.doc)
        at = w.anchor[head]
        return anchor_rows(w.grams[at], w.doc[head], batch.column("k").to_numpy(), batch.column("rid").to_numpy())

    return found


SUFFIXES = "route bigint, kind tinyint, k bigint, rid bigint, pos int, near int, far int, whole int, known boolean, context binary"
NAMES = ["route", "kind", "k", "rid", "pos", "near", "far", "whole", "known", "context"]


def _equal_contexts(cells: list[bytes], near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context whether the batch holds it twice or more, and whether it is the first of its kind."""
    first: dict[tuple[bytes, int, int], int] = {}
    lead = np.fromiter((first.setdefault(key, i) for i, key in enumerate(zip(cells, near.tolist(), far.tolist(), strict=True))), np.int64, len(cells))
    return np.bincount(lead, minlength=len(cells))[lead] > 1, lead == np.arange(len(cells))


def _suffixes(window: int, report: int, gram: int, splitters: np.ndarray):
    """Suffixes at repeated anchors, with what their strings reach to the left and right.

    near, far: least and greatest distance from a string's start to the anchor; whole: the least one of a string of window
    bytes that ends within its text (far + 1: none). Kind 1: ranges of bytes that the batch already answers, [near, far)
    that repeat and [near, whole) to be removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, PORTION)):
            k, rid = batch.column("k").to_numpy(), batch.column("rid").to_numpy()
            hs = np.unique(batch.column("hs").flatten().to_numpy().view(np.uint64))
            w = Bytes(batch.column("text").to_pylist(), report, gram)
            head = np.flatnonzero(runs(w.anchor, w.doc))
            tail = np.append(head[1:], len(w.anchor)) - 1
            own = w.grams[w.anchor[head]]
            if not len(hs) or not len(own):
                continue
            sel = hs[np.minimum(np.searchsorted(hs, own), len(hs) - 1)] == own
            head, tail = head[sel], tail[sel]
            if not len(head):
                continue
            pos, doc = w.anchor[head], w.doc[head]
            far, near = pos - w.starts[head], pos - w.starts[tail]
            left_over = w.offsets[doc + 1] - 1 - pos
            whole = np.minimum(np.maximum(near, window - left_over), far + 1)
            left, size = pos - far, far + np.minimum(left_over, window - near)
            data = w.raw.tobytes()
            cells = [data[x : x + y] for x, y in zip(left.tolist(), size.tolist(), strict=True)]
            known, lead = _equal_contexts(cells, near, far)
            rel = pos - w.offsets[doc]
            for kind, rows in ((1, np.flatnonzero(known)), (0, np.flatnonzero(lead))):
                if not len(rows):
                    continue
                d = doc[rows]
                if kind:
                    begin = rel[rows] - far[rows]
                    route, a, b, sent = rid[d] ^ k[d], begin, rel[rows] - near[rows] + report, [b""] * len(rows)
                    c = np.where(whole[rows] <= far[rows], rel[rows] - whole[rows] + window, begin)
                else:
                    leading = w.raw[np.minimum(pos[rows][:, None] + np.arange(splitters.itemsize), len(w.raw) - 1)]
                    route = np.searchsorted(splitters, np.ascontiguousarray(leading).view(splitters.dtype).ravel(), "right")
                    a, b, c, sent = near[rows], far[rows], whole[rows], [cells[i] for i in rows.tolist()]
                ints = [pa.array(x.astype(np.int32)) for x in (rel[rows], a, b, c)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route.astype(np.int64)), pa.array(np.full(len(rows), kind, np.int8)), pa.array(k[d]), pa.array(rid[d]), *ints, pa.array(known[rows]), pa.array(sent, pa.binary())],
                    names=NAMES,
                )

    return run


def multikey_quicksort(flat: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of depth bytes at starts, and each one's common prefix with the one before it.

    flat must reach 8 bytes beyond every string's end. Vectorised: at each depth all groups that still agree are ordered by
    their next eight bytes and split; single strings leave.
    """
    n = len(starts)
    order, common = np.arange(n), np.zeros(n, np.int32)
    active, group = np.arange(n), np.zeros(n, np.int64)
    bounds = [np.uint64(1 << (8 * i)) for i in range(1, 8)]
    done = 0
    while len(active) and done < depth:
        at = order[active]
        key = np.ascontiguousarray(flat[(starts[at] + done)[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
        same = group[1:] == group[:-1]
        if (same & (key[1:] != key[:-1])).any():
            o = np.lexsort((key, group))
            order[active] = at[o]
            key = key[o]
        split = key[1:] != key[:-1]
        here = np.flatnonzero(same & split)
        x = key[here + 1] ^ key[here]
        common[active[here + 1]] = done + sum((x < b).astype(np.int32) for b in bounds)
        head = np.append(True, ~same | split)
        gid = np.cumsum(head) - 1
        alone = np.bincount(gid)[gid] == 1
        stay = ~alone
        active, group = active[stay], gid[stay]
        done += 8
    if len(active):  # still agreeing with the one before, but for each group's first, which keeps the split that made the group
        common[active[1:][group[1:] == group[:-1]]] = depth
    return order, common


def _either(common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The greater common length of each string with its neighbours in the order."""
    out = np.empty(len(order), common.dtype)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def repeated_strings(contexts: list[bytes], near: np.ndarray, far: np.ndarray, whole: np.ndarray, lengths: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each suffix (context: far bytes, then the anchor's suffix) the least and greatest l whose string another suffix has
    too, -1 where there is none; for strings of lengths[0] bytes (l from near) and of lengths[1] (l from whole)."""
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    anchor = np.cumsum(sizes) - sizes + far
    pad = np.zeros(max(lengths) + 16, np.uint8)
    forward, backward = np.append(flat, pad), np.append(flat[::-1], pad)
    r_order, r_common = multikey_quicksort(forward, anchor, max(lengths))
    l_order, l_common = multikey_quicksort(backward, len(flat) - anchor, int(far.max()) if n else 0)
    reach = _either(r_common, r_order) + _either(l_common, l_order)  # no string of a suffix's that repeats is longer
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    out = []
    for length, first in zip(lengths, (near, whole), strict=True):
        least, most = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        out.append((least, most))
        live = np.flatnonzero((reach >= length) & (first <= far))
        if len(live) < 2:
            continue
        for l in range(int(first[live].min()), int(far[live].max()) + 1):  # noqa: E741
            who = live[(first[live] <= l) & (l <= far[live])]
            if len(who) < 2:
                continue
            right[r_order] = np.cumsum(r_common < length - l)
            left[l_order] = np.cumsum(l_common < l) if l else 0
            key = right[who] * (n + 1) + left[who]
            o = np.argsort(key)
            s = key[o]
            twin = np.zeros(len(s), bool)
            twin[1:] = s[1:] == s[:-1]
            twin[:-1] |= twin[1:]
            hit = who[o[twin]]
            most[hit] = l
            least[hit[least[hit] < 0]] = l
    return out


RANGES = "k bigint, rid bigint, lo int, hi int, cut int"


def _sorted(window: int, report: int, leading: int, most_held: int):
    """From suffixes sorted by bucket and leading bytes: byte ranges [lo, hi) that repeat elsewhere. cut 1: as strings of window bytes, 0: of report bytes."""
    names = ["k", "rid", "lo", "hi", "cut"]

    def rows(k: np.ndarray, rid: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """parts: for either length which rows, and their ranges."""
        at = [np.flatnonzero(x[0]) for x in parts]
        which = np.concatenate(at)
        lo, hi = (np.concatenate([x[c][i] for x, i in zip(parts, at, strict=True)]).astype(np.int32) for c in (1, 2))
        cut = np.repeat(np.arange(2, dtype=np.int32), [len(i) for i in at])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[which], rid[which], lo, hi, cut)], names=names)

    def bucket(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        near, far, whole, pos = (t.column(n).to_numpy().astype(np.int64) for n in ("near", "far", "whole", "pos"))
        fresh = ~t.column("known").to_numpy()
        found = repeated_strings(t.column("context").to_pylist(), near, far, whole, (report, window))
        parts = [((most >= 0) & fresh, pos - most, pos - least + size) for (least, most), size in zip(found, (report, window), strict=True)]
        return rows(t.column("k").to_numpy(), t.column("rid").to_numpy(), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, last, size_held = None, None, 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == 1).any():
                p = batch.filter(pa.array(kind == 1))
                k, rid, lo, hi, cut = (p.column(n).to_numpy() for n in ("k", "rid", "near", "far", "whole"))
                yield rows(k, rid, [(hi > lo, lo, hi), (cut > lo, lo, cut)])
            batch = batch.filter(pa.array(kind == 0))
            if not batch.num_rows:
                continue
            route = batch.column("route").to_numpy()
            far = batch.column("far").to_numpy().tolist()
            lead = [c[f : f + leading] for c, f in zip(batch.column("context").to_pylist(), far, strict=True)]
            sizes = np.append(0, np.cumsum(np.fromiter(map(len, batch.column("context").to_pylist()), np.int64, batch.num_rows)))
            at = 0  # where what is not held yet begins
            for i in range(len(lead)):
                new = route[i] != now
                # a bucket may be cut wherever the leading bytes change: equal strings have equal anchors
                if new or (lead[i] != last and size_held + sizes[i] - sizes[at] >= most_held):
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    if held:
                        yield bucket(held)
                    held, size_held, at = [], 0, i
                now, last = route[i], lead[i]
            held.append(batch.slice(at, len(lead) - at))
            size_held += int(sizes[-1] - sizes[at])
        if held:
            yield bucket(held)

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_shared bigint, longest_shared bigint"


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: ranges that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _removed(window: int, report: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[tuple[int, int, int, int, int]] = []
            kept = []
            for text, ranges, copy in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), batch.column("copied").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n = len(raw)
                if copy:
                    shared, spans = ([(0, n)] if n >= size else [] for size in (report, window))
                else:
                    shared, spans = (united([(r["lo"], r["hi"]) for r in ranges or () if r["cut"] == cut]) for cut in (0, 1))
                edges = [0, *(x for span in spans for x in span), n]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                lengths = [b - a for a, b in shared]
                numbers.append((n, n - len(kept[-1]), len(spans), sum(lengths), max(lengths, default=0)))
            n, removed, count, shared_bytes, longest = (pa.array(x, pa.int64()) for x in zip(*numbers, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n, removed, count, pa.array(kept, pa.binary()), shared_bytes, longest],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared", "longest_shared"],
            )

    return run


def sampled_splitters(rows: DataFrame, buckets: int, leading: int = LEADING) -> np.ndarray:
    """At most buckets - 1 splitters, quantiles of short pieces (leading bytes) at one random place of about SAMPLE rows."""
    n = rows.count()
    piece = F.expr(f"substring(encode(text, 'UTF-8'), 1 + cast(rand(7) * octet_length(text) as int), {leading})")
    taken = rows.sample(min(1.0, SAMPLE / max(n, 1)), 11).select(piece.alias("piece")).limit(2 * SAMPLE).collect()
    pieces = np.sort(np.array([bytes(r.piece or b"") for r in taken], f"S{leading}"))
    if not len(pieces):
        return pieces
    return np.unique(pieces[(np.arange(1, buckets) * len(pieces) // buckets)])


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", key: str = "doc_id", report: int = REPORT, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes left) of every row; n_shared (bytes in strings
    of report bytes that also start elsewhere) and longest_shared (the longest run of them)."""
    limits(docs.sparkSession)
    report = min(report, window)
    rows = keyed(docs, text, key)
    copies = whole_copies(rows)
    leading = min(LEADING, gram)
    splitters = sampled_splitters(rows, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), leading)
    hits = repeated_anchors(rows, copies, _found(report, gram), PORTION)
    suffixes = rows.join(hits, ["k", "rid"]).select("doc_id", "k", "rid", "text", "hs").mapInArrow(_suffixes(window, report, gram, splitters), SUFFIXES)
    lead = F.expr(f"substring(context, far + 1, {leading})")
    ranges = suffixes.repartition("route").sortWithinPartitions("route", lead).mapInArrow(_sorted(window, report, leading, held), RANGES)
    ranges = ranges.groupBy("k", "rid").agg(F.collect_list(F.struct("lo", "hi", "cut")).alias("ranges"))
    joined = rows.join(ranges, ["k", "rid"], "left").join(copies.select("k", "rid", F.lit(True).alias("copied")), ["k", "rid"], "left")
    return joined.select("doc_id", "text", "ranges", "copied").mapInArrow(_removed(window, report), RESULT)
