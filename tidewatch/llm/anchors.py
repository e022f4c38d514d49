"""What both substring operators share: which anchors of a text occur again anywhere.

Every window of `window` symbols chooses one anchor in it, the stretch of `gram` symbols with the least fingerprint. Equal
windows choose alike, so a window that repeats has an anchor that repeats. Only about 2 / (window - gram + 2) of all
positions are anchors, and only their fingerprints are shuffled.

Rows are keyed by (k, rid): doc_id (null: the least long) and the text's fingerprint. Texts equal as a whole are met first,
by digest: they never enter the search but for one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import limits, text_of

KEYED = "doc_id bigint, k bigint, rid bigint, text string"


def row_key(text: str = "text", key: str = "doc_id") -> tuple[Column, Column]:
    """k, rid: a row's doc_id (null: the least long) and its text's fingerprint."""
    return F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)).cast("bigint")), F.xxhash64(text_of(text))


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, k, rid, text: the same columns wherever texts are joined, so Spark shuffles the texts once and reuses that."""
    k, rid = row_key(text, key)
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), k.alias("k"), rid.alias("rid"), text_of(text).alias("text"))


def whole_copies(rows: DataFrame) -> DataFrame:
    """k, rid, first (is it the first of its copies) of every row whose whole text stands in two rows or more."""
    digests = rows.select("k", "rid", F.sha2("text", 256).alias("digest"))
    groups = digests.groupBy("digest").agg(F.min(F.struct("k", "rid")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = digests.join(groups, "digest").select("k", "rid", (F.struct("k", "rid") == F.col("least")).alias("first"))
    return found.dropDuplicates(["k", "rid"])


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary cells that hold counts[i] values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of binary cells and the number in each; null cells hold none."""
    width = np.dtype(dtype).itemsize
    cells = [b"" if x is None else x for x in col.to_pylist()]
    return np.frombuffer(b"".join(cells), dtype), np.fromiter((len(c) // width for c in cells), np.int64, len(cells))


def runs(*columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def anchor_rows(fingerprints: np.ndarray, doc: np.ndarray, k: np.ndarray, rid: np.ndarray) -> pa.RecordBatch:
    """Rows for repeated_anchors() from a batch's anchors (doc: index into k and rid).

    Of an anchor that the batch holds twice or more one row goes to the anchor's place as a witness; the batch's other
    documents with it need no further answer and pass by (kind 1) to places spread by document. So a very frequent anchor
    sends one row per batch to its place.
    """
    order = np.lexsort((doc, fingerprints))
    h, d = fingerprints[order], doc[order]
    head, single = runs(h), runs(h, d)
    group = np.cumsum(head) - 1
    hit = np.bincount(group, minlength=int(group[-1]) + 1 if len(group) else 0)[group] > 1 if len(group) else np.zeros(0, bool)
    h, d, head, hit = h[single], d[single], head[single], hit[single]
    kind = np.where(head, 0, 1).astype(np.int8)
    route = np.where(head, h.view(np.int64), rid[d] ^ k[d])
    return pa.RecordBatch.from_arrays(
        [pa.array(route, pa.int64()), pa.array(kind, pa.int8()), longs(h), pa.array(k[d]), pa.array(rid[d]), pa.array(hit)], names=["route", "kind", "h", "k", "rid", "hit"]
    )


ANCHORS = "route bigint, kind tinyint, h bigint, k bigint, rid bigint, hit boolean"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by route: k, rid, h of those whose anchor another row has, or whose batch had it twice."""
    held = None  # the last key row: it may meet its twin in the next batch
    before = None  # the anchor of the row before it
    names = ["k", "rid", "h"]
    for batch in batches:
        kind, h, k, rid, hit = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "h", "k", "rid", "hit"))
        by = kind == 1
        if by.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[by]), pa.array(rid[by]), pa.array(h[by])], names=names)
        h, k, rid, hit = h[~by], k[~by], rid[~by], hit[~by]
        if held is not None:
            h, k, rid, hit = (np.append(a, b) for a, b in zip(held, (h, k, rid, hit), strict=True))
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        out = hit.astype(bool)
        out[1:] |= same
        out[:-1] |= same
        if before is not None:
            out[0] |= h[0] == before
        held, last = tuple(a[-1:] for a in (h, k, rid, hit)), out[-1]
        before = h[-2] if len(h) > 1 else before
        held[3][:] = last
        out = out[:-1]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[:-1][out]), pa.array(rid[:-1][out]), pa.array(h[:-1][out])], names=names)
    if held is not None and bool(held[3][0]):
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2]), pa.array(held[0])], names=names)


def portions(batch: pa.RecordBatch, limit: int | None, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about limit bytes (one text at least); bounds the arrays made of them."""
    if limit is None or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(runs(sizes // limit)).tolist() + [batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], names=batch.schema.names)


def repeated_anchors(rows: DataFrame, copies: DataFrame, found: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int | None = None) -> DataFrame:
    """k, rid, hs (fingerprints of the anchors of that row that occur again); found: batch of rows -> anchor_rows()."""
    limits(rows.sparkSession)
    sources = rows.join(copies.filter(~F.col("first")).select("k", "rid"), ["k", "rid"], "left_anti").select("doc_id", "k", "rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(found, portions(batch, limit))

    hits = sources.mapInArrow(run, ANCHORS).repartition("route").sortWithinPartitions("route").mapInArrow(_repeated, "k bigint, rid bigint, h bigint")
    return hits.groupBy("k", "rid").agg(F.collect_list("h").alias("hs"))
