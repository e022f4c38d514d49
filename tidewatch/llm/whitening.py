"""Embedding whitening by matrix-free block subspace iteration: no pass forms the covariance matrix.

Entries become integers, x = floor(64 c) + 1,000,000. The fit list holds each distinct x vector once; its count n and sums S
are exact. A pass over it computes X'(XQ) of the centred rows X for a block Q of as many columns as asked for and OVERSAMPLE
more: each task adds up its batches, tasks are added up in groups of about the root of their number, and the driver adds the
groups. The driver then orthogonalises the block's image against all earlier ones (QR, twice), and solves the Rayleigh-Ritz
problem of the whole subspace, so that each pass uses what earlier ones have learned and a spectrum without gaps costs a few
passes, not hundreds. The next block is what orthogonalisation has left. The subspace is held to BASIS columns: when it is
full it restarts from its best Ritz vectors. Iteration ends when the residuals |Vq - eq| of all components are below
TOLERANCE times the largest eigenvalue; a last pass applies V to the components themselves, so that fresh residuals
certify them, and adds up the covariance of the whitened fit list by merging centred batches. If it does not certify them,
iteration goes on.

Memory: a task holds a batch and two matrices of dimension x block; the driver holds dimension x BASIS numbers. Shuffled are
the vectors once, to find the distinct ones (equal vectors meet map-side first, so a vector that a third of all rows share
sends a row a task). The fit list is written to the shared folder; each pass rereads it and survives lost executors.

Defined results: rows whose vector is null, empty, holds a null or an entry that is not finite are dropped, and so are rows
whose vector is not of the commonest length (the longer of two that are as common); a null key is kept; repeated rows each
get their rows; an empty table gives no rows; a component whose eigenvalue is nothing but rounding (one distinct vector,
fewer vectors than components) is not returned, as nothing can be divided by it; equal eigenvalues get some orthonormal basis
of their space; a deviation beyond 63 bits is null, and 64 c is held to
+-LARGEST. A key that bears the name of a made column gets _ appended.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import arrow_schema, dropped, limits, materialised, private, release

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVERSAMPLE = 16, 8
#: Columns of the subspace at most, before it restarts from its best Ritz vectors.
BASIS = 512
#: Residuals, as a share of the largest eigenvalue; eigenvalues below the second share are rounding.
TOLERANCE, NOTHING = 1e-12, 1e-12
PASSES = 500
#: Entries are held to this size, so that sums of 2^22 rows of a batch stay within 63 bits.
LARGEST = 1 << 40
#: Integers up to here are doubles without rounding.
EXACT = 1 << 53


def whole(vector: Column) -> Column:
    """x of each entry: an array of longs."""
    held = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("bigint") + SHIFT)


def finite(vector: Column) -> Column:
    """Whether the vector has entries and all of them are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _passed(fit: DataFrame, d: int, start: Callable[[], list[np.ndarray]], step: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]],
            merge: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """One pass over the fit list: each task folds its batches with step, tasks merge in groups, the driver merges the groups."""
    spark = fit.sparkSession
    limits(spark)

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))], ["parts"])

    like = start()

    def unpacked(cells: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(c, p.dtype).reshape(p.shape).copy() for c, p in zip(cells, like, strict=True)]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, any_ = start(), False
        for batch in batches:
            if batch.num_rows:
                parts, any_ = step(parts, _matrix(batch.column(0), d)), True
        if any_:
            yield packed(parts)
        release()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = None
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                parts = unpacked(cells) if parts is None else merge(parts, unpacked(cells))
        if parts is not None:
            yield packed(parts)

    rows = fit.mapInArrow(folded, "parts array<binary>")
    groups = math.isqrt(max(1, fit.rdd.getNumPartitions()))
    if groups > 4:
        rows = rows.repartition(groups).mapInArrow(merged, "parts array<binary>")
    out = like
    for row in rows.toLocalIterator():  # a row a group
        out = merge(out, unpacked([bytes(c) for c in row.parts]))
    return out


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


@dataclass
class Fit:
    """n and S of the fit list, eigenvalues and components (columns) in falling order, and what certifies them."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int], list[int], list[int]]:
    """n, S and the bounds of each dimension, exact: sums are kept as two halves of 32 bits each."""
    top = np.iinfo(np.int64)
    start = lambda: [np.zeros(1, np.int64), np.zeros(d, np.int64), np.zeros(d, np.int64), np.full(d, top.max), np.full(d, top.min)]

    def step(p: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        return [p[0] + len(x), p[1] + (x >> 32).sum(0), p[2] + (x & 0xFFFFFFFF).sum(0), np.minimum(p[3], x.min(0)), np.maximum(p[4], x.max(0))]

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [*_added(a[:3], b[:3]), np.minimum(a[3], b[3]), np.maximum(a[4], b[4])]

    n, high, low, least, most = _passed(fit, d, start, step, merge)
    return int(n[0]), [(int(h) << 32) + int(x) for h, x in zip(high, low, strict=True)], least.tolist(), most.tolist()


def centred(x: np.ndarray, n: int, sums: list[int], reach: int) -> np.ndarray:
    """x - S/n: the difference n x - S is taken in integers before it is rounded once."""
    if n * reach < 2 * EXACT:
        quotient = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        return ((x - quotient) * n - rest) / float(n)
    return (x.astype(object) * n - np.array(sums, object)).astype(np.float64) / float(n)


def _applied(fit: DataFrame, q: np.ndarray, n: int, sums: list[int], reach: int) -> tuple[np.ndarray, float]:
    """Vq and the trace of V."""
    d, b = q.shape

    def step(p: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        c = centred(x, n, sums, reach)
        return [p[0] + c.T @ (c @ q), p[1] + np.square(c).sum()]

    image, trace = _passed(fit, d, lambda: [np.zeros((d, b)), np.zeros(1)], step, _added)
    return image / n, float(trace[0]) / n


def _certified(fit: DataFrame, u: np.ndarray, values: np.ndarray, n: int, sums: list[int], reach: int) -> tuple[np.ndarray, float]:
    """Vu, and the largest entry of the whitened covariance less the identity; centred batches merge by their means."""
    d, k = u.shape
    scale = 1 / np.sqrt(values)

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        (image, m, mean, spread), (image_b, m_b, mean_b, spread_b) = a, b
        both = m + m_b
        if not both[0]:
            return a
        gap = mean_b - mean
        return [image + image_b, both, mean + gap * (m_b / both), spread + spread_b + np.outer(gap, gap) * (m * m_b / both)]

    def step(p: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        c = centred(x, n, sums, reach)
        projected = c @ u
        w = projected * scale
        mean = w.mean(0)
        return merge(p, [c.T @ projected, np.array([float(len(x))]), mean, (w - mean).T @ (w - mean)])

    image, _, _, spread = _passed(fit, d, lambda: [np.zeros((d, k)), np.zeros(1), np.zeros(k), np.zeros((k, k))], step, merge)
    return image / n, float(np.abs(spread / n - np.eye(k)).max())


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis; columns that add nothing but rounding are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
        if not block.shape[1]:
            return block
    return block


def fitted(fit: DataFrame, d: int, k: int = COMPONENTS, oversample: int = OVERSAMPLE, basis: int = BASIS, tolerance: float = TOLERANCE) -> Fit:
    """The components of the table's only column, an array of longs with d entries each."""
    n, sums, low, high = _totals(fit, d)
    reach = max((b - a for a, b in zip(low, high, strict=True)), default=0) + 1
    width, limit = min(d, k + oversample), min(d, max(basis, 3 * (k + oversample)))
    rng = np.random.default_rng(n)
    held = images = np.zeros((d, 0))
    block, trace, passes = _orthonormal(rng.standard_normal((d, width)), held), 0.0, 1
    values, vectors, residual = np.zeros(0), held, 0.0
    while passes < PASSES:
        image, trace = _applied(fit, block, n, sums, reach)
        passes += 1
        held, images = np.hstack([held, block]), np.hstack([images, image])
        small = held.T @ images
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        kept = int((e[:k] > NOTHING * max(trace, 0.0)).sum()) if trace > 0 else 0
        values, vectors = e[:kept], held @ y[:, :kept]
        if not kept:
            return Fit(n, sums, low, high, values, vectors, trace, 0.0, 0.0, passes)
        open_ = np.linalg.norm(images @ y[:, :kept] - vectors * values, axis=0)
        following = _orthonormal(image, held) if held.shape[1] < d else held[:, :0]
        if open_.max() <= tolerance * values[0] or not following.shape[1]:
            fresh, identity_error = _certified(fit, vectors, values, n, sums, reach)
            passes += 1
            residual = float(np.linalg.norm(fresh - vectors * values, axis=0).max() / values[0])
            if residual <= 10 * tolerance or not following.shape[1]:
                return Fit(n, sums, low, high, values, vectors, trace, residual, identity_error, passes)
        block = following
        if held.shape[1] + block.shape[1] > limit and limit < d:
            best = min(2 * width, held.shape[1])
            held, images = held @ y[:, :best], images @ y[:, :best]
            block = _orthonormal(block, held)
    raise RuntimeError(f"residual {residual:.2g} after {passes} passes")


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = COMPONENTS, oversample: int = OVERSAMPLE, basis: int = BASIS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error, residual, passes: a row per vector and component."""
    made = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double, passes int"
    own, x = private(table.sparkSession.createDataFrame([], made), key, "x")
    usable = table.select(F.col(f"`{key}`").alias(own), F.col(f"`{vector}`").alias(x)).filter(finite(F.col(x)))
    schema = f"`{own}` {usable.schema[own].dataType.simpleString()}, {made}"
    commonest = usable.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    if not commonest:
        return table.sparkSession.createDataFrame([], schema)
    d = commonest[0].d
    rows = usable.filter(F.size(x) == d).select(own, whole(F.col(x)).alias(x))
    fit = materialised(rows.select(x).distinct())
    f = fitted(fit, d, k, oversample, basis)
    dropped(fit)
    return rows.mapInArrow(projector(f, d, schema), schema)


def projector(f: Fit, d: int, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector's row for each component; a batch goes out in parts, as its rows are multiplied."""
    target = arrow_schema(schema)
    reach = max((b - a for a, b in zip(f.low, f.high, strict=True)), default=0) + 1
    k = len(f.values)
    explained, scale = f.values / f.trace if k else f.values, 1 / np.sqrt(f.values)

    def deviation(x: np.ndarray) -> list[int | None]:
        if d * (f.n * reach) ** 2 < 1 << 63:
            quotient, rest = np.array([s // f.n for s in f.sums], np.int64), np.array([s % f.n for s in f.sums], np.int64)
            return np.square((x - quotient) * f.n - rest).sum(1)
        exact = np.square(x.astype(object) * f.n - np.array(f.sums, object)).sum(1)
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1), d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            whitened = (centred(x, f.n, f.sums, reach) @ f.components) * scale
            one = lambda value, kind: pa.array(np.full(m * k, value), kind)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), one(f.n, pa.int64()),
                pa.array(deviation(x), pa.int64()).take(pa.array(each)), pa.array(whitened.ravel()), pa.array(np.tile(explained, m)),
                one(f.identity_error, pa.float64()), one(f.residual, pa.float64()), one(f.passes, pa.int32()),
            ], schema=target)
        release()

    return run
