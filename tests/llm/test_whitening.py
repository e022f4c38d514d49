import math

import numpy as np
import pytest

from tidewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def usable(vectors):
    return {i: v for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)}


def brute(vectors, k=16):
    """By the covariance matrix and a library's eigenvectors: n, deviations, whitened, explained."""
    rows = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in usable(vectors).items()}
    fit = sorted(set(map(tuple, rows.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = {i: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) for i, x in rows.items()}
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in rows.items()}, {i: x @ u / np.sqrt(e) for i, x in centred.items()}, e / np.trace(v)


def compare(spark, vectors, k=16, **more):
    got = whitening.whiten(table(spark, vectors), k=k, **more).toPandas()
    n, deviations, white, explained = brute(vectors, k)
    ids = sorted(white)
    assert len(got) == len(ids) * k and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = np.array([white[i] for i in ids])
    assert np.abs(wide * np.sign((wide * want).sum(0)) - want).max() < 1e-8
    assert got[got.component == 1].set_index("vec_id").deviation.loc[ids].tolist() == [deviations[i] for i in ids]
    assert np.abs(got.groupby("component").explained.first().to_numpy() - explained).max() < 1e-12
    return got


def test_against_a_dense_solver(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((600, 40)) * 0.3).tolist()
    vectors += vectors[:50] + [vectors[7]] * 400  # repeated vectors count once
    vectors += [None, [], [None] * 40, [float("nan")] * 40, [float("inf"), *[0.0] * 39], [0.5] * 12]
    # one more length: dropped, as it is not the commonest
    got = whitening.whiten(table(spark, vectors)).toPandas()
    assert set(got.vec_id) == set(range(1050))
    compare(spark, vectors[:-1])


@pytest.mark.parametrize(("d", "basis"), [(150, 512), (150, 60)])
def test_flat_spectrum_and_restarts(spark, d, basis):
    r = np.random.default_rng(2)
    vectors = (r.standard_normal((800, d)) * np.linspace(0.6, 0.2, d)).tolist()
    got = compare(spark, vectors, k=4, oversample=4, basis=basis)
    assert got.residual.iloc[0] < 1e-11 and (basis > d or got.passes.iloc[0] > d // 8)


def test_few_vectors_have_few_components(spark):
    one = whitening.whiten(table(spark, [[1.0, 2.0]] * 5))
    assert one.count() == 0
    got = whitening.whiten(table(spark, [[1.0, 2.0, 0.0], [0.0, 2.0, 1.0], [0.0, 2.0, 1.0]])).toPandas()
    assert set(got.component) == {1} and sorted(np.abs(got.whitened.round(9))) == [1.0, 1.0, 1.0] and (got.n == 2).all()
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0


def test_extreme_entries(spark):
    """Entries beyond the bound are held to it, and a deviation beyond 63 bits is null; nothing crashes."""
    vectors = [[3e38, 0.0], [-3e38, 1.0], [0.0, -1e30], [1e20, 1.0], [0.25, 0.5]]
    got = whitening.whiten(table(spark, vectors)).toPandas()
    assert set(got.component) == {1, 2} and len(got) == 10 and np.isfinite(got.whitened).all()
    assert got.deviation.isna().sum() >= 4 and got.identity_error.iloc[0] < 1e-4


def test_names_that_clash(spark):
    df = table(spark, [[1.0, 2.0], [2.0, 1.0], [0.0, 0.5]]).withColumnRenamed("vec_id", "n").withColumnRenamed("label", "x")
    assert whitening.whiten(df, key="n").columns[:3] == ["n_", "component", "n"]
