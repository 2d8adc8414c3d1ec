"""Embedding whitening against a dense eigendecomposition and exact whole numbers."""

import numpy as np
import pytest
from pyspark.sql import types as T

from cargolens.llm import whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("component", T.StringType()), T.StructField("n", T.StringType()), T.StructField("id", T.StringType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in vectors], SCHEMA).repartition(3)


def by_hand(vectors, dim):
    """(whole x, centred rows, eigenvalues, eigenvectors) of the vectors that take part."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] + [100_000] * (dim - len(v)) for v in vectors])
    y = (len(x) * x - x.sum(0)) / len(x)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    return x, y, e[::-1], u[:, ::-1]


def compare(rows, ids, x, y, e, u, count):
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(found) == len(ids) * count
    far = len(x) * x - x.sum(0)
    for c in range(1, count + 1):
        got = np.array([found[i, c]["whitened"] for i in ids])
        want = y @ u[:, c - 1] / np.sqrt(e[c - 1])
        assert np.abs(got - np.sign(got @ want) * want).max() < 1e-8
        r = found[ids[0], c]
        assert r["n"] == len(x) and abs(r["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
        assert [found[i, c]["deviation"] for i in ids] == [int((row * row).sum()) for row in far]


def random_vectors(rows, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [np.float32(v).tolist() for v in rng.standard_normal((rows, dim)) * np.linspace(3, 0.5, dim)]


def test_components_are_those_of_the_covariance(spark):
    vectors = list(enumerate(random_vectors(300, 20)))
    odd = [(1000, None), (1001, [float("nan")] * 20), (1002, [None] * 20), (1003, [float("inf")] + [0.0] * 19)]
    rows = whitening.whiten(table(spark, vectors + odd)).collect()
    compare(rows, [i for i, _ in vectors], *by_hand([v for _, v in vectors], 20), 8)


def test_short_and_empty_vectors_are_filled_up_and_rows_may_repeat(spark):
    vectors = random_vectors(60, 5) + [[1.0], [], [0.5, 0.25]]
    rows = whitening.whiten(table(spark, list(enumerate(vectors)))).collect()
    compare(rows, list(range(len(vectors))), *by_hand(vectors, 5), 5)
    again = table(spark, [(i, v) for i, v in enumerate(vectors)] * 2 + [(None, vectors[0])])
    assert whitening.whiten(again).count() == (2 * len(vectors) + 1) * 5


def test_nothing_and_rows_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    # One direction only: one component.
    rows = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert len(rows) == 9 and all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-12 for r in rows)


class Dense(whitening.Centred):
    """The same products without Spark."""

    def __init__(self, y):
        super().__init__(None, len(y), np.zeros(y.shape[1], np.int64))
        self.y, self.passes = y, 0

    def both(self, q):
        self.passes += 1
        u = self.y @ q
        return u @ self.y, float(u @ u)


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 4, 3, 3, 2, 1, 1], [7, 7, *np.linspace(6, 1, 40)], [9, 8, 7, 1e-3, 1e-3, 0, 0, 0], [1] * 12])
def test_multiple_eigenvalues_are_all_found(values):
    rng = np.random.default_rng(2)
    d = len(values)
    left, _ = np.linalg.qr(rng.standard_normal((200, d)))
    right, _ = np.linalg.qr(rng.standard_normal((d, d)))
    y = Dense(left * np.array(values) @ right.T)
    sigma, vectors = whitening.principal(y, 8)
    want = np.sort(np.array(values, float))[::-1][:8]
    want = want[want > 0]
    assert np.allclose(sigma, want, atol=1e-11) and np.allclose(vectors @ vectors.T, np.eye(len(want)), atol=1e-12)
    assert np.allclose(np.linalg.norm(y.y @ vectors.T, axis=0), sigma, atol=1e-11)


def test_few_passes_when_the_spectrum_falls():
    rng = np.random.default_rng(3)
    y = Dense(rng.standard_normal((400, 200)) * np.exp(-np.arange(200) / 4))
    sigma, _ = whitening.principal(y, 8)
    assert y.passes < 80 and np.allclose(sigma, np.linalg.svd(y.y, compute_uv=False)[:8], rtol=1e-12)


def test_deviations_beyond_a_long_are_null(spark):
    rows = whitening.whiten(table(spark, [(i, [1e9 * i, 1.0]) for i in range(3)])).collect()
    assert [r["deviation"] for r in rows] == [None, 0, None] or {r["vec_id"]: r["deviation"] for r in rows} == {0: None, 1: 0, 2: None}
