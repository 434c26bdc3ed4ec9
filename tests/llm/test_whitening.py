import math

import numpy as np
import pytest

from kumiki.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def table(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 7, "x") for k, v in enumerate(vectors)], SCHEMA).repartition(5)


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def against(rows, x, k):
    """The rows of ``whiten`` against exact sums and a dense eigen-decomposition of the vectors ``x`` by vec_id."""
    ids, data = list(x), np.array(list(x.values()), dtype=float)
    n, sums = len(ids), [sum(v[j] for v in x.values()) for j in range(data.shape[1])]
    centred = data - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1][:k]
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, c) for i in ids for c in range(1, k + 1))
    assert all(r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) for r in rows)
    w = np.zeros((n, k))
    for r in rows:
        w[ids.index(r.vec_id), r.component - 1] = r.whitened
        assert abs(r.explained / (values[r.component - 1] / np.trace(v)) - 1) < 1e-10
    error = np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert error < 1e-8 and {r.identity_error for r in rows} == {rows[0].identity_error} and abs(rows[0].identity_error - error) < 1e-9
    for c in range(k):  # the component is an eigenvector: whitened numbers give it back
        u = centred.T @ w[:, c] / n / np.sqrt(values[c])
        assert np.linalg.norm(v @ u - values[c] * u) < 1e-9 * values[0] and abs(np.linalg.norm(u) - 1) < 1e-9


def test_whitened_rows_against_a_dense_decomposition(spark):
    r = np.random.default_rng(3)
    flat = r.standard_normal((300, 20))
    odd = [None, [None] * 20, [float("nan")] + [0.0] * 19, [float("inf")] * 20, [1.0], [], [1e30] * 20]
    vectors = [*flat.tolist(), *odd, flat[0].tolist(), flat[0].tolist()]
    rows = whitening.whiten(table(spark, vectors)).collect()
    against(rows, {k: whole(v) for k, v in enumerate(vectors) if k < 300 or k >= 300 + len(odd)}, 8)


@pytest.mark.parametrize("decay, width", [(0.05, 16), (1.0, 40)])
def test_the_basis_grows_only_where_residuals_fail(spark, decay, width):
    r = np.random.default_rng(4)
    basis = np.linalg.qr(r.standard_normal((40, 40)))[0]
    spread = np.where(np.arange(40) < 8, 900.0 * 0.8 ** np.arange(40), 900.0 * decay * 0.01 ** (1 - decay))
    data = np.round((r.standard_normal((500, 40)) * spread) @ basis.T * 1000) / 1024
    d = whitening.vectors(table(spark, data.tolist()))
    x = np.array([v.x for v in d.collect()], dtype=float)
    values, unit, used = whitening.principal(d.select("x"), x.mean(axis=0), len(x), passes=12)
    exact = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:8]
    assert np.allclose(values, exact, rtol=1e-12) and used == width
    v = np.cov(x.T, bias=True)
    assert np.abs(v @ unit - unit * values).max() < 1e-10 * values[0]


def test_few_dimensions_equal_vectors_and_no_rows(spark):
    few = np.random.default_rng(5).standard_normal((50, 3)).tolist()
    against(whitening.whiten(table(spark, few)).collect(), {k: whole(v) for k, v in enumerate(few)}, 3)
    line = [[t + 0.0, 2.0 * t, 0.0, 5.0] for t in range(30)]
    against(whitening.whiten(table(spark, line)).collect(), {k: whole(v) for k, v in enumerate(line)}, 1)
    assert whitening.whiten(table(spark, [[1.5, 2.5]] * 4)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [None, []])).count() == 0


def test_deviations_past_64_bits_are_null():
    x = np.array([[1 << 40, 5], [3, 5]], dtype=np.int64)
    assert whitening._deviations(x, 2, [(1 << 40) + 3, 10]).to_pylist() == [None, None]
    assert whitening._deviations(x[1:], 1, [0, 2**31]).to_pylist() == [9 + (2**31 - 5) ** 2]
