"""Whitening of embeddings: a randomised range finder with power passes over all rows, then Rayleigh-Ritz."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import keep

COMPONENTS, OVERSAMPLED, PASSES, SEED = 8, 8, 5, 23
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this lie outside what whole numbers of x can hold with the sums of a large table.
MOST = float(1 << 40)
#: Largest residual of a component against the largest eigenvalue: what rounding leaves.
RESIDUAL = 1e-12
#: Components whose variance is below this share of the largest one have none that could be scaled to 1.
LEAST_SHARE = 1e-12


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(F.coalesce(vector, F.array().cast("array<double>")), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > MOST))


def vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the remaining rows, entries c as floor(1024 c) + 100000."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c")).where(_usable(F.col("c")))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums by dimension: tasks add the upper and the lower 20 bits by themselves, so that nothing overflows."""

    def run(batches):
        high, low = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            high += (x >> 20).sum(axis=0)
            low += (x & 0xFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = rows.mapInArrow(W.tidy(run), "i int, high long, low long").groupBy("i").agg(wide("high").alias("high"), wide("low").alias("low")).collect()
    return [(int(r.high) << 20) + int(r.low) for r in sorted(got)]


def _products(mean: np.ndarray, q: np.ndarray):
    """(x) to (i, j, v): the sum over some rows of centred x times its product with the columns of ``q``."""

    def run(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            x = _matrix(batch.column(0), len(mean)) - mean
            total += x.T @ (x @ q)
        i, j = np.indices(q.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def _summed(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """Sums of (i, j, v): as many numbers as the shape has come to the driver, whatever the rows."""
    got = rows.mapInArrow(W.tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape)
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    return out


def principal(rows: DataFrame, mean: np.ndarray, n: int, components: int = COMPONENTS, oversampled: int = OVERSAMPLED, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors as columns, width of the last basis) of the covariance of ``rows(x)``, largest first.

    A random basis wider than the components is multiplied by the covariance, pass by
    pass over all centred rows, and made orthonormal between passes; every pass also
    gives the Rayleigh-Ritz pairs of its basis and their residuals.  Where those do not
    reach rounding within the passes, or do not fall fast enough to, the basis is
    completed to the full dimension, in which one pass gives exact pairs.
    """
    d = len(mean)
    wanted, random = min(components, d), np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((d, min(d, wanted + oversampled))))[0]
    worst = None
    for k in range(passes + 1):
        z = _summed(rows, _products(mean, q), q.shape) / n
        t = q.T @ z
        values, turn = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(values)[::-1][:wanted]
        values, turn = values[order], turn[:, order]
        residual = float(np.linalg.norm(z @ turn - (q @ turn) * values, axis=0).max(initial=0.0)) / max(float(values.max(initial=0.0)), 1e-300)
        if residual <= RESIDUAL or q.shape[1] == d:
            break
        hopeless = worst is not None and residual * min(1.0, residual / worst) ** (passes - 1 - k) > RESIDUAL
        worst = residual
        if hopeless or k >= passes - 1:
            q = np.linalg.qr(np.concatenate((q, random.standard_normal((d, d - q.shape[1]))), axis=1))[0]
        else:
            q = np.linalg.qr(z)[0]
    vectors_ = q @ turn
    return values, vectors_ / np.linalg.norm(vectors_, axis=0), q.shape[1]


def _whitened(x: np.ndarray, mean: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    return (x - mean) @ scaled


def _moments(mean: np.ndarray, scaled: np.ndarray):
    """(x) to (i, j, v): sums of the whitened numbers (in the last row) and of their products."""
    k = scaled.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _whitened(_matrix(batch.column(0), len(mean)), mean, scaled)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum over dimensions of (n x - S)^2 in whole numbers; null where it passes 64 bits."""
    far = np.abs(x * float(n) - np.array(sums, dtype=float))
    if max(far.max(initial=0.0), n * float(np.abs(x).max(initial=0))) < 2.0**62 and float((far * far).sum(axis=1).max(initial=0.0)) < 2.0**62:
        y = x * np.int64(n) - np.array(sums, dtype=np.int64)
        return pa.array((y * y).sum(axis=1))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each remaining row of ``embeddings(vec_id, embedding)`` and component.

    Rows whose vector is null or holds a null or non-finite entry, or one beyond 2^40
    in size, are left out; so are vectors that have not the commonest length
    (the smallest of equally common ones) or no entry.  Entries become
    x = floor(1024 c) + 100000.  n is the number of remaining rows, deviation the exact
    sum of (n x - S)^2 (null where that passes 64 bits).  Components are numbered from 1
    by falling variance; one without variance is not returned, so that equal vectors give
    no row.  explained is its share of all variance, identity_error the largest absolute entry of
    the whitened covariance minus the identity, measured over all rows.

    Repeated rows and ids and null ids are rows like others; ties between eigenvalues take any basis.
    Only sums of a few numbers a dimension come to the driver.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings, column)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d, n = lengths[0].d, lengths[0].n
    rows = keep(rows.where(F.size("x") == d), "vectors")
    sums = _sums(rows.select("x"), d)
    mean = np.array([s / n for s in sums])
    values, unit, _ = principal(rows.select("x"), mean, n, components, **options)
    if not len(values) or values[0] <= 0:
        return spark.createDataFrame([], schema)
    real = values > values[0] * LEAST_SHARE
    values, scaled = values[real], unit[:, real] / np.sqrt(values[real])
    k = len(values)
    moments = _summed(rows.select("x"), _moments(mean, scaled), (k + 1, k)) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    trace = float(_trace(rows, mean)) / n
    explained = values / trace

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            many = np.repeat(np.arange(len(x)), k)
            w = _whitened(x, mean, scaled)
            deviation = _deviations(x, n, sums).take(pa.array(many))
            number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(many)), pa.array(number), pa.array(np.full(len(many), n)), deviation, pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(many), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(W.tidy(run), schema)


def _trace(rows: DataFrame, mean: np.ndarray) -> float:
    """Sum of the squared distances from the mean."""
    at = F.array(*[F.lit(float(m)) for m in mean])
    square = F.aggregate(F.zip_with("x", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(square.alias("v")).agg(F.sum("v")).first()[0]
