"""Whitening of embeddings: distributed covariance, its leading eigenvectors, and a projection with broadcast components.

Entries are first made integers (floor of 64 times the entry), so that the number n of distinct vectors and their sums S
are exact and every difference from the mean is the integer n*x - S over n. The covariance is gathered in tasks from
such centred vectors. The driver, which holds one d x d matrix, brings it to tridiagonal form by Householder
reflections, finds the leading eigenvalues by bisection on Sturm counts, and their vectors by inverse iteration, made
orthogonal within clusters of close eigenvalues. Components are small and are broadcast to the tasks that project.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import rebatch, stored

SCALE, OFFSET = 64, 1_000_000
EPS = np.finfo(np.float64).eps


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and q with q.T @ v @ q tridiagonal, by Householder reflections of a symmetric v."""
    a, n = np.array(v, np.float64), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.abs(x).max()
        if size == 0 or not np.any(x[1:]):
            continue
        x /= size
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = 2 * (p - (x @ p) * x)
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        column = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
        a[k + 1 :, k], a[k, k + 1 :] = column, column
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number in `at`, how many eigenvalues of the tridiagonal matrix lie below it: signs of its pivots."""
    least = np.finfo(np.float64).tiny * max(1.0, float(np.max(side**2, initial=0.0)))
    below, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for d, e2 in zip(diagonal, np.concatenate(([0.0], side**2)), strict=True):
        pivot = d - at - e2 / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, each bisected until no double lies between its bounds."""
    n = len(diagonal)
    reach = np.abs(np.concatenate(([0], side))) + np.abs(np.concatenate((side, [0])))
    low0, high0 = (diagonal - reach).min(), (diagonal + reach).max()
    slack = 4 * EPS * max(abs(low0), abs(high0)) + np.finfo(np.float64).tiny
    low, high = np.full(k, low0 - slack), np.full(k, high0 + slack)
    want = n - np.arange(k)  # so many eigenvalues are at or below the i-th largest
    while True:
        mid = low + (high - low) / 2
        open_ = (mid > low) & (mid < high)
        if not open_.any():
            return low + (high - low) / 2
        enough = sturm_counts(diagonal, side, mid) >= want
        high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid, low)


def _solve(diagonal: np.ndarray, side: np.ndarray, shift: float, x: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = x by elimination with row exchanges; pivots that vanish are set to `least`."""
    n = len(diagonal)
    d, up, up2 = (diagonal - shift).tolist(), [*side.tolist(), 0.0], [0.0] * n
    low, y = side.tolist(), x.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):  # the next row goes first
            d[i], up[i], up2[i], nxt, after = low[i], d[i + 1], up[i + 1], d[i], up[i]
            y[i], y[i + 1] = y[i + 1], y[i]
            f = nxt / d[i]
            d[i + 1], up[i + 1] = after - f * up[i], -f * up2[i]
        else:
            if abs(d[i]) < least:
                d[i] = least
            f = low[i] / d[i]
            d[i + 1] -= f * up[i]
        y[i + 1] -= f * y[i]
    for i in range(n - 1, -1, -1):
        if abs(d[i]) < least:
            d[i] = least
        rest = y[i] - (up[i] * y[i + 1] if i + 1 < n else 0.0) - (up2[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = rest / d[i]
    return np.array(y)


def inverse_iteration(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues; those of a cluster are made orthogonal in each round."""
    n, rng = len(diagonal), np.random.default_rng(12)
    size = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), np.finfo(np.float64).tiny)
    found = np.zeros((len(values), n))
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * size:
            first = i
        x = rng.standard_normal(n)
        for _ in range(rounds):
            x = _solve(diagonal, side, value, x / np.linalg.norm(x), EPS * size)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= found[first:i].T @ (found[first:i] @ x)
        found[i] = x / np.linalg.norm(x)
    return found


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of symmetric v, falling, and their unit eigenvectors as rows."""
    size = float(np.abs(v).max(initial=0.0))
    if not size:
        return np.zeros(k), np.eye(len(v))[:k]
    diagonal, side, q = tridiagonal(v / size)
    values = leading_eigenvalues(diagonal, side, k)
    return values * size, inverse_iteration(diagonal, side, values) @ q.T


def _numerators(vectors: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*y - sums, exact: as int64 where that holds them, else as Python's integers."""
    most = max(int(np.abs(vectors).max(initial=0)) * n, *(abs(s) for s in sums))
    if most < 1 << 61:
        return vectors * n - np.array(sums, np.int64)
    return vectors.astype(object) * n - np.array(sums, object)


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _by_cell(df: DataFrame, make, size: int, most: int = 1 << 13) -> np.ndarray:
    """The sum over all batches of make(vectors), an array of `size` floats; tasks send one row for each entry."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                total += make(_vectors(batch.column(0).slice(at, most)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "x"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def _exact_sums(df: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            y = _vectors(batch.column(0))
            if int(np.abs(y).max(initial=0)) * len(y) >= 1 << 62:
                y = y.astype(object)
            n, total = n + len(y), total + y.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(x)) for x in total], pa.decimal128(38)), pa.array([n] * d, pa.int64())], names=["i", "s", "n"])

    rows = df.mapInArrow(run, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums = {r.i: r for r in rows}
    return (int(rows[0].n), [int(sums[i].s) for i in range(d)]) if rows else (0, [0] * d)


def _usable(v: Column) -> Column:
    """All entries finite, and 64 times an entry fits a long."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float(1 << 55)), F.lit(False)))


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: its whitened coordinate, and how much variance the component explains.

    Vectors that are null or empty, hold null or non-finite entries or entries of 2^55 and more, or have another length
    than most (of equally frequent lengths the larger) are left out. The fit list holds each distinct vector once, so
    repeated rows have no more weight but come back as often as they stand there. Components are numbered from 1, by
    falling eigenvalue; there are min(most, d). Where a component has no variance (eigenvalue not above d * 2^-52 times
    the largest) whitened is null, and identity_error is that of the others. deviation is null where it doesn't fit a
    long. Null ids stay; an empty table gives an empty one; other columns are not read. Ids are cast to long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(_usable(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("y"))  # x of the contract less OFFSET
    lengths = rows.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    ddl = f"`{id_col}` long, {RESULT}"
    if lengths is None:
        return spark.createDataFrame([], ddl)
    d = lengths["d"]
    rows = rows.where(F.size("y") == d)
    fit = stored(rows.select("y").distinct())
    n, sums = _exact_sums(fit, d)
    k = min(most, d)

    def centred(y: np.ndarray) -> np.ndarray:
        return (_numerators(y, n, sums) / n).astype(np.float64)

    def products(w: np.ndarray) -> np.ndarray:
        return (w.T @ w).ravel()

    covariance = _by_cell(fit, lambda y: products(centred(y)), d * d).reshape(d, d) / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading_components(covariance, k)
    total = float(np.trace(covariance))
    real = values > d * EPS * max(values[0], np.finfo(np.float64).tiny)
    sent = spark.sparkContext.broadcast((components[real] / np.sqrt(values[real])[:, None]).T)
    r = int(real.sum())
    error = 0.0
    if r:
        mean = _by_cell(fit, lambda y: (centred(y) @ sent.value).sum(axis=0), r) / n
        spread = _by_cell(fit, lambda y: products(centred(y) @ sent.value - mean), r * r).reshape(r, r) / n
        error = float(np.abs(spread - np.eye(r)).max())
    explained = [float(x) / total if total else 0.0 for x in values]
    schema = pa.schema([(id_col, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()), ("eigenvalue", pa.float64())])
    eigenvalues = values.tolist()

    def project(batches):
        def out():
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    y = _vectors(part.column(1))
                    top = _numerators(y, n, sums)
                    if top.dtype != object and int(np.abs(top).max(initial=0)) ** 2 * d >= 1 << 62:
                        top = top.astype(object)
                    deviation = [x if x < 1 << 63 else None for x in (top * top).sum(axis=1).tolist()]
                    whitened = np.zeros((len(y), k))
                    whitened[:, real] = (top / n).astype(np.float64) @ sent.value
                    for row_id, dev, coordinates in zip(part.column(0).to_pylist(), deviation, whitened.tolist(), strict=True):
                        for i in range(k):
                            yield row_id, i + 1, n, dev, coordinates[i] if real[i] else None, explained[i], error, eigenvalues[i]

        return rebatch(out(), schema, most=1 << 15)

    return rows.mapInArrow(project, ddl)
