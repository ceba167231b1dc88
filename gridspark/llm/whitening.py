"""Whitening of embeddings: blockwise QR, bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MOST_DIMENSIONS = 4096
EPS = np.finfo(float).eps


def bidiagonalize(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of an upper bidiagonal B with R = U B W', and the reflectors of W."""
    a = np.array(r, float)
    n = a.shape[1]
    right = []
    for k in range(n):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k < n - 2:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
            right.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit v such that (I - 2vv')x has but its first entry; zeros if there is nothing to do."""
    scale = np.abs(x).max()
    if len(x) < 2 or not np.abs(x[1:]).any():
        return np.zeros(len(x))
    v = x / scale
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def _unbidiagonalize(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """W z: from coordinates of the bidiagonal matrix to those of the rows."""
    out = z.copy()
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        out[k + 1 :] -= 2 * v * (v @ out[k + 1 :])
    return out


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, descending, by shifted quotient differences.

    A shift below the least value of a block is taken off; one that proves too large shows in a
    negative quotient and is tried again smaller. A negligible e splits a block.
    """
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) ** 2
    if scale == 0:
        return np.zeros(len(a))
    q, e = (a * a / scale).tolist(), (b * b / scale).tolist()
    done, blocks, rounds = [], [(0, len(q) - 1, 0.0)], 0
    tiny = EPS * EPS
    while blocks:
        lo, hi, shift = blocks.pop()
        while True:
            if lo == hi:
                done.append(q[lo] + shift)
                break
            cut = next((k for k in range(hi - 1, lo - 1, -1) if e[k] <= tiny * (shift + min(q[k], q[k + 1])) or e[k] < 1e-290), None)
            if cut is not None:
                blocks.append((lo, cut, shift))
                lo = cut + 1
                continue
            rounds += 1
            if rounds > 200 * len(q):
                raise ArithmeticError("dqds does not converge")
            mean, product = (q[hi - 1] + e[hi - 1] + q[hi]) / 2, q[hi - 1] * q[hi]
            tau = product / (mean + max(mean * mean - product, 0.0) ** 0.5) if mean else 0.0
            for trial in (tau, tau / 4, tau / 64, 0.0):
                if _step(q, e, lo, hi, trial):
                    shift += trial
                    break
    return np.sort(np.array(done))[::-1] * scale


def _step(q: list[float], e: list[float], lo: int, hi: int, tau: float) -> bool:
    """One dqds transform of a block, in place; False, and nothing changed, if ``tau`` is too large."""
    new_q, new_e, d = [], [], q[lo] - tau
    for k in range(lo, hi):
        if d < 0:
            return False
        top = d + e[k]
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(e[k] * ratio)
        d = d * ratio - tau
    if d < 0:
        return False
    q[lo : hi + 1], e[lo:hi] = [*new_q, d], new_e
    return True


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue, from the twisted factorisation with the least pivot."""
    n = len(a)
    floor = EPS * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) < floor, floor, a)
    d, low = a * a, b / a[:-1]
    least = EPS * EPS * value
    keep = lambda x: x if abs(x) > least else -least
    down, s = np.zeros(max(n - 1, 0)), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = low[i] * d[i] / keep(s[i] + d[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.zeros(max(n - 1, 0)), np.zeros(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / keep(low[i] * low[i] * d[i] + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _separate(a: np.ndarray, b: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Vectors of values too close for twisted factorisations alone: inverse iteration, each orthogonal to those before."""
    t = np.diag(a * a + np.concatenate([[0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    out, draw = z.copy(), np.random.default_rng(0)
    for j, value in enumerate(values):
        before = out[:, :j]
        clean = np.abs(before.T @ z[:, j]).max(initial=0) < 1e-12 and np.linalg.norm(t @ z[:, j] - value * z[:, j]) < 64 * len(a) * EPS * values[0]
        if clean:
            continue
        x = draw.standard_normal(len(a))
        shifted = t - (value + 4 * EPS * values[0]) * np.eye(len(a))
        for _ in range(4):
            x -= before @ (before.T @ x)
            x = np.linalg.solve(shifted, x / np.linalg.norm(x))
        for _ in range(2):
            x -= before @ (before.T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def principal_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared singular values of R (at most ``most``), the right singular vectors as columns, and the sum of all squares.

    Values that rounding alone could have made (below (16 d eps)^2 of the greatest) count as zero
    and have no direction. The entry of greatest size in each vector is positive.
    """
    a, b, right = bidiagonalize(r)
    values = dqds(a, b)
    total = float(values.sum())
    top = values[:most]
    top = top[top > (16 * len(a) * EPS) ** 2 * max(total, 0)] if total > 0 else top[:0]
    z = np.column_stack([twisted_vector(a, b, v) for v in top]) if len(top) else np.zeros((len(a), 0))
    if len(top):
        z = _separate(a, b, top, z)
    v = np.column_stack([_unbidiagonalize(z[:, j], right) for j in range(len(top))]) if len(top) else z
    if len(top):
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(top))] < 0, -1.0, 1.0)
    return top, v, total


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as matrices of at most a few million entries."""
    step = max(4096, dims, 2_000_000 // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _column_sums(fit: DataFrame, dims: int) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dims, np.int64)
        for _, x in _blocks(batches, dims):
            sums += x.sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dims), "s": sums})

    rows = fit.mapInArrow(add, "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one row a dimension
    out = np.zeros(dims, np.int64)
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def _triangle(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """R of the QR factorisation of all rows, block by block; zeros fill up missing rows."""
    r = np.zeros((0, dims))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    out = np.zeros((dims, dims))
    out[: len(r)] = r
    return out


def blockwise_qr(fit: DataFrame, mean: np.ndarray, *, fan_in: int = 32) -> np.ndarray:
    """R of the centred rows: one triangle a task, then a tree of QR factorisations of stacked triangles."""
    dims = len(mean)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _triangle((x - mean for _, x in _blocks(batches, dims)), dims)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "r": [r.ravel()]})

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _triangle((np.array(row).reshape(dims, dims) for batch in batches for row in batch.column("r").to_pylist()), dims)
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "r": [r.ravel()]})

    kind = "part long, r array<double>"
    parts = materialize(fit.mapInArrow(local, kind), "whitening-triangles")
    while parts.count() > 1:
        group = F.floor(F.col("part") / fan_in).alias("group")
        parts = materialize(parts.groupBy(group).applyInArrow(merge, kind), "whitening-triangles")
    rows = parts.collect()  # a single triangle
    return np.array(rows[0]["r"]).reshape(dims, dims) if rows else np.zeros((dims, dims))


def _whitened_moments(fit: DataFrame, mean: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the whitened rows and of their products, each task sending k + k*k numbers."""
    dims, k = to.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, dims):
            w = (x - mean) @ to
            first += w.sum(0)
            second += w.T @ w
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(both)), "s": both})

    sums = np.zeros(k + k * k)
    for r in fit.mapInArrow(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = r["s"]
    return sums[:k], sums[k:].reshape(k, k)


def _exact(values: np.ndarray) -> pa.Array:
    """Integers as decimals; null where there are over 38 digits."""
    kind = pa.decimal128(38, 0)
    if values.dtype != object:
        return pc.cast(pa.array(values), kind)
    from decimal import Decimal

    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values.tolist()], kind)


def whiten_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Project vectors on the leading principal directions, scaled to unit variance.

    Entries become integers, floor(scale * c), so sums are exact. The directions are fitted on each
    distinct integer vector once. Returns for each row and component (from 1, by falling variance):
    the id, component, n (distinct vectors), deviation (sum of (n*x - S)^2 over dimensions, exact, as
    decimal), whitened, explained (share of the total variance) and identity_error (how far the
    covariance of the whitened fit list, measured in a pass over it, is from the identity).

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out; so are vectors of
    another length than most rows have (ties: the longer), and empty ones. Components without variance
    are not returned: a single distinct vector gives no rows, nor does an empty table. Repeated rows
    and null ids are returned as often as they come. Entries beyond the
    range of a long saturate, and a deviation of over 38 digits is null.
    Other columns play no part. At most ``MOST_DIMENSIONS`` dimensions: one triangle of that size is
    what a task, and the driver, holds.
    """
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine).select(F.col(id_col).alias("id"), x.alias("x"))
    kind = vectors.schema[id_col].dataType.simpleString()
    result = "id {}, component int, n long, q decimal(38,0), c decimal(38,0), whitened double"
    names = [F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    distinct = materialize(rows.select("x").distinct(), "whitening-distinct")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()  # one row a length
    dims = lengths["d"] if lengths else 0
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"{dims} dimensions; at most {MOST_DIMENSIONS}")
    fit = distinct.where(F.size("x") == dims)
    n = fit.count()
    sums = _column_sums(fit, dims) if n else np.zeros(dims, np.int64)
    mean = sums / max(n, 1)
    squares, directions, total = principal_directions(blockwise_qr(fit, mean), components) if n else (np.zeros(0), np.zeros((dims, 0)), 0.0)
    k = len(squares)
    to = directions / np.sqrt(squares / max(n, 1))
    error = 0.0
    if k:
        first, second = _whitened_moments(fit, mean, to)
        error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dims):
            w = (x - mean) @ to
            small = dims * max(int(np.abs(x).max(initial=0)), 1) ** 2 < 1 << 62 and dims * int(np.abs(x).max(initial=0)) * int(np.abs(sums).max(initial=0)) < 1 << 62
            whole = x if small else x.astype(object)
            q, c = (whole * whole).sum(1), (whole * (sums if small else sums.astype(object))).sum(1)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            comps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            yield pa.RecordBatch.from_arrays([ids, comps, pa.array(np.full(len(x) * k, n)), _exact(np.repeat(q, k)), _exact(np.repeat(c, k)), pa.array(w.ravel())], names=["id", "component", "n", "q", "c", "whitened"])

    out = rows.where(F.size("x") == dims).mapInArrow(project, result.format(kind)) if k else vectors.sparkSession.createDataFrame([], result.format(kind))
    whole = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    # the sum of (n*x - S)^2 as n^2 * q - 2n * c + sum of S^2, with q the sum of x^2 and c that of x*S
    deviation = F.try_add(F.try_subtract(F.try_multiply(whole(n * n), F.col("q")), F.try_multiply(whole(2 * n), F.col("c"))), whole(sum(int(s) ** 2 for s in sums)))
    explained = {i + 1: float(squares[i]) / total for i in range(k)}
    share = F.element_at(F.array(*[F.lit(v) for v in explained.values()] or [F.lit(None).cast("double")]), F.col("component"))
    return out.withColumn("deviation", deviation.cast("decimal(38,0)")).withColumn("explained", share).withColumn("identity_error", F.lit(error)).select(*names)
