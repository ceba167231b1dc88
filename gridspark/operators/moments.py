"""Moments of feature vectors in blocks: class sums that many fits share, and systems too wide for one machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Features per side of a block, and the width up to which whole matrices go to the driver.
BLOCK, DENSE = 256, 2000


@dataclass(frozen=True)
class Moments:
    """Sums over the rows of one key, of z = (x - at) / unit: count, z, z^2, z_i z_j, z_i^2 z_j, z_i^2 z_j^2.

    ``at`` and ``unit`` come from a few rows and only keep the sums well conditioned.
    """

    n: float
    total: np.ndarray
    second: np.ndarray
    gram: np.ndarray | None
    cross: np.ndarray | None
    squares: np.ndarray | None
    at: np.ndarray
    unit: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.second / self.n - self.mean**2, 1e-18))

    def moved(self, a: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products, and of products of squares, of (z - a) / u."""
        gram = self.gram - np.outer(a, self.total) - np.outer(self.total, a) + self.n * np.outer(a, a)
        b = a * a
        half = 2 * self.cross * a[None, :] + 2 * np.outer(a * self.total, b) - np.outer(self.second, b)
        squares = self.squares - half - half.T + 4 * np.outer(a, a) * self.gram + self.n * np.outer(b, b)
        return gram / np.outer(u, u), squares / np.outer(u * u, u * u)

    def back(self, w: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        """A linear score of z as one of x."""
        return w / self.unit, float(intercept - (w / self.unit) @ self.at)


def pooled(parts: Sequence[Moments]) -> Moments:
    add = lambda name: None if getattr(parts[0], name) is None else sum(getattr(p, name) for p in parts)
    return replace(parts[0], **{f: add(f) for f in ("n", "total", "second", "gram", "cross", "squares")})


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _pilot(df: DataFrame, x: str, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of a few rows; they bound nothing but rounding."""
    some = [r[0] for r in df.select(x).limit(rows).collect()]
    xs = np.array(some, float) if some else np.zeros((1, 0))
    std = xs.std(axis=0)
    return xs.mean(axis=0), np.where(std > 1e-9 * np.abs(xs).max(axis=0, initial=0), std, 1.0)


def _blocks(p: int, block: int) -> list[tuple[int, int, slice, slice]]:
    edges = range(0, p, block)
    return [(i, j, slice(a, a + block), slice(b, b + block)) for i, a in enumerate(edges) for j, b in enumerate(edges) if i <= j]


_KIND = "k long, i int, j int, n double, g array<double>, c array<double>, d array<double>, q array<double>"
NAMES = ("g", "c", "d", "q")


def block_moments(df: DataFrame, key: str, x: str, wanted: str, at: np.ndarray | dict, unit: np.ndarray | dict, block: int = BLOCK) -> DataFrame:
    """Sums per key in blocks of the upper triangle, as arrays: (k, i, j, n, g, c, d, q).

    Block (-1, -1) has the count, the sums (``g``) and the sums of squares (``q``). The others have the
    products (``g``) and, as far as ``wanted`` names them, z_i^2 z_j (``c``; ``d`` for j and i) and
    z_i^2 z_j^2 (``q``). ``key`` is an integer column, or an array of all keys a row counts for. A task
    holds one upper triangle of each and key; scans are merged into as many tasks as there are cores
    before, so their number, and with it what is shuffled, does not grow with the data.
    """
    p = len(next(iter(at.values())) if isinstance(at, dict) else at)
    blocks = _blocks(p, block) if wanted else []

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for start in range(0, len(keys), 1024):
                xs, ks = matrix(rows.slice(start, 1024)), keys[start : start + 1024]
                for k in np.unique(ks).tolist():
                    z = xs[ks == k] if len(xs) else xs
                    z = (z - (at[k] if isinstance(at, dict) else at)) / (unit[k] if isinstance(unit, dict) else unit)
                    s = z * z
                    sums = held.setdefault(k, {})
                    parts = {(-1, -1, "n"): np.array([float(len(z))]), (-1, -1, "g"): z.sum(axis=0), (-1, -1, "q"): s.sum(axis=0)}
                    for name, part in parts.items():
                        sums[name] = sums[name] + part if name in sums else part
                    for i, j, a, b in blocks:
                        for name, left, right in (("g", z[:, a], z[:, b]), ("c", s[:, a], z[:, b]), ("d", z[:, a], s[:, b]), ("q", s[:, a], s[:, b])):
                            if name in wanted:
                                part = left.T @ right
                                if (i, j, name) in sums:
                                    sums[i, j, name] += part
                                else:
                                    sums[i, j, name] = part
        for k, sums in held.items():
            for i, j in [(-1, -1), *((i, j) for i, j, _, _ in blocks)]:
                n = float(sums[-1, -1, "n"][0]) if i < 0 else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n]), *[pa.array([sums[i, j, name].ravel() if (i, j, name) in sums else np.zeros(0)], pa.list_(pa.float64())) for name in NAMES]], names=["k", "i", "j", "n", *NAMES])

    def add(key_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0.0, dict.fromkeys(NAMES, 0.0)
        for batch in batches:
            n += float(np.sum(batch.column("n").to_numpy()))
            for name in NAMES:
                for row in batch.column(name):
                    sums[name] = sums[name] + row.values.to_numpy(zero_copy_only=False)
        k, i, j = (v.as_py() for v in key_)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n]), *[pa.array([sums[name]], pa.list_(pa.float64())) for name in NAMES]], names=["k", "i", "j", "n", *NAMES])

    kind = dict(df.dtypes)[key]
    keyed = df.select(F.explode(key).alias("k") if kind.startswith("array") else F.col(key).alias("k"), x)
    keyed = keyed.select(F.col("k").cast("long").alias("k"), x).where("k is not null").coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    return keyed.mapInArrow(partial, _KIND).groupBy("k", "i", "j").applyInArrow(add, _KIND)


def _put(m: np.ndarray, a: slice, b: slice, upper: np.ndarray, lower: np.ndarray | None) -> None:
    shape = m[a, b].shape
    m[a, b] = upper.reshape(shape)
    if lower is not None:
        m[b, a] = lower.reshape(shape).T


def moments(df: DataFrame, key: str, x: str = "x", wanted: str = "gcdq", pilot: tuple[np.ndarray, np.ndarray] | None = None, block: int = BLOCK) -> dict[int, Moments]:
    """Moments of each key, whole on the driver (for ``DENSE`` features at most, unless only sums are wanted)."""
    at, unit = pilot or _pilot(df, x)
    p = len(at)
    if wanted and p > DENSE:
        raise ValueError(f"{p} features; whole matrices have {DENSE} at most")
    places = {(i, j): (a, b) for i, j, a, b in _blocks(p, block)}
    rows = block_moments(df, key, x, wanted, at, unit, block).toArrow()
    vectors, grids = {}, {}
    for k, i, j, n, *arrays in zip(*(rows[c] for c in ("k", "i", "j", "n", *NAMES)), strict=True):
        k, i, j = k.as_py(), i.as_py(), j.as_py()
        g, c, d, q = (v.values.to_numpy(zero_copy_only=False) for v in arrays)
        if i < 0:
            vectors[k] = (n.as_py(), g, q)
            continue
        held = grids.setdefault(k, {name: np.zeros((p, p)) for name in ("g", "c", "q") if name in wanted})
        a, b = places[i, j]
        _put(held["g"], a, b, g, g if i != j else None)
        if "c" in wanted:
            _put(held["c"], a, b, c, d if i != j else None)
        if "q" in wanted:
            _put(held["q"], a, b, q, q if i != j else None)
    return {k: Moments(n, g, q, *(grids.get(k, {}).get(name) for name in ("g", "c", "q")), at, unit) for k, (n, g, q) in vectors.items()}


@dataclass(frozen=True)
class BlockMatrix:
    """A symmetric matrix in a written table of blocks (i, j, v) of its upper triangle; only vectors reach the driver."""

    blocks: DataFrame
    p: int
    block: int = BLOCK

    def _sums(self, each: Callable[[int, int, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> np.ndarray:
        """Add up pieces (block row, vector) that ``each`` makes of every block."""
        p, block = self.p, self.block
        side = lambda i: min(block, p - i * block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(p)
            for batch in batches:
                for i, j, v in zip(*(batch.column(c) for c in ("i", "j", "v")), strict=True):
                    i, j = i.as_py(), j.as_py()
                    for row, piece in each(i, j, v.values.to_numpy(zero_copy_only=False).reshape(side(i), side(j))):
                        out[row * block : row * block + len(piece)] += piece
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at])], names=["i", "v"])

        got = self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(p)
        total[got["i"].to_numpy()] = got["v"].to_numpy()
        return total

    def times(self, x: np.ndarray) -> np.ndarray:
        block = self.block

        def each(i: int, j: int, m: np.ndarray):
            yield i, m @ x[j * block : j * block + m.shape[1]]
            if i != j:
                yield j, x[i * block : i * block + m.shape[0]] @ m

        return self._sums(each)

    def column(self, c: int) -> np.ndarray:
        own, at = divmod(c, self.block)

        def each(i: int, j: int, m: np.ndarray):
            if j == own:
                yield i, m[:, at]
            elif i == own:
                yield j, m[at]

        return BlockMatrix(self.blocks.where((F.col("i") == own) | (F.col("j") == own)), self.p, self.block)._sums(each)

    def diagonal(self) -> np.ndarray:
        return BlockMatrix(self.blocks.where("i = j"), self.p, self.block)._sums(lambda i, j, m: iter([(i, np.diagonal(m))]))


def conjugate_gradients(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-11, most: int | None = None) -> np.ndarray:
    """Solve A x = b for a positive definite A given by its products, scaled by its diagonal."""
    x, r = np.zeros(len(b)), b.copy()
    z = r / diagonal
    d, rz, goal = z.copy(), float(r @ z), tolerance * np.linalg.norm(b)
    for _ in range(most or 10 * len(b)):
        if np.linalg.norm(r) <= goal:
            return x
        ad = times(d)
        step = rz / float(d @ ad)
        x += step * d
        r -= step * ad
        z = r / diagonal
        new = float(r @ z)
        d, rz = z + new / rz * d, new
    raise ArithmeticError("conjugate gradients do not converge")


def wide_shrunk_covariance(df: DataFrame, x: str, y: str, sums: dict[int, Moments], block: int = BLOCK) -> BlockMatrix:
    """Half the sum of both classes' Ledoit-Wolf covariances, in blocks.

    Products of class-standardised rows are summed in blocks and written; a pass over the blocks gives the
    three numbers that the shrinkage needs, another the blocks of the result.
    """
    p = len(sums[0].total)
    at = {k: m.at + m.unit * m.mean for k, m in sums.items()}
    unit = {k: m.unit * m.deviation for k, m in sums.items()}
    raw = written(block_moments(df, y, x, "gq", at, unit, block).where("i >= 0"), "moments")
    n = {k: m.n for k, m in sums.items()}

    def scalars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, j, g, q in zip(*(batch.column(c) for c in ("k", "i", "j", "g", "q")), strict=True):
                k, twice = k.as_py(), 1.0 if i == j else 2.0
                side = min(block, p - i.as_py() * block)
                s = g.values.to_numpy(zero_copy_only=False) / n[k]
                trace = float(s.reshape(side, -1).trace()) if i == j else 0.0
                yield pa.RecordBatch.from_pydict({"k": [k], "t": [trace], "f": [twice * float(s @ s)], "q": [twice * float(q.values.to_numpy(zero_copy_only=False).sum()) / n[k]]})

    shrink, level = {}, {}
    for r in raw.mapInArrow(scalars, "k long, t double, f double, q double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "tfq"]).collect():
        mu = r["t"] / p
        delta = (r["f"] - p * mu * mu) / p
        beta = min((r["q"] - r["f"]) / (n[r["k"]] * p), delta)
        shrink[r["k"]], level[r["k"]] = (0.0 if delta <= 0 else beta / delta), mu

    def half(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (v.as_py() for v in key)
        a, b = slice(i * block, (i + 1) * block), slice(j * block, (j + 1) * block)
        out = 0.0
        for batch in batches:
            for k, g in zip(batch.column("k"), batch.column("g"), strict=True):
                k = k.as_py()
                s = g.values.to_numpy(zero_copy_only=False).reshape(len(unit[k][a]), -1) / n[k]
                s = (1 - shrink[k]) * s + (shrink[k] * level[k] * np.eye(len(s)) if i == j else 0.0)
                out = out + s * np.outer(unit[k][a], unit[k][b]) / 2
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=["i", "j", "v"])

    return BlockMatrix(written(raw.select("k", "i", "j", "g").groupBy("i", "j").applyInArrow(half, "i int, j int, v array<double>"), "covariance"), p, block)


def wide_gram(df: DataFrame, x: str, y: str, at: np.ndarray, unit: np.ndarray, weights: dict[int, float], block: int = BLOCK) -> BlockMatrix:
    """Weighted sum of the classes' products, in blocks."""
    raw = block_moments(df, y, x, "g", at, unit, block).where("i >= 0")

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0.0
        for batch in batches:
            for k, g in zip(batch.column("k"), batch.column("g"), strict=True):
                out = out + weights[k.as_py()] * g.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([out], pa.list_(pa.float64()))], names=["i", "j", "v"])

    return BlockMatrix(written(raw.select("k", "i", "j", "g").groupBy("i", "j").applyInArrow(add, "i int, j int, v array<double>"), "gram"), len(at), block)
