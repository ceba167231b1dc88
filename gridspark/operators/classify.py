"""Linear classifiers from sufficient statistics.

Rows (``x`` array<double>, ``y`` 0/1, a group column) are reduced to moment matrices in Spark;
systems of the feature dimension are solved on the driver and coefficients go back as a model. For
more than ``DENSE`` features the matrices stay in blocks, and only vectors reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .moments import DENSE, Moments, _pilot, conjugate_gradients, moments, pooled, wide_gram, wide_shrunk_covariance
from .moments import matrix as _matrix
from .posterior import array_sum

#: A fit returns a model whose ``apply`` adds ``logit``; a calibration returns a temperature for scored rows.
Fit = Callable[[DataFrame], "LinearModel | CovarianceModel"]
Calibrate = Callable[[DataFrame], float]


@dataclass(frozen=True)
class LinearModel:
    """Weights and intercept of a linear score."""

    weights: np.ndarray
    intercept: float

    def score(self, x: str = "x", temperature: float = 1.0) -> Column:
        w = F.lit([float(v) for v in self.weights])
        return (array_sum(F.zip_with(F.col(x), w, lambda a, b: a * b)) + self.intercept) / temperature

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Add ``logit``."""
        return df.withColumn("logit", self.score(x))


def score_linear(df: DataFrame, model: LinearModel, temperature: float = 1.0, x: str = "x") -> DataFrame:
    return df.withColumn("logit", model.score(x, temperature))


def standard_scaler(df: DataFrame, x: str = "x") -> DataFrame:
    """Mean and population deviation of each feature: (i, mean, std), from one sum vector a task."""
    sums = moments(df.withColumn("_one", F.lit(0)), "_one", x, wanted="")
    m = sums.get(0)
    rows = [] if m is None else [(i, float(a), float(v)) for i, (a, v) in enumerate(zip(m.at + m.unit * m.mean, m.unit * np.sqrt(np.maximum(m.second / m.n - m.mean**2, 0.0)), strict=True))]
    return df.sparkSession.createDataFrame(rows, "i int, mean double, std double")


def _ridge(rows: DataFrame, x: Column, y: str, pos_weight: float, penalty: float, max_iter: int) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the weighted mean log loss plus half the penalty times the squared weights."""
    rows = rows.select(array_to_vector(x).alias("features"), F.col(y).cast("double").alias("label"), F.when(F.col(y) == 1, pos_weight).otherwise(1.0).alias("w"))
    fitted = LogisticRegression(weightCol="w", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(rows)
    return np.asarray(fitted.coefficients), float(fitted.intercept)


def fit_logistic(df: DataFrame, alpha: float = 0.01, pos_weight: float = 5.0, x: str = "x", y: str = "y", max_iter: int = 100) -> LinearModel:
    """Class-weighted ridge logistic regression on standardised features."""
    parts = moments(df, y, x, wanted="")
    m = pooled(list(parts.values()))
    mean, std = m.at + m.unit * m.mean, m.unit * m.deviation
    z = F.zip_with(F.zip_with(F.col(x), F.lit(mean.tolist()), lambda a, b: a - b), F.lit(std.tolist()), lambda a, b: a / b)
    total = sum(p.n * (pos_weight if k == 1 else 1.0) for k, p in parts.items())
    w, intercept = _ridge(df, z, y, pos_weight, alpha * m.n / total, max_iter)
    return LinearModel(w / std, float(intercept - (w / std * mean).sum()))


def fit_balanced_logistic(df: DataFrame, c: float = 1.0, x: str = "x", y: str = "y", max_iter: int = 500) -> LinearModel:
    """Logistic regression on features as they are; classes weigh the same in total, and the squared
    weights count 1 / (2 c) against the summed loss of all rows."""
    sizes = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        raise ValueError("both classes are needed")
    w, intercept = _ridge(df, F.col(x), y, sizes[0] / sizes[1], 1 / (c * sum(sizes.values())), max_iter)
    return LinearModel(w, intercept)


def _t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t, by numeric integration of its density."""
    if not math.isfinite(t):
        return 0.0
    log_norm = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
    # t = tan(angle) * sqrt(dof) maps the tail to a finite interval
    low = math.atan(abs(t) / math.sqrt(dof))
    a = np.linspace(low, math.pi / 2, 2001)
    f = np.power(np.maximum(np.cos(a), 0.0), dof - 1)
    step = (math.pi / 2 - low) / 2000
    area = step / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    return float(min(1.0, 2 * math.exp(log_norm) * math.sqrt(dof) * area))


def _stepwise(column: Callable[[int], np.ndarray], diagonal: np.ndarray, xy: np.ndarray, yy: float, n: float, p_enter: float, p_remove: float, most: int) -> tuple[list[int], np.ndarray]:
    """Forward and backward selection on moments of an intercept (column 0) and features: the chosen columns and
    their coefficients. Of the products only the chosen columns are ever asked for."""
    chosen: list[int] = []
    seen = {0: column(0)}

    def solve(cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.linalg.pinv(np.column_stack([seen[c][cols] for c in cols]))
        return inverse, inverse @ xy[cols]

    for _ in range(min(most, len(diagonal) - 1)):
        cols = [0, *chosen]
        inverse, b = solve(cols)
        noise = max(yy - b @ xy[cols], 0.0) / max(n - len(cols), 1.0)
        rest = np.setdiff1d(np.arange(1, len(diagonal)), chosen)
        lever = np.column_stack([seen[c][rest] for c in cols])
        left = np.maximum(diagonal[rest] - ((lever @ inverse) * lever).sum(axis=1), 1e-12)  # what the chosen do not explain
        t = (xy[rest] - lever @ b) / np.sqrt(np.maximum(noise * left, 1e-12))
        best = int(np.argmax(np.abs(t)))
        if chosen and _t_tail(float(t[best]), max(n - len(cols) - 1, 1.0)) >= p_enter:
            break
        chosen.append(int(rest[best]))
        if chosen[-1] not in seen:
            seen[chosen[-1]] = column(chosen[-1])
        while len(chosen) > 1:
            cols = [0, *chosen]
            inverse, b = solve(cols)
            dof = max(n - len(cols), 1.0)
            error = np.sqrt(np.maximum(np.diag(inverse) * max(yy - b @ xy[cols], 0.0) / dof, 1e-300))
            p = [_t_tail(float(v), dof) for v in (b / error)[1:]]
            worst = int(np.argmax(p))
            if p[worst] <= p_remove:
                break
            del chosen[worst]
    return chosen, solve([0, *chosen])[1]


@dataclass(frozen=True)
class MomentFit:
    """A fit that needs nothing of its rows but moments of the two classes.

    Folds then share one pass: the moments of a training set are sums of those of its cells.
    """

    solve: Callable[[dict[int, Moments]], LinearModel]
    wanted: str
    x: str = "x"
    y: str = "y"

    def __call__(self, df: DataFrame) -> LinearModel:
        return self.solve(moments(df, self.y, self.x, self.wanted))


def _regression_sums(parts: dict[int, Moments], weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Column 0 of the products, their diagonal, products with the label, its square, and the number of rows."""
    first, diagonal, xy, yy = 0.0, 0.0, 0.0, 0.0
    for label, w in ((0, weights[0]), (1, weights[1])):
        m = parts[label]
        first = first + w * np.r_[m.n, m.total]
        diagonal = diagonal + w * np.r_[m.n, m.second]
        xy = xy + w * label * np.r_[m.n, m.total]
        yy += w * label * m.n
    return first, diagonal, xy, yy, parts[0].n + parts[1].n


def _swlda(parts: dict[int, Moments], p_enter: float, p_remove: float, most: int, weights: tuple[float, float], columns: Callable[[int], np.ndarray] | None = None) -> LinearModel:
    first, diagonal, xy, yy, n = _regression_sums(parts, weights)
    if columns is None:
        columns = lambda j: weights[0] * parts[0].gram[:, j] + weights[1] * parts[1].gram[:, j]
    cols, b = _stepwise(lambda j: first if j == 0 else np.r_[first[j], columns(j - 1)], diagonal, xy, yy, n, p_enter, p_remove, most)
    out = np.zeros(len(first) - 1)
    out[[c - 1 for c in cols]] = b[1:]
    return LinearModel(*parts[0].back(out, b[0]))


def swlda_fit(p_enter: float = 0.05, p_remove: float = 0.1, max_features: int = 35, weights: tuple[float, float] = (1.0, 7.0), x: str = "x", y: str = "y") -> MomentFit:
    """``fit_swlda`` as a fit whose folds share one pass."""
    return MomentFit(lambda parts: _swlda(parts, p_enter, p_remove, max_features, weights), "g", x, y)


def fit_swlda(df: DataFrame, p_enter: float = 0.05, p_remove: float = 0.1, max_features: int = 35, weights: tuple[float, float] = (1.0, 7.0), x: str = "x", y: str = "y", dense: int = DENSE) -> LinearModel:
    """Weighted stepwise regression of the label (0 or 1) on features, from one pass of moments; one
    feature always stays, even if it is not significant. Over ``dense`` features the products stay in
    blocks, of which the chosen columns are read."""
    at, unit = _pilot(df, x)
    if len(at) <= dense:
        return swlda_fit(p_enter, p_remove, max_features, weights, x, y)(df)
    products = wide_gram(df, x, y, at, unit, {0: weights[0], 1: weights[1]})
    return _swlda(moments(df, y, x, "", (at, unit)), p_enter, p_remove, max_features, weights, products.column)


def tune_swlda(df: DataFrame, grid: Sequence[tuple[float, float]], group: str, folds: int = 2, x: str = "x", y: str = "y") -> tuple[tuple[float, float], list[float]]:
    """The (enter, remove) pair with the best mean AUC over grouped folds; moments of each fold are made once."""
    from .metrics import roc_auc
    from .splits import group_kfold

    marked = group_kfold(df, group, folds).withColumn("_cell", F.col("fold") * 2 + F.col(y))
    cells = moments(marked, "_cell", x, "g")
    aucs = []
    for enter, remove in grid:
        each = []
        for f in range(folds):
            parts = {k: pooled([cells[g * 2 + k] for g in range(folds) if g != f]) for k in (0, 1)}
            scored = score_linear(marked.where(F.col("fold") == f), _swlda(parts, enter, remove, 35, (1.0, 7.0)), x=x)
            each.append(roc_auc(scored, "logit", y).first()["auc"])
        aucs.append(float(np.mean(each)))
    return grid[int(np.argmax(aucs))], aucs


def _ledoit_wolf(n: float, gram: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Shrunk covariance of centred rows from their moments of second and fourth order."""
    p, s = len(gram), gram / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((squares / n - s**2).sum() / (n * p), delta)
    shrink = 0.0 if delta == 0 else beta / delta
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def _shrinkage_lda(parts: dict[int, Moments]) -> LinearModel:
    cov = 0.0
    for k in (0, 1):
        m = parts[k]
        cov = cov + _ledoit_wolf(m.n, *m.moved(m.mean, m.deviation)) * np.outer(m.deviation, m.deviation) / 2
    w = np.linalg.solve(cov, parts[1].mean - parts[0].mean)
    return LinearModel(*parts[0].back(w, float(-w @ (parts[0].mean + parts[1].mean) / 2)))


def lda_fit(x: str = "x", y: str = "y") -> MomentFit:
    """``fit_shrinkage_lda`` as a fit whose folds share one pass."""
    return MomentFit(_shrinkage_lda, "gcq", x, y)


def fit_shrinkage_lda(df: DataFrame, x: str = "x", y: str = "y", dense: int = DENSE) -> LinearModel:
    """Linear discriminant with equal priors and Ledoit-Wolf covariance per class, standardised by class.

    One pass gives all sums, up to products of squares, from which those of class-standardised rows
    follow. Over ``dense`` features a first pass gives means and deviations, a second the products in
    blocks; the system is then solved by conjugate gradients over the blocks.
    """
    at, unit = _pilot(df, x)
    if len(at) <= dense:
        return lda_fit(x, y)(df)
    sums = moments(df, y, x, "", (at, unit))
    cov = wide_shrunk_covariance(df, x, y, sums)
    mean = {k: m.at + m.unit * m.mean for k, m in sums.items()}
    w = conjugate_gradients(cov.times, mean[1] - mean[0], cov.diagonal())
    return LinearModel(w, float(-w @ (mean[0] + mean[1]) / 2))


def _with_channels(df: DataFrame, channels: int, x: str) -> DataFrame:
    return df.where(F.size(x) % channels == 0)


def _second_moments(df: DataFrame, channels: int, x: str, y: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: count, mean epoch (channel x time), mean channel covariance."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            xs, ys = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for k in np.unique(ys):
                one = xs[ys == k].reshape((ys == k).sum(), channels, -1)
                new = np.concatenate([[float(len(one))], one.sum(axis=0).ravel(), np.einsum("nct,ndt->cd", one, one).ravel() / one.shape[2]])
                held[int(k)] = held.get(int(k), 0) + new
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["k", "i", "v"])

    rows = _with_channels(df, channels, x).select(F.col(y).cast("int").alias("k"), x).mapInArrow(partial, "k int, i int, v double")
    got = rows.groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow().to_pandas().sort_values(["k", "i"])
    out = {}
    for k, part in got.groupby("k"):
        v = part["v"].to_numpy()
        out[int(k)] = (v[0], (v[1 : len(v) - channels**2] / v[0]).reshape(channels, -1), (v[len(v) - channels**2 :] / v[0]).reshape(channels, channels))
    return out


def _xdawn(df: DataFrame, channels: int, nfilter: int, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    """Spatial filters of all classes, and the classes' mean epochs seen through their own filters."""
    stats = _second_moments(df, channels, x, y)
    n = sum(s[0] for s in stats.values())
    centre = sum(s[0] * s[1].mean(axis=1) for s in stats.values()) / n
    cov = sum(s[0] * s[2] for s in stats.values()) / n - np.outer(centre, centre) + 1e-9 * np.eye(channels)
    low = np.linalg.inv(np.linalg.cholesky(cov))
    filters, prototypes = [], []
    for k in sorted(stats):
        mean = stats[k][1]
        even = mean - mean.mean(axis=1, keepdims=True)
        values, vectors = np.linalg.eigh(low @ (even @ even.T / mean.shape[1]) @ low.T)
        own = (low.T @ vectors[:, np.argsort(-values)[:nfilter]]).T
        filters.append(own)
        prototypes.append(own @ mean)
    return np.concatenate(filters), np.concatenate(prototypes)


def fit_xdawn(df: DataFrame, channels: int, nfilter: int = 4, x: str = "x", y: str = "y") -> np.ndarray:
    """Spatial filters (filters x channels): for each class the directions in which its mean epoch
    stands out most from the covariance of all epochs."""
    return _xdawn(df, channels, nfilter, x, y)[0]


def _stacked(xs, rows: int) -> np.ndarray:
    """A series of arrays as one (epoch, row, column) array."""
    return np.stack([np.asarray(v, float) for v in xs]).reshape(len(xs), rows, -1) if len(xs) else np.zeros((0, rows, 1))


def apply_filters(df: DataFrame, filters: np.ndarray, x: str = "x") -> DataFrame:
    """Epochs projected on spatial filters, filter-major."""

    @F.pandas_udf("array<double>")
    def project(xs):
        out = np.einsum("fc,nct->nft", filters, _stacked(xs, filters.shape[1]))
        return pd.Series(list(out.reshape(len(xs), -1)), dtype=object)

    return df.withColumn(x, project(x))


def _spd(f: Callable[[np.ndarray], np.ndarray], m: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """A function of the eigenvalues (``floor`` at least) of symmetric matrices."""
    values, vectors = np.linalg.eigh(m)
    return np.einsum("...ij,...j,...kj->...ik", vectors, f(np.maximum(values, floor)), vectors)


def epoch_covariances(df: DataFrame, filters: np.ndarray, prototypes: np.ndarray, x: str = "x", ridge: float = 1e-6) -> DataFrame:
    """Replace each epoch by the covariance (row-major) of its filtered signals and the prototypes.

    The cross terms say how much of each class's typical response the epoch holds. ``ridge`` keeps
    matrices of dependent rows invertible.
    """

    @F.pandas_udf("array<double>")
    def covariance(xs):
        own = np.einsum("fc,nct->nft", filters, _stacked(xs, filters.shape[1]))
        both = np.concatenate([np.broadcast_to(prototypes, (len(own), *prototypes.shape)), own], axis=1)
        both = both - both.mean(axis=2, keepdims=True)
        out = np.einsum("nat,nbt->nab", both, both) / both.shape[2] + ridge * np.eye(both.shape[1])
        return pd.Series(list(out.reshape(len(xs), -1)), dtype=object)

    return df.withColumn(x, covariance(x))


def riemannian_mean(covs: DataFrame, channels: int, x: str = "x", tolerance: float = 1e-6, most: int = 20) -> np.ndarray:
    """Geometric mean of covariances: one aggregate per step until the step is under ``tolerance``; an
    error if ``most`` steps do not reach a thousand times that."""
    mean = np.array([r["m"] for r in covs.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]).reshape(channels, channels)
    for _ in range(most):
        half, inverse = _spd(np.sqrt, mean), _spd(lambda v: 1 / np.sqrt(v), mean)

        def logs(batches: Iterator[pa.RecordBatch], inverse=inverse) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((channels, channels)), 0
            for batch in batches:
                m = _matrix(batch.column(0)).reshape(-1, channels, channels)
                if len(m):
                    total += _spd(np.log, inverse @ m @ inverse).sum(axis=0)
                    n += len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(channels**2 + 1), pa.int32()), pa.array(np.r_[float(n), total.ravel()])], names=["i", "v"])

        got = covs.select(x).mapInArrow(logs, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()["v"].to_numpy()
        step = (got[1:] / got[0]).reshape(channels, channels)
        mean = half @ _spd(np.exp, step, -np.inf) @ half
        if np.linalg.norm(step) < tolerance:
            return mean
    if np.linalg.norm(step) >= 1000 * tolerance:
        raise ArithmeticError(f"no Riemannian mean after {most} steps")
    return mean


def tangent_vectors(covs: DataFrame, mean: np.ndarray, x: str = "x") -> DataFrame:
    """Upper triangles of the matrix logs at ``mean``; off-diagonal terms times the root of 2."""
    size = len(mean)
    inverse, (i, j) = _spd(lambda v: 1 / np.sqrt(v), mean), np.triu_indices(size)
    weight = np.where(i == j, 1.0, math.sqrt(2))

    @F.pandas_udf("array<double>")
    def project(xs):
        logs = _spd(np.log, inverse @ _stacked(xs, size).reshape(-1, size, size) @ inverse)
        return pd.Series(list(logs[:, i, j] * weight), dtype=object)

    return covs.withColumn(x, project(x))


@dataclass(frozen=True)
class CovarianceModel:
    """Scores of epochs through xDAWN covariances: a linear model on tangent vectors, or distances to class means."""

    filters: np.ndarray
    prototypes: np.ndarray
    means: tuple[np.ndarray, ...]
    linear: LinearModel | None = None

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Add ``logit``; the epochs stay as they are."""
        covs = epoch_covariances(df.withColumn("_cov", F.col(x)), self.filters, self.prototypes, "_cov")
        if self.linear is not None:
            return tangent_vectors(covs, self.means[0], "_cov").withColumn("logit", self.linear.score("_cov")).drop("_cov")
        inverses, size = [_spd(lambda v: 1 / np.sqrt(v), m) for m in self.means], len(self.means[0])

        @F.pandas_udf("double")
        def nearer(xs):
            m = _stacked(xs, size).reshape(-1, size, size)
            far = [np.sqrt((np.log(np.maximum(np.linalg.eigvalsh(h @ m @ h), 1e-12)) ** 2).sum(axis=1)) for h in inverses]
            return pd.Series(far[0] - far[1])

        return covs.withColumn("logit", nearer("_cov")).drop("_cov")


def tangent_space_lr(df: DataFrame, channels: int, nfilter: int = 4, c: float = 1.0, x: str = "x", y: str = "y") -> CovarianceModel:
    """xDAWN covariances, their Riemannian mean, and a class-balanced logistic regression on tangent vectors."""
    filters, prototypes = _xdawn(df, channels, nfilter, x, y)
    covs = epoch_covariances(df, filters, prototypes, x)
    mean = riemannian_mean(covs, 2 * len(filters), x)
    return CovarianceModel(filters, prototypes, (mean,), fit_balanced_logistic(tangent_vectors(covs, mean, x), c, x, y))


def fit_mdm(df: DataFrame, channels: int, nfilter: int = 4, x: str = "x", y: str = "y") -> CovarianceModel:
    """xDAWN covariances and the Riemannian mean of each class; an epoch's score is its distance to
    the mean of class 0 minus that to class 1."""
    filters, prototypes = _xdawn(df, channels, nfilter, x, y)
    covs = epoch_covariances(df, filters, prototypes, x)
    return CovarianceModel(filters, prototypes, tuple(riemannian_mean(covs.where(F.col(y) == k), 2 * len(filters), x) for k in (0, 1)))


def mdm_scores(df: DataFrame, channels: int, nfilter: int = 4, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``logit`` by ``fit_mdm`` on the same rows."""
    return fit_mdm(df, channels, nfilter, x, y).apply(df, x)


def _aligned(a: DataFrame, b: DataFrame, on: str, y: str) -> DataFrame:
    both = a.select(on, y, F.col("logit").alias("_a")).join(b.select(on, F.col("logit").alias("_b")), on, "full")
    broken = F.raise_error(F.lit("the two score tables have different ids")).cast("array<double>")
    return both.withColumn("x", F.when(F.col("_a").isNull() | F.col("_b").isNull(), broken).otherwise(F.array("_a", "_b")))


def stack_scores(a: DataFrame, b: DataFrame, on: str, y: str = "y", c: float = 0.1) -> tuple[DataFrame, LinearModel]:
    """Balanced logistic regression on two score columns, which should be out-of-fold scores; ids that
    only one side has are an error."""
    whole = _aligned(a, b, on, y)
    model = fit_balanced_logistic(whole, c, y=y)
    return score_linear(whole, model).select(on, y, "logit"), model


def _logits(models: Sequence[LinearModel], index: Column, x: str) -> Column:
    """The score by one of several models, picked row by row."""
    weights = F.array(*[F.lit([float(v) for v in m.weights]) for m in models])
    own = F.element_at(weights, index + 1)
    intercept = F.element_at(F.array(*[F.lit(float(m.intercept)) for m in models]), index + 1)
    return array_sum(F.zip_with(F.col(x), own, lambda a, b: a * b)) + intercept


def _of_cells(cells: dict[int, Moments], codes: Sequence[int], fit: MomentFit) -> LinearModel:
    """The model of the rows of some cells; cell c holds its classes under 2 c and 2 c + 1."""
    parts = {y: [cells[2 * c + y] for c in codes if 2 * c + y in cells] for y in (0, 1)}
    if not (parts[0] and parts[1]):
        raise ValueError("a training set of the folds lacks a class")
    return fit.solve({y: pooled(p) for y, p in parts.items()})


def cross_fit(df: DataFrame, fit: Fit, group: str, k: int) -> DataFrame:
    """Out-of-fold scores with grouped folds: every row is scored once, by a model that saw none of its group.

    A ``MomentFit`` reads the rows once for all folds, and once more to score them.
    """
    from .splits import group_kfold

    marked = group_kfold(df, group, k)
    if isinstance(fit, MomentFit):
        cells = moments(marked.withColumn("_cell", F.col("fold") * 2 + F.col(fit.y)), "_cell", fit.x, fit.wanted)
        models = [_of_cells(cells, [g for g in range(k) if g != f], fit) for f in range(k)]
        return marked.withColumn("logit", _logits(models, F.col("fold"), fit.x))
    out = None
    for f in range(k):
        part = fit(marked.where(F.col("fold") != f)).apply(marked.where(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out


def fit_final(df: DataFrame, fit: Fit, group: str, k: int, calibrate: Calibrate) -> tuple[LinearModel | CovarianceModel, float]:
    """The model of the whole pool, and the temperature that suits the pool's out-of-fold scores."""
    if not isinstance(fit, MomentFit):
        return fit(df), calibrate(cross_fit(df, fit, group, k))
    from .splits import group_kfold

    marked = group_kfold(df, group, k)
    cells = moments(marked.withColumn("_cell", F.col("fold") * 2 + F.col(fit.y)), "_cell", fit.x, fit.wanted)
    models = [_of_cells(cells, [g for g in range(k) if g != f], fit) for f in range(k)]
    return _of_cells(cells, range(k), fit), calibrate(marked.withColumn("logit", _logits(models, F.col("fold"), fit.x)))


def _nested_models(marked: DataFrame, fit: MomentFit, outer: int, inner: int) -> tuple[list[LinearModel], list[list[LinearModel]]]:
    """From one pass: for each outer fold the model of all others, and for each of its inner folds the
    model of those others without it."""
    others = F.array(*[F.when(F.col("fold") != f, (f * inner + F.col("inner")[f]) * 2 + F.col(fit.y)) for f in range(outer)])
    cells = moments(marked.withColumn("_cells", F.filter(others, lambda c: c.isNotNull())), "_cells", fit.x, fit.wanted)
    whole = [_of_cells(cells, [f * inner + i for i in range(inner)], fit) for f in range(outer)]
    return whole, [[_of_cells(cells, [f * inner + g for g in range(inner) if g != i], fit) for i in range(inner)] for f in range(outer)]


def _nested_logits(marked: DataFrame, fit: MomentFit, outer: int, inner: int) -> tuple[Column, Column]:
    """The score by the model that saw nothing of a row's outer fold, and an array: for each other outer
    fold, as whose training row it is scored by a model without its inner fold."""
    whole, parts = _nested_models(marked, fit, outer, inner)
    flat = [m for models in parts for m in models]
    each = [F.when(F.col("fold") != f, _logits(flat, f * inner + F.coalesce(F.col("inner")[f], F.lit(0)), fit.x)) for f in range(outer)]
    return _logits(whole, F.col("fold"), fit.x), F.array(*each)


def nested_cross_fit(df: DataFrame, fit: Fit, group: str, outer: int, inner: int, calibrate: Calibrate) -> tuple[DataFrame, list[float]]:
    """Out-of-fold scores, raw (``logit``) and calibrated, and the temperature of each outer fold.

    A fold is scored by a model of the other folds, at a temperature fitted on the out-of-fold
    scores of ``inner`` folds within these, so neither saw the fold. A ``MomentFit`` reads the rows once
    for all models; its scores are written without the features, and that is what ``calibrate`` gets.
    """
    from .splits import group_kfold, nested_folds

    if isinstance(fit, MomentFit):
        marked = nested_folds(df, group, outer, inner)
        raw, inside = _nested_logits(marked, fit, outer, inner)
        narrow = written(marked.select(*[c for c in df.columns if c != fit.x], "fold", inside.alias("_inside")), "nested")
        temperatures = [calibrate(narrow.where(F.col("fold") != f).withColumn("logit", F.col("_inside")[f]).drop("_inside")) for f in range(outer)]
        by_fold = F.element_at(F.array(*[F.lit(float(t)) for t in temperatures]), F.col("fold") + 1)
        return marked.drop("inner").withColumn("logit", raw).withColumn("calibrated", F.col("logit") / by_fold), temperatures
    marked = group_kfold(df, group, outer)
    out, temperatures = None, []
    for f in range(outer):
        model, temperature = fit_final(marked.where(F.col("fold") != f).drop("fold"), fit, group, inner, calibrate)
        temperatures.append(temperature)
        part = model.apply(marked.where(F.col("fold") == f)).withColumn("calibrated", F.col("logit") / temperature)
        out = part if out is None else out.unionByName(part)
    return out, temperatures


def nested_stack(df: DataFrame, fits: tuple[Fit, Fit], group: str, on: str, outer: int, inner: int, c: float = 0.1, y: str = "y") -> tuple[DataFrame, list[LinearModel]]:
    """Out-of-fold scores of a stack of two models, and the stack of each outer fold.

    The stack of a fold is fitted on base scores that are out of fold among the other folds; the
    base models it is applied to are fitted on all of these. Two ``MomentFit`` read the rows once each
    and once more for all scores, which are written without the features.
    """
    from .splits import group_kfold, nested_folds

    if all(isinstance(fit, MomentFit) for fit in fits):
        marked = nested_folds(df, group, outer, inner)
        (raw_a, in_a), (raw_b, in_b) = (_nested_logits(marked, fit, outer, inner) for fit in fits)
        both = marked.select(on, y, "fold", F.array(raw_a, raw_b).alias("x"), F.arrays_zip(in_a.alias("a"), in_b.alias("b")).alias("_inside"))
        narrow = written(both, "nested")
        stacks = [fit_balanced_logistic(narrow.where(F.col("fold") != f).select(y, F.array(F.col("_inside")[f]["a"], F.col("_inside")[f]["b"]).alias("x")), c, y=y) for f in range(outer)]
        return narrow.select(on, y, _logits(stacks, F.col("fold"), "x").alias("logit"), "fold"), stacks
    marked = group_kfold(df, group, outer)
    out, stacks = None, []
    for f in range(outer):
        train, test = marked.where(F.col("fold") != f).drop("fold"), marked.where(F.col("fold") == f)
        stack = stack_scores(*[cross_fit(train, fit, group, inner) for fit in fits], on, y, c)[1]
        stacks.append(stack)
        scored = score_linear(_aligned(*[fit(train).apply(test) for fit in fits], on, y), stack)
        part = scored.select(on, y, "logit", F.lit(f).alias("fold"))
        out = part if out is None else out.unionByName(part)
    return out, stacks


def average_scores(df: DataFrame, keys: Sequence[str], score: str = "logit") -> DataFrame:
    """Mean over seeds; NaN counts as missing."""
    return df.groupBy(*keys).agg(F.avg(F.when(~F.isnan(score), F.col(score))).alias(score))


def predict_probability(model, df: DataFrame) -> DataFrame:
    """Probability of class 1 from a fitted pipeline model."""
    return model.transform(df).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
