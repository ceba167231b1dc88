"""Moments in blocks, fold algebra, and wide systems against NumPy."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridspark.operators import classify as C
from gridspark.operators import splits as S
from gridspark.operators.moments import BlockMatrix, block_moments, conjugate_gradients, moments, pooled, wide_gram

RNG = np.random.default_rng(12)


def frame(spark, x, y, run=None, parts=4):
    rows = [(i, int(run[i]) if run is not None else i % 10, [float(v) for v in x[i]], int(y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id int, run int, x array<double>, y int").repartition(parts)


@pytest.fixture(scope="module")
def small(spark):
    x = RNG.normal(size=(400, 11)) * RNG.uniform(0.1, 20, 11) + RNG.uniform(-300, 300, 11)
    y = np.arange(400) % 3 == 0
    x[y] += RNG.normal(size=11)
    return frame(spark, x, y), x, y.astype(int)


@pytest.mark.parametrize("block", [3, 4, 256])
def test_moments_and_their_moves(small, block):
    df, x, y = small
    parts = moments(df, "y", "x", block=block)
    for k in (0, 1):
        m, z = parts[k], (x[y == k] - parts[k].at) / parts[k].unit
        assert m.n == len(z) and np.allclose(m.total, z.sum(0)) and np.allclose(m.second, (z * z).sum(0))
        assert np.allclose(m.gram, z.T @ z) and np.allclose(m.cross, (z * z).T @ z) and np.allclose(m.squares, (z * z).T @ (z * z))
        a, u = RNG.normal(size=11), RNG.uniform(0.5, 2, 11)
        gram, squares = m.moved(a, u)
        s = (z - a) / u
        assert np.allclose(gram, s.T @ s) and np.allclose(squares, (s * s).T @ (s * s))
    both = pooled([parts[0], parts[1]])
    z = (x - both.at) / both.unit
    assert both.n == 400 and np.allclose(both.squares, (z * z).T @ (z * z))
    sums = moments(df, "y", "x", wanted="")[1]
    assert sums.gram is None and np.allclose(sums.at + sums.unit * sums.mean, x[y == 1].mean(0)) and np.allclose(sums.unit * sums.deviation, x[y == 1].std(0))


def test_rows_that_count_for_several_keys(small):
    df, x, y = small
    got = moments(df.withColumn("ks", F.when(F.col("y") == 1, F.array(F.lit(5), F.lit(7))).otherwise(F.array(F.lit(5)))), "ks", "x", wanted="g")
    assert got[5].n == 400 and got[7].n == y.sum() and set(got) == {5, 7}


def ledoit_wolf(z):
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min((((z * z).T @ (z * z)) / n - s**2).sum() / (n * p), delta)
    return (1 - beta / delta) * s + beta / delta * mu * np.eye(p)


def shrunk_lda(x, y):
    cov, mean = 0, {}
    for k in (0, 1):
        own = x[y == k]
        mean[k], sd = own.mean(0), own.std(0)
        cov = cov + ledoit_wolf((own - mean[k]) / sd) * np.outer(sd, sd) / 2
    w = np.linalg.solve(cov, mean[1] - mean[0])
    return w, -w @ (mean[0] + mean[1]) / 2


def test_wide_paths_equal_dense_ones(small):
    df, x, y = small
    w, b = shrunk_lda(x, y)
    for dense in (2000, 4):
        model = C.fit_shrinkage_lda(df, dense=dense)
        assert np.allclose(model.weights, w, rtol=1e-6) and model.intercept == pytest.approx(b, rel=1e-6)
    a, b = C.fit_swlda(df), C.fit_swlda(df, dense=4)
    assert np.allclose(a.weights, b.weights) and a.intercept == pytest.approx(b.intercept) and np.count_nonzero(a.weights) > 0


def test_block_matrix_and_conjugate_gradients(small):
    df, x, y = small
    products = wide_gram(df, "x", "y", x.mean(0), x.std(0), {0: 1.0, 1: 7.0}, block=4)
    z = (x - x.mean(0)) / x.std(0)
    want = (z * np.where(y == 1, 7.0, 1.0)[:, None]).T @ z
    assert isinstance(products, BlockMatrix) and np.allclose(products.diagonal(), np.diag(want))
    assert all(np.allclose(products.column(c), want[:, c]) for c in (0, 3, 4, 10))
    v = RNG.normal(size=11)
    assert np.allclose(products.times(v), want @ v)
    assert np.allclose(conjugate_gradients(products.times, v, products.diagonal()), np.linalg.solve(want, v))


def test_4096_features(spark, tmp_path):
    """Sums stay in blocks: a system of 4096 features is solved without one whole matrix on the driver."""
    n, p = 240, 4096
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, p)).astype(np.float32).astype(float) * rng.uniform(0.5, 3, p)
    y = np.arange(n) % 2
    x[y == 1, :40] += 1.0
    pq.write_table(pa.table({"x": pa.array(list(x)), "y": pa.array(y, pa.int32())}), f"{tmp_path}/wide.parquet")
    df = spark.read.parquet(f"{tmp_path}/wide.parquet")
    model = C.fit_shrinkage_lda(df)
    w, b = shrunk_lda(x, y)
    assert np.abs(model.weights - w).max() < 1e-7 * np.abs(w).max() and model.intercept == pytest.approx(b, rel=1e-6, abs=1e-9)
    shape = block_moments(df.limit(8), "y", "x", "g", np.zeros(p), np.ones(p)).where("k = 0").select(F.count("*"), F.max(F.size("g"))).first()
    assert tuple(shape) == (16 * 17 // 2 + 1, max(256 * 256, p))


def test_fold_algebra_equals_separate_fits(small):
    df, _, _ = small
    for fit, plain in ((C.lda_fit(), C.fit_shrinkage_lda), (C.swlda_fit(), C.fit_swlda)):
        rows = lambda d, *names: {r["id"]: [r[c] for c in names] for r in d.select("id", *names).collect()}
        slow = lambda d, plain=plain: plain(d)
        a, b = rows(C.cross_fit(df, fit, "run", 3), "fold", "logit"), rows(C.cross_fit(df, slow, "run", 3), "fold", "logit")
        assert set(a) == set(b) and all(a[i] == pytest.approx(b[i], rel=1e-6, abs=1e-6) for i in a)
        cal = lambda s: 1.0 + abs(s.agg(F.sum("logit")).first()[0]) / 1e4
        (a, ta), (b, tb) = C.nested_cross_fit(df, fit, "run", 3, 2, cal), C.nested_cross_fit(df, slow, "run", 3, 2, cal)
        a, b = rows(a, "fold", "logit", "calibrated"), rows(b, "fold", "logit", "calibrated")
        assert ta == pytest.approx(tb) and all(a[i] == pytest.approx(b[i], rel=1e-6, abs=1e-6) for i in a)
    fits = C.lda_fit(), C.swlda_fit()
    a, b = C.nested_stack(df, fits, "run", "id", 2, 2)[0], C.nested_stack(df, tuple(lambda d, f=f: f(d) for f in fits), "run", "id", 2, 2)[0]
    a, b = ({r["id"]: (r["fold"], r["logit"]) for r in d.collect()} for d in (a, b))
    assert all(a[i] == pytest.approx(b[i], rel=1e-5, abs=1e-5) for i in a) and set(a) == set(b)


def test_fold_algebra_reads_the_rows_once(small):
    """One pass of features for all models of all folds: a single mapInArrow over the rows, and no model-by-model filter."""
    df, _, _ = small
    marked = S.nested_folds(df, "run", 3, 2)
    seen = df.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    C._nested_models(marked.select("id", "run", "x", "y", "fold", "inner").mapInArrow(counted, "id int, run int, x array<double>, y int, fold int, inner array<int>"), C.lda_fit(), 3, 2)
    assert 400 <= seen.value <= 2 * 400  # and a few rows for the scale


def test_nested_folds_are_those_of_the_parts(small):
    df, _, _ = small
    rows = S.nested_folds(df, "run", 3, 2).collect()
    plain = {r["id"]: r["fold"] for r in S.group_kfold(df, "run", 3).collect()}
    assert {r["id"]: r["fold"] for r in rows} == plain
    for f in range(3):
        inner = {r["id"]: r["fold"] for r in S.group_kfold(S.group_kfold(df, "run", 3).where(F.col("fold") != f).drop("fold"), "run", 2).collect()}
        assert {r["id"]: r["inner"][f] for r in rows if r["fold"] != f} == inner and all(r["inner"][f] is None for r in rows if r["fold"] == f)


def test_logistic_is_the_optimum_of_its_objective(small):
    """Standardised features, classes weighted 1 and 5, squared weights times alpha / 2 per row."""
    df, x, y = small
    model = C.fit_logistic(df, alpha=0.05)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    weight, b = np.where(y == 1, 5.0, 1.0), np.zeros(z.shape[1])
    ridge = 0.05 * len(y) * np.r_[0, np.ones(z.shape[1] - 1)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * b)
    own = b[1:] / x.std(0)
    assert np.allclose(model.weights, own, rtol=1e-3, atol=1e-4 * np.abs(own).max()) and model.intercept == pytest.approx(b[0] - own @ x.mean(0), rel=1e-3)
    scaler = C.standard_scaler(df).orderBy("i").collect()
    assert np.allclose([r["mean"] for r in scaler], x.mean(0)) and np.allclose([r["std"] for r in scaler], x.std(0))
