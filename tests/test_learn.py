"""Statistical recovery of classifiers, calibration, splits; sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import calibrate as K
from gridspark.operators import classify as C
from gridspark.operators import retrieval as R
from gridspark.operators import signal as G
from gridspark.operators import splits as S
from gridspark.sources import tables as T


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 12))
    y = (x[:, 4] + 0.3 * rng.normal(size=500) > 0).astype(int)
    return spark.createDataFrame([(i, i % 10, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id int, run int, x array<double>, y int")


def test_stepwise_finds_the_feature(planted):
    w = C.fit_swlda(planted).weights
    assert abs(w).argmax() == 4 and w[4] > 0


def test_shrinkage_matches_numpy(planted):
    rows = planted.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    cov = 0
    for k in (0, 1):
        z = x[y == k]
        s = z.std(axis=0)
        z = (z - z.mean(axis=0)) / s
        n, p = z.shape
        e = z.T @ z / n
        mu, d = np.trace(e) / p, ((e - np.trace(e) / p * np.eye(p)) ** 2).sum() / p
        b = min(sum(((np.outer(v, v) - e) ** 2).sum() for v in z) / (n**2 * p), d)
        cov = cov + ((1 - b / d) * e + b / d * mu * np.eye(p)) * np.outer(s, s) / 2
    w = np.linalg.solve(cov, x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0))
    assert np.allclose(C.fit_shrinkage_lda(planted).weights, w, rtol=1e-6)


def test_cross_fit_scores_each_row_once(planted):
    out = C.cross_fit(planted, C.fit_shrinkage_lda, "run", 3)
    assert out.count() == 500 and out.select("id").distinct().count() == 500
    assert out.groupBy("run").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0


def test_folds_keep_every_row(spark):
    rows = [(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)]
    got = S.group_kfold(spark.createDataFrame(rows, "g string, id int"), "g", 2)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    assert {(r["g"], r["fold"]) for r in got.collect()} == {("b", 0), (None, 1), ("a", 1)}
    # past the largest groups, folds go by a hash: whole groups still, none left out
    many = [(f"g{i % 400}" if i % 7 else None, i) for i in range(3000)]
    got = S.group_kfold(spark.createDataFrame(many, "g string, id int"), "g", 4, most_groups=5).collect()
    folds = {}
    for r in got:
        folds.setdefault(r["g"], set()).add(r["fold"])
    assert len(got) == 3000 and all(len(f) == 1 for f in folds.values())
    assert min(sum(1 for f in folds.values() if f == {k}) for k in range(4)) > 60


def arrays(df):
    rows = df.orderBy("id").collect()
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])


def test_stepwise_matches_least_squares(planted):
    """Weighted least squares of the 0/1 label on the chosen features; features left out add nothing significant."""
    x, y = arrays(planted)
    model = C.fit_swlda(planted)
    use = np.flatnonzero(model.weights)
    root = np.sqrt(np.where(y == 1, 7.0, 1.0))
    design = np.column_stack([np.ones(len(y)), x[:, use]])
    b, *_ = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)
    assert np.allclose(model.weights[use], b[1:]) and model.intercept == pytest.approx(b[0])
    left = y * root - (design * root[:, None]) @ b
    noise = left @ left / (len(y) - len(b))
    q, _ = np.linalg.qr(design * root[:, None])
    for f in set(range(12)) - set(use.tolist()):
        v = x[:, f] * root
        t = v @ left / np.sqrt(noise * (v @ v - ((q.T @ v) ** 2).sum()))
        assert C._t_tail(float(t), len(y) - len(b) - 1) >= 0.05


def newton(x, y, c):
    """Balanced logistic regression with squared weights / (2 c), intercept free."""
    z, w = np.column_stack([np.ones(len(y)), x]), np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    b, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    return b


def test_balanced_logistic_matches_newton(planted):
    x, y = arrays(planted)
    for c in (1.0, 0.01):
        model, b = C.fit_balanced_logistic(planted, c), newton(x, y, c)
        assert np.allclose(model.weights, b[1:], atol=1e-4) and model.intercept == pytest.approx(b[0], abs=1e-4)


def test_stack_is_a_balanced_regression_of_both(planted):
    a, b = C.cross_fit(planted, C.fit_shrinkage_lda, "run", 2), C.cross_fit(planted, C.fit_swlda, "run", 2)
    scored, model = C.stack_scores(a, b, "id")
    both = np.array([[r[1], r[2]] for r in a.select("id", "logit").join(b.select("id", F.col("logit").alias("b")), "id").orderBy("id").collect()])
    want = newton(both, arrays(planted)[1], 0.1)
    assert np.allclose(model.weights, want[1:], atol=1e-4)
    got = np.array([r["logit"] for r in scored.orderBy("id").collect()])
    assert np.allclose(got, both @ want[1:] + want[0], atol=1e-3)
    with pytest.raises(Exception, match="different ids"):
        C.stack_scores(a, b.where("id > 3"), "id")[0].collect()


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(5)
    wave = np.sin(np.arange(20) / 3)
    e = rng.normal(size=(160, 3, 20))
    y = np.arange(160) % 2
    e[y == 1] += np.array([0.9, -0.5, 0.2])[:, None] * wave
    return spark.createDataFrame([(i, i % 8, v.ravel().tolist(), int(k)) for i, (v, k) in enumerate(zip(e, y, strict=True))], "id int, run int, x array<double>, y int")


def power(m, f):
    w, v = np.linalg.eigh(m)
    return (v * f(w)) @ v.T


def plain_covariances(x, y, nfilter):
    """xDAWN filters and covariances of epochs with prototypes, epoch by epoch."""
    e = x.reshape(len(x), 3, -1)
    flat = np.concatenate(list(e), axis=1)
    cov = np.cov(flat, bias=True)
    filters, protos = [], []
    for k in (0, 1):
        mean = e[y == k].mean(axis=0)
        half = power(cov, lambda w: 1 / np.sqrt(w))
        w, v = np.linalg.eigh(half @ np.cov(mean, bias=True) @ half)
        own = (half @ v[:, np.argsort(-w)[:nfilter]]).T
        filters.append(own)
        protos.append(own @ mean)
    f, p = np.concatenate(filters), np.concatenate(protos)
    return np.array([np.cov(np.vstack([p, f @ one]), bias=True) + 1e-6 * np.eye(2 * len(f)) for one in e])


def plain_mean(covs):
    m = covs.mean(axis=0)
    for _ in range(40):
        half, inverse = power(m, np.sqrt), power(m, lambda w: 1 / np.sqrt(w))
        m = half @ power(np.mean([power(inverse @ c @ inverse, np.log) for c in covs], axis=0), np.exp) @ half
    return m


def test_xdawn_filters_solve_the_eigenproblem(signals):
    x, y = arrays(signals)
    filters = C.fit_xdawn(signals, 3, 2)
    cov = np.cov(np.concatenate(list(x.reshape(len(x), 3, -1)), axis=1), bias=True)
    for k in (0, 1):
        own = filters[2 * k : 2 * k + 2]
        assert np.allclose(own @ cov @ own.T, np.eye(2), atol=1e-6)
        signal = np.cov(x[y == k].reshape(-1, 3, 20).mean(axis=0), bias=True)
        seen = own @ signal @ own.T
        assert np.allclose(seen, np.diag(np.sort(np.diag(seen))[::-1]), atol=1e-8)
        assert seen[0, 0] == pytest.approx(np.linalg.eigvals(np.linalg.solve(cov, signal)).real.max(), rel=1e-5)


def test_tangent_space_and_distances_match_numpy(signals):
    x, y = arrays(signals)
    covs = plain_covariances(x, y, 1)
    mean = plain_mean(covs)
    inverse = power(mean, lambda w: 1 / np.sqrt(w))
    i, j = np.triu_indices(len(mean))
    vectors = np.array([(power(inverse @ c @ inverse, np.log) * np.where(np.eye(len(mean)) == 1, 1, np.sqrt(2)))[i, j] for c in covs])
    b = newton(vectors, y, 1.0)
    got = np.array([r["logit"] for r in C.tangent_space_lr(signals, 3, 1).apply(signals).orderBy("id").collect()])
    # the signs of filters are free, and change signs of tangent vectors with them, not scores
    assert np.allclose(got, vectors @ b[1:] + b[0], atol=2e-2) and np.corrcoef(got, vectors @ b[1:])[0, 1] > 0.9999
    far = []
    for k in (0, 1):
        h = power(plain_mean(covs[y == k]), lambda w: 1 / np.sqrt(w))
        far.append(np.array([np.sqrt((np.log(np.linalg.eigvalsh(h @ c @ h)) ** 2).sum()) for c in covs]))
    got = np.array([r["logit"] for r in C.mdm_scores(signals, 3, 1).orderBy("id").collect()])
    assert np.allclose(got, far[0] - far[1], atol=1e-3)
    assert ((got > 0) == y).mean() > 0.8


def test_nested_folds_never_see_what_they_score(planted):
    seen = []

    def fit(df):
        seen.append({r["run"] for r in df.select("run").distinct().collect()})
        return C.fit_shrinkage_lda(df)

    out, temperatures = C.nested_cross_fit(planted, fit, "run", 2, 2, lambda scored: 2.0 + scored.count() / 1e6)
    rows = out.collect()
    assert len(rows) == 500 and len(seen) == 6 and temperatures == [2.00025, 2.00025]
    assert all(r["calibrated"] == pytest.approx(r["logit"] / 2.00025) for r in rows)
    for f in (0, 1):
        test = {r["run"] for r in rows if r["fold"] == f}
        assert all(not test & s for s in seen[3 * f : 3 * f + 3])
    model, t = C.fit_final(planted, C.fit_shrinkage_lda, "run", 2, lambda scored: K.fit_temperature(scored)[0])
    assert np.allclose(model.weights, C.fit_shrinkage_lda(planted).weights) and t > 0


def test_nested_stack_scores_each_row_once(planted):
    out, stacks = C.nested_stack(planted, (C.fit_shrinkage_lda, C.fit_swlda), "run", "id", 2, 2)
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == list(range(500)) and len(stacks) == 2
    assert np.mean([(r["logit"] > 0) == r["y"] for r in rows]) > 0.85


def test_tuned_stepwise_is_the_best_of_the_grid(planted):
    from gridspark.operators.metrics import roc_auc

    grid = [(0.05, 0.1), (0.2, 0.25)]
    best, aucs = C.tune_swlda(planted, grid, "run")
    for (enter, remove), auc in zip(grid, aucs, strict=True):
        marked, each = S.group_kfold(planted, "run", 2), []
        for f in (0, 1):
            model = C.fit_swlda(marked.where(F.col("fold") != f), enter, remove)
            each.append(roc_auc(model.apply(marked.where(F.col("fold") == f)), "logit", "y").first()["auc"])
        assert auc == pytest.approx(np.mean(each))
    assert best == grid[int(np.argmax(aucs))]


def test_temperature_above_one(spark):
    rows = [(2.0 if i % 2 else -2.0, (i % 2) ^ int(i % 5 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "logit double, y int")
    t, nll = K.fit_temperature(df)
    assert t > 1 and nll < K.temperature_nll(df, [1.0]).first()["nll"]


def test_student_tail():
    assert C._t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-5)


def test_fixed_index(spark):
    df = spark.createDataFrame([(1, i) for i in range(1020)], "run int, ord int")
    got = {r["ord"]: (r["fixed_char"], r["fixed_seq"]) for r in G.fixed_sequence_index(df, 17, 10).collect()}
    assert got[170] == (1, 1) and got[323] == (1, 10) and max(c for c, _ in got.values()) == 5


def test_incomplete_sequences_raise(spark):
    df = spark.createDataFrame([(1, i) for i in range(18)], "run int, ord int")
    with pytest.raises(Exception, match="whole number"):
        G.fixed_sequence_index(df, 17, 10).collect()


def test_long_filter_is_chunked(spark):
    v = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "run int, sample int, v double")
    got = np.array([r["filtered"] for r in G.fir_filter(df, [0.1, 0.2, 0.4, 0.2, 0.1], ["run"], "sample", "v", chunk=37).orderBy("sample").collect()])
    assert np.allclose(got, np.convolve(np.pad(v, 2, mode="edge"), [0.1, 0.2, 0.4, 0.2, 0.1], "valid"))


def test_key_tokenizer(spark):
    df = spark.createDataFrame([("a", "PauseQ0CEC"), ("b", "another")], "session_id string, target_text string")
    got = {r[0]: r[1] for r in S.tokenize_keys(df, ["Pause", "0", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]).collect()}
    assert got == {"a": ["Pause", "Q", "0", "C", "E", "C"], "b": list("ANOTHER")}
    with pytest.raises(Exception, match="no key"):
        S.tokenize_keys(spark.createDataFrame([("c", "?")], df.schema), ["A"]).collect()


def test_leakage_guards(spark):
    runs = spark.createDataFrame([("a_Train1",), ("b_Train2",), ("c_Test1",)], "session_id string")
    held = spark.createDataFrame([("b_Train2",)], "session_id string")
    assert [r[0] for r in S.clean_training_pool(runs, held).collect()] == ["a_Train1"]
    assert S.split_violations(runs, held).count() == 2


def test_retrieval_prefers_whole_context(spark):
    bank = spark.createDataFrame([(0, "able", 1.0), (1, "table able", 1.0)], "bank_pos int, text string, weight double")
    cells = spark.createDataFrame([(0, "a"), (1, "b"), (2, "l"), (3, " ")], "cell_idx int, ch string")
    got = R.phrase_matches(spark.createDataFrame([("ab",)], "context string"), bank, cells).orderBy("rank").collect()
    assert [(r["bank_pos"], r["score"], r["cell_idx"]) for r in got] == [(0, 6.0, 2), (1, 3.0, 2)]


def test_normalize_probs_of_nothing_is_uniform(spark):
    df = spark.createDataFrame([([float("nan"), -1.0, float("inf")],)], "x array<double>")
    assert df.select(R.normalize_probs(F.col("x"))).first()[0] == pytest.approx([1 / 3] * 3)
    assert df.select(R.softmax_scores(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(1.0)))).first()[0] == pytest.approx([0.5, 0.0, 0.5])


def test_epoch_store_is_append_once(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "run_id int, x array<double>")
    T.write_epochs(df, str(tmp_path / "s"), {"sfreq": "256"})
    assert spark.read.parquet(str(tmp_path / "s/epochs")).count() == 2
    with pytest.raises(Exception):
        T.write_epochs(df, str(tmp_path / "s"), {})
    with pytest.raises(ValueError, match="values"):
        T.write_epochs(df.unionByName(spark.createDataFrame([(3, [1.0])], df.schema)), str(tmp_path / "t"), {})


def test_gram_counts_of_any_characters(spark):
    from collections import Counter

    texts = ["Ab  cd\tAB", None, "", "é𝄞x é𝄞x", "a", "ba"]
    got = {(r["history"], r["ch"]): r["n"] for r in R.ngram_counts(spark.createDataFrame([(t,) for t in texts], "text string"), 2).collect()}
    want = Counter()
    for t in texts:
        padded = "  " + " ".join((t or "").lower().split())
        for i in range(2, len(padded)):
            want.update((padded[i - k : i], padded[i]) for k in range(3))
    assert got == want
    with pytest.raises(ValueError, match="order"):
        R.ngram_counts(spark.createDataFrame([("a",)], "text string"), 4)


def test_rag_sweep_against_numpy(spark):
    from gridspark.functions.numeric import itr
    from gridspark.operators.metrics import rag_grid_sweep, tier_accuracy

    rng = np.random.default_rng(3)
    rows = [(i, rng.dirichlet(np.ones(4)).tolist(), float(rng.uniform(0.2, 0.9)), int(rng.integers(4)), rng.normal(size=4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, prior array<double>, confidence double, target int, evidence array<double>")
    params = spark.createDataFrame([(w, t, a) for w in (0.2, 0.7) for t in (0.3, 0.6) for a in (0.5, 1.0)], "weight double, threshold double, alpha double")
    want = {}
    for w, t, a in [tuple(r) for r in params.collect()]:
        losses, hits = [], 0
        for _, p, c, y, e in rows:
            g = w / (1 + np.exp(-30 * (c - t)))
            log = a * np.log((1 - g) / 4 + g * np.array(p)) + np.array(e)
            losses.append(-(log - np.log(np.exp(log).sum()))[y])
            hits += log.argmax() == y
        want[w, t, a] = (np.mean(losses), hits / 40)
    for objective in ("nll", "itr"):
        got = rag_grid_sweep(df, params, 4, objective, evidence="evidence").withColumn("bits", itr(4, F.col("accuracy"), F.lit(60.0))).collect()
        for r in got:
            assert (r["nll"], r["accuracy"]) == pytest.approx(want[r["weight"], r["threshold"], r["alpha"]]) and r["itr"] == pytest.approx(r["bits"])
        best = [r for r in got if r["best"]]
        assert len(best) == 1 and (best[0]["nll"] == min(r["nll"] for r in got) if objective == "nll" else best[0]["itr"] == max(r["itr"] for r in got))
    banks = spark.createDataFrame([(1, "a b"), (2, "a b c d"), (2, "e")], "tier int, text string")
    tiers = spark.createDataFrame([(1, [0.1, 0.9], 1), (2, [0.6, 0.4], 1)], "tier int, prior array<double>, target int")
    asked = spark.createDataFrame([(1, 2), (2, 1)], "tier int, count long")
    got = {r["tier"]: r for r in tier_accuracy(tiers, banks, asked, 2).collect()}
    gate = 1 / (1 + np.exp(-0.2 * (2 - 15)))
    assert got[1]["tokens"] == 2 and got[1]["accuracy"] == 0.5 and got[2]["accuracy"] == 0
    assert got[1]["nll"] == pytest.approx((np.log(2) - np.log((1 - gate / 4) / 2 + gate / 4 * 0.9)) / 2, abs=1e-5)


def test_evidence_with_and_without_a_bound(spark):
    from gridspark.operators.posterior import accumulate_evidence

    rng = np.random.default_rng(8)
    rows = [(r, c, s, rng.dirichlet(np.ones(5)).tolist(), 6) for r in (1, None) for c in (0, 1) for s in range(1, 5)]
    df = spark.createDataFrame(rows, "run int, char_idx int, seq_idx int, posterior array<double>, flashes int")

    def shown(out):
        return sorted(((str(r["run"]), r["char_idx"], r["step"], r["flashes"], *np.round(r["evidence"], 9)) for r in out.collect()))

    assert shown(accumulate_evidence(df)) == shown(accumulate_evidence(df, max_sequences=9)) and len(rows) == accumulate_evidence(df).count()
    bias = df.where("run = 1").select("run", "char_idx").distinct().withColumn("bias", F.array(*[F.lit(float(i)) for i in range(5)]))
    assert shown(accumulate_evidence(df, bias=bias)) == shown(accumulate_evidence(df, max_sequences=9, bias=bias))


def test_hierarchical_bootstrap_brackets_the_accuracy(spark):
    """The mean of replicates is near the mean accuracy of equal subjects; one sure subject has no spread; a seed repeats."""
    from gridspark.operators.stats import hierarchical_bootstrap

    rows = [("a", s, 10 + s, 40) for s in range(12)] + [("b", 0, 7, 7)]
    df = spark.createDataFrame(rows, "method string, subject int, correct int, characters int")
    got = {r["method"]: r for r in hierarchical_bootstrap(df, ["method"], 300).collect()}
    want = np.mean([(10 + s) / 40 for s in range(12)])
    assert got["a"]["mean"] == pytest.approx(want, abs=0.02) and got["a"]["low"] < want < got["a"]["high"] and got["a"]["high"] - got["a"]["low"] < 0.3
    assert (got["b"]["low"], got["b"]["mean"], got["b"]["high"]) == (1, 1, 1)
    assert {r["method"]: r["low"] for r in hierarchical_bootstrap(df, ["method"], 300).collect()}["a"] == got["a"]["low"]


def test_weights_and_draws_give_like_intervals(spark):
    """A large group by Poisson weights against NumPy's resampling, and both ways side by side; nulls count in no mean."""
    from gridspark.operators.stats import bootstrap_ci, hierarchical_bootstrap

    rng = np.random.default_rng(3)
    values = rng.exponential(2.0, 2000)
    rows = [("a", i, float(v)) for i, v in enumerate(values)] + [("a", 5000 + i, None) for i in range(300)] + [("b", 1, 4.0), ("b", 2, 4.0)]
    df = spark.createDataFrame(rows, "method string, subject int, v double")
    means = rng.choice(values, (2000, len(values))).mean(axis=1)
    want = np.quantile(means, [0.025, 0.975])
    error = 0.25 * (want[1] - want[0])  # of quantiles over 300 replicates
    for exact_rows in (10, 10_000):
        got = {r["method"]: (r["low"], r["high"]) for r in bootstrap_ci(df, ["method"], "v", "subject", 300, 5, exact_rows=exact_rows).collect()}
        assert np.abs(np.array(got["a"]) - want).max() < error and got["b"] == (4.0, 4.0)
    counts = spark.createDataFrame([("a", s, 5 + s % 10, 20) for s in range(200)], "method string, subject int, correct int, characters int")
    drawn, weighted = (hierarchical_bootstrap(counts, ["method"], 200, exact_rows=n).first() for n in (10_000, 10))
    assert all(abs(drawn[c] - weighted[c]) < 0.01 for c in ("mean", "low", "high")) and weighted["low"] < 0.475 < weighted["high"]


def test_weights_are_summed_where_the_rows_are(spark):
    """A large group meets no window, no sort of its rows and no join of draws: sums by replicate come before the shuffle."""
    from gridspark.operators.stats import POISSON_STEPS, _weighted

    rows = spark.range(4000).withColumn("v", F.lit(1.0))
    sums = _weighted(rows, "id", 100, 1).groupBy("_b").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_w")).alias("nn"))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "partial_sum" in plan and "Window" not in plan
    got = sums.agg(F.avg("n"), F.avg("nn"), F.count(F.lit(1))).first()
    assert got[0] / 4000 == pytest.approx(1, abs=0.01) and got[1] / 4000 == pytest.approx(2, abs=0.03) and got[2] == 100  # mean and variance 1
    assert POISSON_STEPS[0] == pytest.approx(np.exp(-1)) and 1 - POISSON_STEPS[-1] < 2**-29


def test_ties_hold_whatever_the_order_of_summing(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 are one metric: no difference, and ties of ranks, in counts, ranks and SQL."""
    import duckdb

    from gridspark.operators.stats import better_tied_worse, ladder_tests
    from gridspark.plans.queries_decode import DECIMALS
    from gridspark.plans.registry import ORACLES

    up, down = (0.1 + 0.2 + 0.3) / 3, (0.3 + 0.2 + 0.1) / 3
    assert up != down
    rows = [(0, "click", up), (0, "view", down), (1, "click", 0.0), (1, "view", up), (2, "click", down), (2, "view", 0.0), (3, "click", 0.0), (3, "view", 5.0)]
    df = spark.createDataFrame(rows, "subject int, method string, metric double")
    pairs = df.where("method = 'view'").withColumnRenamed("metric", "value").join(df.where("method = 'click'").select("subject", F.col("metric").alias("baseline")), "subject").select(F.col("method").alias("comparison"), "baseline", "value")
    counts = better_tied_worse(pairs, ["comparison"], decimals=DECIMALS).first()
    assert (counts["better"], counts["tied"], counts["worse"]) == (2, 1, 1)
    ladder = ladder_tests(df, decimals=DECIMALS).first()
    assert (ladder["n_pairs"], ladder["statistic"]) == (4, 1.5)
    for name, want in (("better_tied_worse", ("view", 2, 1, 1)), ("ladder_tests", ("click", "view", 4, 1.5))):
        with duckdb.connect() as c:
            c.execute("CREATE TABLE m (subject INT, method VARCHAR, metric DOUBLE)")
            c.executemany("INSERT INTO m VALUES (?, ?, ?)", rows)
            body = ORACLES[name]
            start = body.index(", ", body.index("GROUP BY user_id, event_type)")) if "GROUP BY user_id, event_type), " in body else body.index("GROUP BY user_id, event_type)") + len("GROUP BY user_id, event_type)")
            assert c.execute("WITH methods AS (FROM m) " + body[start:].lstrip(", ")).fetchall() == [want]


def test_replicates_hash_once_and_spread(spark):
    """Weights are hashed once for each row and replicate, not once a step; rows and characters leave the task they lie in."""
    from gridspark.operators.stats import _weighted, bootstrap_ci, hierarchical_bootstrap

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(4000).coalesce(1).select(F.lit("a").alias("k"), "id", F.col("id").cast("double").alias("v"))
    weighted = plan(_weighted(rows, "id", 100, 1).groupBy("_b").agg(F.sum("_w")))
    assert weighted.count("md5(") == 1
    spread = plan(bootstrap_ci(rows, ["k"], "v", "id", 20, exact_rows=10))
    assert "RepartitionByExpression [id" in spread
    counts = spark.createDataFrame([("a", 1, 1300, 2500), ("a", 2, 0, 3)], "k string, subject int, correct int, characters int")
    resampled = hierarchical_bootstrap(counts, ["k"], 40, 3)
    assert "lambdafunction" not in plan(resampled).split("Generate explode(CASE")[0]

    import hashlib

    share = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    means = []
    for b in range(1, 41):
        drawn = [(k, [(1300, 2500), (0, 3)][share(3, b, k) % 2]) for k in (1, 2)]
        wins = sum(sum(share(3, b, k, j) / 2**32 < right / n for j in range(1, n + 1)) for k, (right, n) in drawn)
        means.append(wins / sum(n for _, (_, n) in drawn))
    got = resampled.first()
    assert got["mean"] == pytest.approx(np.mean(means)) and got["low"] == pytest.approx(np.quantile(means, 0.025)) and got["high"] == pytest.approx(np.quantile(means, 0.975))


def test_rounds_of_the_search_read_written_sequences(spark, monkeypatch):
    """What the sequences are made of is read for the first time only; the rounds read a table."""
    from gridspark.operators import calibrate as K

    seen, measure = [], K.sequence_temperature_nll
    monkeypatch.setattr(K, "sequence_temperature_nll", lambda df, ts: (seen.append(tuple(df.inputFiles())), measure(df, ts))[1])
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], 0, 1), ([0.5, 0.0], [0.0, 1.0], 1, 1)], "rows array<double>, cols array<double>, true_row int, true_col int")
    K.fit_sequence_temperature(df)
    assert len(seen) == 6 and len(set(seen)) == 1 and seen[0]
