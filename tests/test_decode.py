"""Known answers for posteriors, stopping and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import numeric as N
from gridspark.operators import decode as D
from gridspark.operators import metrics as M
from gridspark.operators import posterior as P
from gridspark.operators import stats as H

COLS = "run long, char_idx int, seq_idx int, stim_code int, prob double, logit double, y int"


def flashes(spark, codes, probs, y=None):
    rows = [(1, 0, 1, c, p, math.log(p / (1 - p)), 0 if y is None else y[i]) for i, (c, p) in enumerate(zip(codes, probs, strict=True))]
    return spark.createDataFrame(rows, COLS)


def test_small_sequence(spark):
    p = P.row_col_posterior(flashes(spark, [1, 2, 3, 4], [0.05, 0.9, 0.95, 0.05]), (2, 2)).first()["posterior"]
    assert int(np.argmax(p)) == 2 and sum(p) == pytest.approx(1)


def test_repeated_flashes_add_up(spark):
    p = P.row_col_posterior(flashes(spark, [1, 2, 2, 3, 4], [0.1, 0.95, 0.6, 0.95, 0.1]), (2, 2)).first()["posterior"]
    assert int(np.argmax(p)) == 2


def test_membership_equals_rows_and_columns(spark):
    rng = np.random.default_rng(1)
    probs = rng.uniform(0.05, 0.95, 51)
    codes = [i % 17 + 1 for i in range(51)]
    mask = lambda c: "".join("1" if (c <= 9 and i // 8 == c - 1) or (c > 9 and i % 8 == c - 10) else "0" for i in range(72))
    df = flashes(spark, codes, probs.tolist())
    masks = spark.createDataFrame([(c, mask(c)) for c in range(1, 18)], "stim_code int, lit_mask string")
    a = P.row_col_posterior(df, (9, 8)).first()["posterior"]
    b = P.membership_posterior(df.join(masks, "stim_code"), 72, score=N.prob_to_logit(F.col("prob"), 1e-6)).first()["posterior"]
    c = P.row_col_logit_posterior(df, (9, 8)).first()["posterior"]
    assert np.allclose(a, b, atol=1e-12) and np.allclose(a, c, atol=1e-9)


def test_partial_sequences(spark):
    assert P.sequence_evidence(flashes(spark, [1, 2], [0.6, 0.5]), (9, 8)).count() == 0
    row = P.sequence_evidence(flashes(spark, [1, 10, 10], [0.6, 0.5, 0.7]), (9, 8)).first()
    assert row["flashes"] == 3 and sum(row["posterior"]) == pytest.approx(1)


def test_screen_stops_at_two(spark):
    rows = [(1, 0, s, c, 0.5, 4.0 if c in (3, 11) else -4.0, int(c in (3, 11))) for s in range(1, 21) for c in range(1, 18)]
    df = spark.createDataFrame(rows, COLS)
    acc = P.accumulate_evidence(P.sequence_evidence(df, (9, 8)))
    got = D.capped_stop(acc).first()
    assert (got["sequences_used"], got["decision"], got["full_decision"]) == (2, 2 * 8 + 1, 17)
    assert P.target_cell(df, (9, 8)).first()["cell"] == 17
    stop = D.dynamic_stop(acc, tau=2.0, max_sequences=5).first()
    assert stop["sequences_used"] == 5 and not stop["stopped"]


def test_sequence_metrics_identity(spark):
    rows = [(1, 0, 1, c, 0.5, 2.0 if c in (4, 11) else -0.5, int(c in (4, 11))) for c in range(1, 18)]
    df = spark.createDataFrame(rows, COLS)
    full = P.complete_sequences(df, 17, (9, 8)).drop("n")
    got = M.sequence_metrics(P.sequence_evidence(df, (9, 8)).join(full, ["run", "char_idx", "seq_idx"])).first()
    z = np.array([2.0] + [-0.5] * 8), np.array([2.0] + [-0.5] * 7)
    want = np.mean([np.log(np.exp(a).sum()) - a[0] for a in z])
    assert got["row_accuracy"] == got["column_accuracy"] == 1 and got["row_column_nll"] == pytest.approx(want)


def test_zero_prior_cells_never_win(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.5, 0.5])], "run long, char_idx int, prior array<double>")
    for mode in ("fixed", "adaptive"):
        assert P.initial_bias(df, 0.0, mode).first()["bias"][0] == -1e9
    both = df.withColumn("posterior", F.lit([0.98, 0.01, 0.01]))
    assert P.fuse(both, 1.0).first()["fused"] == pytest.approx([0.0, 0.5, 0.5])


def test_itr_edges(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1 / 9,), (0.9,)], "p double").select(N.itr(9, F.col("p"), F.lit(6.0)).alias("r"))
    got = [r["r"] for r in df.collect()]
    assert got[0] == pytest.approx(10 * math.log2(9)) and got[1] == 0 and got[2] == pytest.approx(0, abs=1e-9) and got[3] > 0


def test_wilcoxon_against_enumeration(spark):
    d = [1.5, -0.5, 2.0, 3.0, -1.0, 4.0, 0.7]
    df = spark.createDataFrame([("a", i, 0.0, x) for i, x in enumerate(d)], "c string, s int, baseline double, value double")
    got = H.wilcoxon_paired(df, ["c"]).first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[np.array(d) > 0].sum(), ranks[np.array(d) < 0].sum())
    sums = [sum(r for r, b in zip(range(1, 8), f"{k:07b}", strict=True) if b == "1") for k in range(128)]
    assert got["statistic"] == w and got["p_value"] == pytest.approx(min(1, 2 * np.mean([s <= w for s in sums])))


def test_wilcoxon_all_zero(spark):
    df = spark.createDataFrame([("a", i, 1.0, 1.0) for i in range(4)], "c string, s int, baseline double, value double")
    got = H.wilcoxon_paired(df, ["c"]).first()
    assert (got["statistic"], got["p_value"]) == (0.0, 1.0)


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.5])], "family string, k int, p_value double")
    got = {r["k"]: (r["p_holm"], r["reject"]) for r in H.holm(df, ["family"]).collect()}
    assert got[0][0] == pytest.approx(0.04) and got[0][1] and got[2][0] == pytest.approx(0.09) and got[1][0] == pytest.approx(0.09) and got[3][0] == pytest.approx(0.5)


def test_global_auc_equals_grouped(spark):
    rng = np.random.default_rng(3)
    rows = [(float(np.round(z, 1)), int(y), 1) for z, y in zip(rng.normal(size=800), rng.integers(0, 2, 800), strict=True)]
    df = spark.createDataFrame(rows, "s double, y int, g int")
    assert M.roc_auc(df, "s", "y", parts=16).first()["auc"] == pytest.approx(M.roc_auc(df, "s", "y", ["g"]).first()["auc"])


def test_policy_sweep_equals_each_policy_alone(spark):
    """Thousands of thresholds with several bounds, ties of confidence, characters without a step inside the bounds."""
    import numpy as np

    from gridspark.operators.metrics import _policy_sums

    rng = np.random.default_rng(3)
    chars = []
    for _ in range(60):
        n = int(rng.integers(1, 8))
        chars.append([(int(s), float(rng.choice([0.3, 0.5, 0.7, 0.9])) if rng.random() < 0.5 else float(rng.random()), int(rng.integers(0, 4)), bool(rng.random() < 0.5)) for s in rng.permutation(9)[:n] + 1])
    policies = [(f"p{i}", float(t), int(lo), int(hi)) for i, (t, (lo, hi)) in enumerate((t, b) for t in [*rng.random(400), 0.3, 0.5, 0.7, 0.9, 0.0, 1.0, 2.0] for b in [(1, 9), (2, 4), (5, 3), (3, 9)])]
    got = _policy_sums(*[[[s[c] for s in ch] for ch in chars] for c in range(4)], policies, 7)

    def stop(ch, tau, lo, hi):
        inside = sorted(s for s in ch if s[0] <= hi)
        return next((s for s in inside if s[0] >= lo and s[1] >= tau), inside[-1] if inside else None)

    want = np.zeros_like(got)
    for ch in chars:
        ref = stop(ch, *policies[7][1:])
        for i, (_, tau, lo, hi) in enumerate(policies):
            s = stop(ch, tau, lo, hi)
            if s:
                flip = ref is not None and s[2] != ref[2]
                want[i] += [1, s[3], s[0], flip, flip and s[3] and not ref[3], flip and not s[3] and ref[3]]
    assert np.array_equal(got, want) and want[:, 3].any()


def test_equally_likely_cells_go_to_the_lowest(spark):
    """A prior of 0.1 with odds of 6 weighs as one of 0.2 with odds of 3, whatever the last bits of their logs say."""
    def cases(low):
        for k in range(1, 200):
            a, b = math.log(0.1) + 0.3 + math.log(2.0 * k), math.log(0.2) + 0.3 + math.log(float(k))
            if (a < b) == low and a != b:
                yield k

    ks = [next(cases(True)), next(cases(False))]
    rows = [(k, [0.3, -9.0, -9.0], [math.log(2.0 * k), math.log(float(k)), -9.0], [0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]) for k in ks]
    scored = spark.createDataFrame(rows, "k int, rows array<double>, cols array<double>, prior array<double>")
    assert {r["decision"] for r in D.row_shortlist_decode(scored, (3, 3), rows=2, keys=["k"]).collect()} == {0}
    sums = [(k, [math.log(0.1) + 0.3 + math.log(2.0 * k), math.log(0.2) + 0.3 + math.log(float(k))]) for k in ks]
    assert {r["decision"] for r in D.decode_argmax(spark.createDataFrame(sums, "k int, evidence array<double>")).collect()} == {0}


def test_what_cells_share_is_computed_once(spark):
    """Neither the entropy that sets alpha nor a softmax's sum is put into the lambda over cells."""
    df = spark.createDataFrame([([0.5, 0.3, 0.2], [0.2, 0.0, 0.8])], "posterior array<double>, prior array<double>")
    fused = P.fuse(df, 0.85, "adaptive")
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("aggregate(") for line in plan.splitlines()) <= 2
    e, q = np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.0, 0.8])
    weights = np.where(q > 0, e * np.maximum(q, 1e-9) ** (0.85 * -(e * np.log(e)).sum() / math.log(3)), 0)
    assert fused.first()["fused"] == pytest.approx((weights / weights.sum()).tolist(), abs=1e-7)
