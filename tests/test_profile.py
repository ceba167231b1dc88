"""Exact medians, grouped AUC with a hot group, channel and agreement flags, strata, packed windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import epochs as E
from gridspark.operators import metrics as M
from gridspark.operators import profile as A
from gridspark.operators.medians import medians

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_medians_are_exact(spark, accuracy):
    """Even and odd groups, ties, nulls, a null group, one with most rows, and a bracket that is narrower than the ties."""
    groups = {"hot": RNG.normal(size=4001).round(2), "even": RNG.integers(0, 3, 100).astype(float), None: RNG.normal(size=11), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["median"] for r in medians(df, ["g"], "v", accuracy=accuracy).collect()}
    assert got == {g: float(np.median(v)) for g, v in groups.items()}
    assert medians(df, [], "v", accuracy=accuracy).first()["median"] == float(np.median(np.concatenate(list(groups.values()))))
    assert medians(df.limit(0), ["g"], "v").count() == 0


def test_auc_of_groups_with_one_that_has_most_rows(spark):
    rows = [("hot" if i % 10 else ("a", "b", None)[i // 10 % 3], float(RNG.integers(0, 400)), int(RNG.random() < 0.3)) for i in range(3000)] + [("one class", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(4)
    got = {r["g"]: r["auc"] for r in M.roc_auc(df, "s", "y", ["g"], parts=7).collect()}
    want = {}
    for g in {r[0] for r in rows} - {"one class"}:
        pos, neg = (np.array([s for k, s, y in rows if k == g and y == c]) for c in (1, 0))
        want[g] = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)


def test_flags_of_channels(spark):
    rows = [("a", c) for c in (*A.EVENT_CHANNELS, "EEG_Cz", "EEG_Pz", "A_1_1", "B_1_2", "C_2_1", "C_2_1")] + [("b", c) for c in ("StimulusBegin", "EEG_1_1", "A_B_1_1")] + [("c", A.EVENT_CHANNELS[0])]
    summary = A.channel_summary(spark.createDataFrame(rows, "run string, channel string"))
    got = {r["run"]: r for r in summary.collect()}
    assert (got["a"]["signal_channels"], got["a"]["other_channels"], got["a"]["cells"], got["a"]["missing_cells"]) == (2, 7, 3, 1)
    flags = {(r["run"], r["flag"], r["detail"]) for r in A.structure_flags(summary).collect()}
    lost = "CurrentTarget, StimulusCode, StimulusType"
    assert flags == {("a", "incomplete_grid", "1"), ("b", "missing_event_channels", lost), ("c", "missing_event_channels", lost), ("c", "missing_grid_channels", "")}


def test_agreement_of_fixed_and_adaptive_recordings(spark):
    rows = [("f", i, 1 if i < 15 else i) for i in range(45)] + [("d", i, i % 2) for i in range(7)]
    out = A.agreement_flags(spark.createDataFrame(rows, "run string, sample int, code int"), F.col("run") == "d", low=0.8).collect()
    assert {(r["run"], r["block"], r["flag"], round(r["agreement"], 6)) for r in out} == {("f", 0, "low_currenttarget_agreement", 0.75), ("f", 1, "low_currenttarget_agreement", 0.05), ("d", 0, "adaptive_currenttarget_varies", round(4 / 7, 6))}


def test_strata_overlap(spark):
    rows = [("RC", True, 2.0, 1, 6), ("Dyn", False, 4.0, 2, 12), ("DynBigram", True, 6.0, 3, 18), (None, True, 8.0, 4, 24)]
    df = spark.createDataFrame(rows, "condition string, correct boolean, seconds double, sequences_used int, flashes_used int")
    got = {r["stratum"]: (r["characters"], r["accuracy"], r["seconds_per_char"]) for r in M.accuracy_strata(df, merged={"Dyn/DynBigram": ["Dyn", "DynBigram"]}).collect()}
    assert got == {"overall": (4, 0.75, 5.0), "RC": (1, 1.0, 2.0), "Dyn": (1, 0.0, 4.0), "DynBigram": (1, 1.0, 6.0), "Dyn/DynBigram": (2, 0.5, 5.0)}


def test_windows_over_borders_and_gaps(spark):
    """Windows inside one array, over two, at the ends, over a gap, wider than the least array; negative positions."""
    samples = [("a", i, float(i * i)) for i in range(-70, 300) if i != 150] + [("b", i, float(-i)) for i in range(5)]
    df = spark.createDataFrame(samples, "run string, sample int, v double")
    at = [(r, i, f"{r}{i}") for r in ("a", "b") for i in (-70, -66, -1, 0, 3, 60, 63, 64, 127, 128, 148, 151, 156, 296, 299)]
    events = spark.createDataFrame(at, "run string, sample int, tag string")
    known = {(r, i): v for r, i, v in samples}
    for low, high in ((-2, 5), (0, 0), (-40, 41)):
        got = {(r["run"], r["sample"]): (r["tag"], r["x"]) for r in E.epoch_windows(df, events, ["run"], "sample", "v", low, high).collect()}
        want = {(r, i): (tag, [known[r, j] for j in range(i + low, i + high + 1)]) for r, i, tag in at if all((r, j) in known for j in range(i + low, i + high + 1))}
        assert got == want and want
