"""Registered queries against their SQL twins in DuckDB, a few of each family."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [
    "parse_run_path", "read_grid_layout", "read_registry", "key_context", "hash_split", "balanced_sample", "fir_filter", "asof_char_index", "block_majority", "lit_masks",
    "epoch_windows", "crop_decimate", "quality_flags", "inventory_by_condition", "membership_posterior", "fuse_adaptive", "dynamic_stop", "evaluate_arms", "policy_sweep", "roc_auc",
    "sequence_metrics", "holm", "bootstrap_ci", "bootstrap_ci_weighted", "ladder_tests", "phrase_matches", "retrieval_prior", "blend_priors", "ngram_prior", "fit_sequence_temperature", "stream_edges", "stream_dynamic_stop", "stream_phrase_growth", "stream_metrics",
    "write_epochs", "write_summary_tables", "split_failures", "protocol_overlaps", "target_counts", "channel_trace", "flip_diagnostics", "source_counts", "row_shortlist_decode", "rag_grid_sweep", "ngram_counts",
    "prior_reasons", "session_prior", "session_prior_initial", "stream_session_prior", "stream_metrics_store", "accuracy_strata", "selection_time", "channel_summary", "structure_flags", "agreement_flags",
]


def shown(v):
    if pd.isna(v):
        return ""
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        p = f"{DIR}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    want, got = duck.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(shown, r)) for r in df[cols].itertuples(index=False))
    assert rows(got.toPandas().astype(object)) == rows(want.df().astype(object))


def test_row_shortlist_decodes_all_sequences(spark):
    """Each complete sequence of a character with a prior gets one decision."""
    from pyspark.sql import functions as F

    from gridspark.operators import posterior as P
    from gridspark.plans.queries_decode import SHAPE, Tables, prior_arrays

    t = Tables(spark, DIR)
    keys = ["run", "char_idx", "seq_idx"]
    whole = P.row_col_scores(t("flashes"), SHAPE, F.col("logit"), keys).where("n_row = 3 and n_col = 3")
    want = whole.join(prior_arrays(t), ["run", "char_idx"]).select(*keys).collect()
    got = entry.queries()["row_shortlist_decode"](spark, DIR).select(*keys).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r["seq_idx"] for r in got}) > 1


def test_scan_runs_lists_all_files(spark):
    got = {r["file"]: r["length"] for r in entry.queries()["scan_runs"](spark, DIR).collect()}
    want = [os.path.join(d, f) for d, _, files in os.walk(DIR) for f in files if f.endswith(".parquet")]
    assert got == {os.path.basename(p): os.path.getsize(p) for p in want}


def test_screened_configurations_are_cross_fitted(spark):
    from gridspark.operators import classify as C
    from gridspark.operators import epochs as E
    from gridspark.operators.metrics import roc_auc
    from gridspark.plans.queries_learn import CHANNELS, LENGTH, epochs
    from gridspark.plans.registry import Tables

    got = {r["config"]: r["auc"] for r in entry.queries()["config_screen"](spark, DIR).collect()}
    assert set(got) == {"all", "decim_3", "short", "two"}
    nested = E.crop_decimate(epochs(Tables(spark, DIR)), CHANNELS, LENGTH, 0.0, 10.0, 1.5, 1)
    two = nested.selectExpr("vec_id", "run", "y", "concat(x[0], x[2]) x")
    want = roc_auc(C.cross_fit(two, C.fit_shrinkage_lda, "run", 3), "logit", "y").first()["auc"]
    assert got["two"] == pytest.approx(want, abs=1e-4)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
