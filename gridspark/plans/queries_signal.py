"""Queries over segmentation, epochs and data set summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_int as to_int
from ..operators import epochs as E
from ..operators import profile as A
from ..operators import signal as S
from .registry import Tables, query

KEYS = ["run"]


@query(
    "classify_channels",
    r"""SELECT channel, kind, CASE WHEN kind = 'grid' THEN regexp_extract(channel, '^(.*)_([0-9]+)_([0-9]+)$', 1) END AS label,
               CASE WHEN kind = 'grid' THEN CAST(regexp_extract(channel, '^(.*)_([0-9]+)_([0-9]+)$', 2) AS INT) END AS row,
               CASE WHEN kind = 'grid' THEN CAST(regexp_extract(channel, '^(.*)_([0-9]+)_([0-9]+)$', 3) AS INT) END AS col
        FROM (SELECT channel, CASE WHEN channel LIKE 'EEG\_%' ESCAPE '\' THEN 'signal' WHEN regexp_matches(channel, '^(.*)_([0-9]+)_([0-9]+)$') THEN 'grid' ELSE 'state' END AS kind
              FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'EEG_' || p_name WHEN 1 THEN p_name || '_' || CAST(p_size AS VARCHAR) || '_' || CAST(p_partkey % 8 AS VARCHAR) ELSE p_name END AS channel FROM {part}))""",
)
def classify_channels(t: Tables) -> DataFrame:
    names = t("part").selectExpr("CASE p_partkey % 3 WHEN 0 THEN concat('EEG_', p_name) WHEN 1 THEN concat(p_name, '_', p_size, '_', p_partkey % 8) ELSE p_name END channel")
    return S.classify_channels(names)


@query("grid_dims", "SELECT p_brand, max(p_size % 9 + 1) AS n_rows, max(p_partkey % 8 + 1) AS n_cols, max(p_size % 9 + 1) * max(p_partkey % 8 + 1) - count(DISTINCT (p_size % 9 + 1, p_partkey % 8 + 1)) AS missing FROM {part} GROUP BY p_brand")
def grid_dims(t: Tables) -> DataFrame:
    return S.grid_dims(t("part").selectExpr("p_brand", "p_size % 9 + 1 row", "p_partkey % 8 + 1 col"), ["p_brand"])


@query(
    "fir_filter",
    """SELECT run, sample, round(0.25 * coalesce(lag(signal) OVER w, signal) + 0.5 * signal + 0.25 * coalesce(lead(signal) OVER w, signal), 6) AS filtered
       FROM {samples} WINDOW w AS (PARTITION BY run ORDER BY sample)""",
)
def fir_filter(t: Tables) -> DataFrame:
    return S.fir_filter(t("samples"), [0.25, 0.5, 0.25], KEYS, "sample", "signal", chunk=4096).withColumn("filtered", F.round("filtered", 6))


@query(
    "rising_edges",
    """SELECT run, sample, signal FROM (SELECT run, sample, signal, lag(signal) OVER w AS p, (min(signal) OVER (PARTITION BY run) + max(signal) OVER (PARTITION BY run)) / 2 AS thr
       FROM {samples} WINDOW w AS (PARTITION BY run ORDER BY sample)) WHERE p <= thr AND signal > thr""",
)
def rising_edges(t: Tables) -> DataFrame:
    return S.rising_edges(t("samples"), KEYS, "sample", "signal").select("run", "sample", "signal")


@query(
    "sample_at_edges",
    """SELECT run, sample, CAST(stim_type > 0.5 AS INT) AS y, stim_code AS code FROM (SELECT *, lag(signal) OVER (PARTITION BY run ORDER BY sample) AS p FROM {samples}) WHERE p <= 25 AND signal > 25""",
)
def sample_at_edges(t: Tables) -> DataFrame:
    return S.sample_at_edges(S.rising_edges(t("samples"), KEYS, "sample", "signal", 25.0)).select("run", "sample", "y", "code")


@query("safe_int", "SELECT event_id, CASE WHEN event_id % 11 IN (0, 1, 2) THEN 0 ELSE CAST(round_even(value / 2, 0) AS BIGINT) END AS n FROM {events}")
def safe_int(t: Tables) -> DataFrame:
    x = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 1, F.lit(float("inf"))).when(F.col("event_id") % 11 == 2, F.lit(None)).otherwise(F.col("value") / 2)
    return t("events").select("event_id", to_int(x).alias("n"))


@query("pulse_edges", "SELECT run, sample FROM (SELECT run, sample, pulse, lag(pulse) OVER (PARTITION BY run ORDER BY sample) AS p FROM {samples}) WHERE p = 0 AND pulse <> 0")
def pulse_edges(t: Tables) -> DataFrame:
    return S.pulse_edges(t("samples"), KEYS, "sample", "pulse").select("run", "sample")


_PULSES = "(SELECT run, sample FROM (SELECT run, sample, pulse, lag(pulse) OVER (PARTITION BY run ORDER BY sample) AS p FROM {samples}) WHERE p = 0 AND pulse <> 0)"


@query(
    "asof_char_index",
    f"""SELECT s.run, s.sample, CASE WHEN count(p.sample) >= 5 THEN -1 ELSE CAST(count(p.sample) AS INT) END AS char_idx
        FROM {{samples}} s LEFT JOIN {_PULSES} p ON s.run = p.run AND p.sample <= s.sample WHERE s.stim_type = 1 GROUP BY s.run, s.sample""",
)
def asof_char_index(t: Tables) -> DataFrame:
    samples = t("samples")
    events = samples.where("stim_type = 1").select("run", "sample")
    return S.asof_char_index(events, S.pulse_edges(samples, KEYS, "sample", "pulse"), KEYS, "sample", n_chars=5)


@query("sequence_in_char", "SELECT run, ord, CAST(floor((row_number() OVER (PARTITION BY run, char_idx ORDER BY ord) - 1) / 6.0) + 1 AS INT) AS sequence_in_char FROM {flashes}")
def sequence_in_char(t: Tables) -> DataFrame:
    return S.sequence_in_char(t("flashes"), 6).select("run", "ord", "sequence_in_char")


@query("fixed_sequence_index", "SELECT run, ord, CAST(floor(ord / 12.0) AS INT) AS fixed_char, CAST(floor(ord / 6.0) AS INT) % 2 + 1 AS fixed_seq FROM {flashes}")
def fixed_sequence_index(t: Tables) -> DataFrame:
    return S.fixed_sequence_index(t("flashes"), 6, 2, strict=False).select("run", "ord", "fixed_char", "fixed_seq")


_ISLANDS = "(SELECT run, sample, stim_type, sum(n) OVER (PARTITION BY run ORDER BY sample) AS run_no FROM (SELECT *, CASE WHEN lag(stim_type) OVER (PARTITION BY run ORDER BY sample) = stim_type THEN 0 ELSE 1 END AS n FROM {samples}))"


@query("equal_runs", f"SELECT run, CAST(run_no AS BIGINT) AS run_no, min(stim_type) AS stim_type, min(sample) AS first, count(*) AS length FROM {_ISLANDS} GROUP BY run, run_no")
def equal_runs(t: Tables) -> DataFrame:
    return S.equal_runs(t("samples"), KEYS, "sample", "stim_type")


_BLOCKS = "(SELECT run, block, stim_code, count(*) AS n, min(k) AS f FROM (SELECT run, stim_code, k, CAST(floor(k / 20.0) AS INT) AS block FROM (SELECT run, stim_code, row_number() OVER (PARTITION BY run ORDER BY sample) - 1 AS k FROM {samples} WHERE stim_type = 1)) GROUP BY run, block, stim_code)"
_MAJORITY = f"(SELECT run, block, code, agreement, agreement < 0.9 AS low_agreement FROM (SELECT run, block, stim_code AS code, n / 20.0 AS agreement, sum(n) OVER (PARTITION BY run, block) AS size, row_number() OVER (PARTITION BY run, block ORDER BY n DESC, f) AS r FROM {_BLOCKS}) WHERE r = 1 AND size = 20)"


@query("block_majority", f"SELECT run, block, code, CAST(agreement AS DOUBLE) AS agreement, low_agreement FROM {_MAJORITY}")
def block_majority(t: Tables) -> DataFrame:
    return S.block_majority(t("samples").where("stim_type = 1"), KEYS, "sample", "stim_code")


@query("codes_to_text", f"SELECT run, string_agg(CASE WHEN code <= 4 THEN substr('ABCD', code, 1) ELSE '[' || code || ']' END, '' ORDER BY block) AS text FROM {_MAJORITY} GROUP BY run")
def codes_to_text(t: Tables) -> DataFrame:
    blocks = S.block_majority(t("samples").where("stim_type = 1"), KEYS, "sample", "stim_code")
    return S.codes_to_text(blocks, t("grid").where("code <= 4"), KEYS, "block")


@query("detect_group_flash", "SELECT run, max(stim_code) AS max_code, max(stim_code) > 5 AS group_flash FROM {flashes} GROUP BY run")
def detect_group_flash(t: Tables) -> DataFrame:
    return S.detect_group_flash(t("flashes"), (3, 2))


@query(
    "segmentation_mode",
    """SELECT run, CASE WHEN run % 2 = 0 OR (max(stim_code) > 5 AND max(pulse) = 1) THEN 'pulses' WHEN max(stim_code) > 5 THEN 'equal_runs' ELSE 'fixed_blocks' END AS mode
       FROM {samples} WHERE stim_code < 6 OR run % 3 = 0 GROUP BY run""",
)
def segmentation_mode(t: Tables) -> DataFrame:
    runs = t("samples").where("stim_code < 6 or run % 3 = 0").groupBy("run").agg((F.col("run") % 2 == 0).alias("adaptive"), (F.max("stim_code") > 5).alias("group_flash"), (F.max("pulse") == 1).alias("has_pulse"))
    return S.segmentation_mode(runs).select("run", "mode")


@query(
    "lit_masks",
    """SELECT e.run, e.sample, string_agg(CASE WHEN h.cell IS NULL THEN '0' ELSE '1' END, '' ORDER BY g.cell_idx) AS lit_mask
       FROM (SELECT run, sample FROM {samples} WHERE pulse = 1) e CROSS JOIN {grid} g
       LEFT JOIN (SELECT DISTINCT e.run, e.sample, c.stim_code - 1 AS cell FROM {samples} e JOIN {samples} c ON e.run = c.run AND c.sample >= e.sample AND c.sample < e.sample + 8 AND c.stim_type > 0 WHERE e.pulse = 1) h
         ON h.run = e.run AND h.sample = e.sample AND h.cell = g.cell_idx GROUP BY e.run, e.sample""",
)
def lit_masks(t: Tables) -> DataFrame:
    samples = t("samples")
    cells = samples.select("run", "sample", (F.col("stim_code") - 1).alias("cell_idx"), F.col("stim_type").alias("lit"))
    return S.lit_masks(cells, samples.where("pulse = 1").select("run", "sample"), KEYS, "sample", 9)


@query("validate_lit_masks", "SELECT run, min(3 - (run % 5 = 0 AND stim_code = 1)::INT) AS least, max(3 - (run % 5 = 0 AND stim_code = 1)::INT) AS most, max(CAST(run % 5 = 0 AND stim_code = 1 AS INT)) = 0 AS valid FROM {masked} GROUP BY run")
def validate_lit_masks(t: Tables) -> DataFrame:
    masked = t("masked").withColumn("lit_mask", F.when((F.col("run") % 5 == 0) & (F.col("stim_code") == 1), "110000000").otherwise(F.col("lit_mask")))
    return S.validate_lit_masks(masked, (3, 3))


@query(
    "sequence_coverage",
    """SELECT run, count(*) AS sequences, count(*) FILTER (n = 6) AS complete, count(*) FILTER (n = 6) AS perfect, count(*) FILTER (n = 6) >= 0.95 * count(*) AS ok
       FROM (SELECT run, char_idx, seq_idx, count(*) AS n FROM {masked} GROUP BY run, char_idx, seq_idx) GROUP BY run""",
)
def sequence_coverage(t: Tables) -> DataFrame:
    return S.sequence_coverage(t("masked"), 6, times=2)


@query("median_interval", "SELECT run, quantile_cont(gap, 0.5) / 256 AS median_interval FROM (SELECT run, sample - lag(sample) OVER (PARTITION BY run ORDER BY sample) AS gap FROM {samples} WHERE pulse = 1) GROUP BY run")
def median_interval(t: Tables) -> DataFrame:
    return S.median_interval(t("samples").where("pulse = 1"), 256.0)


@query(
    "layout_consistency",
    """SELECT study, count(DISTINCT layout) AS layouts, count(DISTINCT layout) = 1 AS consistent FROM (SELECT p_brand AS study, p_type, string_agg(DISTINCT CAST(p_size AS VARCHAR) || p_name, ',' ORDER BY CAST(p_size AS VARCHAR) || p_name) AS layout FROM {part} GROUP BY p_brand, p_type) GROUP BY study""",
)
def layout_consistency(t: Tables) -> DataFrame:
    return S.layout_consistency(t("part").selectExpr("p_brand study", "p_type", "p_size row", "1 col", "p_name label"), "study", ["p_type"])


# Epochs ------------------------------------------------------------------------------------------


@query(
    "epoch_windows",
    """SELECT e.run, e.sample, count(*) AS n, round(sum(s.signal), 6) AS total, round(sum(s.signal * (s.sample - e.sample)), 6) AS moment
       FROM (SELECT run, sample FROM {samples} WHERE pulse = 1) e JOIN {samples} s ON s.run = e.run AND s.sample BETWEEN e.sample - 2 AND e.sample + 5 GROUP BY e.run, e.sample HAVING count(*) = 8""",
)
def epoch_windows(t: Tables) -> DataFrame:
    samples = t("samples")
    out = E.epoch_windows(samples, samples.where("pulse = 1").select("run", "sample"), KEYS, "sample", "signal", -2, 5)
    moment = F.aggregate(F.transform("x", lambda v, i: v * (i - 2)), F.lit(0.0), lambda a, v: a + v)
    return out.select("run", "sample", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(moment, 6).alias("moment"))


_LONG = "(SELECT vec_id, y, run, i - 1 AS i, CAST(x[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM {epochs}))"


def _digest(df: DataFrame) -> DataFrame:
    """Sum and position-weighted sum of each array, which tell arrays apart."""
    x = F.transform("x", lambda v: v.cast("double"))
    return df.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 5).alias("total"), F.round(F.aggregate(F.transform(x, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v), 5).alias("moment"))


@query("baseline_correct", f"SELECT vec_id, count(*) AS n, round(sum(v - b), 5) AS total, round(sum((v - b) * i), 5) AS moment FROM (SELECT *, avg(v) FILTER (i < 16) OVER (PARTITION BY vec_id) AS b FROM {_LONG}) GROUP BY vec_id")
def baseline_correct(t: Tables) -> DataFrame:
    doubles = t("epochs").withColumn("x", F.col("x").cast("array<double>"))
    return _digest(E.baseline_correct(doubles, 16))


@query("reject_peak_to_peak", f"SELECT vec_id FROM (SELECT vec_id, floor(i / 16.0) AS c, max(v) - min(v) AS p FROM {_LONG} GROUP BY vec_id, floor(i / 16.0)) GROUP BY vec_id HAVING max(p) <= 0.6")
def reject_peak_to_peak(t: Tables) -> DataFrame:
    return E.reject_peak_to_peak(t("epochs").withColumn("x", F.col("x").cast("array<double>")), 4, 16, 0.6).select("vec_id")


_CROP = f"(SELECT vec_id, v, i, floor(i / 16.0) AS c, i % 16 AS s FROM {_LONG} WHERE i % 16 >= 2 AND (i % 16 - 2) % 3 = 0 AND i % 16 <= 12)"


@query("crop_decimate", f"SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total, round(sum(v * (c * 4 + (s - 2) / 3)), 5) AS moment FROM {_CROP} GROUP BY vec_id")
def crop_decimate(t: Tables) -> DataFrame:
    return _digest(E.flatten_features(E.crop_decimate(t("epochs"), 4, 16, -0.2, 10.0, 1.0, 3)))


@query("pick_channels", f"SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total, round(sum(v * (CASE WHEN i >= 32 THEN i - 32 ELSE i + 16 END)), 5) AS moment FROM {_LONG} WHERE i BETWEEN 0 AND 15 OR i BETWEEN 32 AND 47 GROUP BY vec_id")
def pick_channels(t: Tables) -> DataFrame:
    nested = E.crop_decimate(t("epochs"), 4, 16, 0.0, 10.0, 1.5, 1)
    return _digest(E.flatten_features(E.pick_channels(nested, ["Fz", "Cz", "Pz", "Oz"], ["Pz", "Fz"])))


@query("flatten_features", f"SELECT vec_id, count(*) AS n, round(sum(v), 5) AS total, round(sum(v * i), 5) AS moment FROM {_LONG} GROUP BY vec_id")
def flatten_features(t: Tables) -> DataFrame:
    return _digest(E.flatten_features(E.crop_decimate(t("epochs"), 4, 16, 0.0, 10.0, 1.5, 1)))


@query("mean_trace", f"SELECT y, i AS t, round(avg(v), 6) AS mean, count(*) AS n FROM {_LONG} WHERE i < 16 GROUP BY y, i")
def mean_trace(t: Tables) -> DataFrame:
    one = t("epochs").withColumn("x", F.transform(F.slice("x", 1, 16), lambda v: v.cast("double")))
    return E.mean_trace(one, ["y"]).withColumn("mean", F.round("mean", 6))


@query("channel_trace", f"SELECT y, i - 32 AS t, round(avg(v), 6) AS mean, count(*) AS n, 'c' AS channel FROM {_LONG} WHERE i BETWEEN 32 AND 47 GROUP BY y, i")
def channel_trace(t: Tables) -> DataFrame:
    """No channel ``q`` there: the fallback is taken."""
    nested = E.crop_decimate(t("epochs").withColumn("x", F.transform("x", lambda v: v.cast("double"))), 4, 16, 0.0, 10.0, 1.6, 1)
    return E.channel_trace(nested, ["y"], "abcd", "q", "c").withColumn("mean", F.round("mean", 6))


# Summaries ---------------------------------------------------------------------------------------

_FILES = "(SELECT run, (max(sample) + 1) / 256.0 AS seconds, count(*) AS events, count(*) FILTER (stim_type > 0) AS targets, avg(CAST(stim_type > 0 AS DOUBLE)) AS target_fraction, count(DISTINCT stim_code) AS codes, min(stim_code) AS min_code, max(stim_code) AS max_code FROM {samples} GROUP BY run)"


@query("file_summary", f"SELECT run, CAST(seconds AS DOUBLE) AS seconds, events, targets, round(target_fraction, 6) AS target_fraction, codes, min_code, max_code FROM {_FILES}")
def file_summary(t: Tables) -> DataFrame:
    return A.file_summary(t("samples"), 256.0).withColumn("target_fraction", F.round("target_fraction", 6))


@query("stimulus_code_counts", "SELECT run, stim_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run), 6) AS fraction FROM {samples} GROUP BY run, stim_code")
def stimulus_code_counts(t: Tables) -> DataFrame:
    return A.stimulus_code_counts(t("samples")).withColumn("fraction", F.round("fraction", 6))


_FLAGS = f"(SELECT run, 'unexpected_code_count' AS flag FROM {_FILES} WHERE codes <> 6 UNION ALL SELECT run, 'few_targets' FROM {_FILES} WHERE target_fraction < 0.25 UNION ALL SELECT run, 'no_targets' FROM {_FILES} WHERE targets = 0 UNION ALL SELECT run, 'remainder' FROM {_FILES} WHERE targets % 20 <> 0)"


@query("quality_flags", f"SELECT run, flag FROM {_FLAGS}")
def quality_flags(t: Tables) -> DataFrame:
    return A.quality_flags(A.file_summary(t("samples"), 256.0), 6, 0.25)


_CHANNELS = """(SELECT run, count(*) FILTER (channel LIKE 'EEG!_%' ESCAPE '!') AS signal_channels, count(*) FILTER (channel NOT LIKE 'EEG!_%' ESCAPE '!') AS other_channels,
    array_to_string(list_sort(list_filter(['StimulusBegin', 'StimulusType', 'StimulusCode', 'CurrentTarget'], lambda c: NOT list_contains(list(channel), c))), ', ') AS missing_events,
    coalesce(max(r), 0) AS n_rows, coalesce(max(c), 0) AS n_cols, count(DISTINCT (r, c)) FILTER (r IS NOT NULL) AS cells
    FROM (SELECT *, TRY_CAST(regexp_extract(channel, '^([A-Z])_([0-9]+)_([0-9]+)$', 2) AS INT) AS r, TRY_CAST(regexp_extract(channel, '^([A-Z])_([0-9]+)_([0-9]+)$', 3) AS INT) AS c FROM {channels}) GROUP BY run)"""


@query("channel_summary", f"SELECT *, n_rows * n_cols - cells AS missing_cells FROM {_CHANNELS}")
def channel_summary(t: Tables) -> DataFrame:
    return A.channel_summary(t("channels")).withColumn("missing_events", F.array_join("missing_events", ", "))


@query(
    "structure_flags",
    f"""SELECT run, 'missing_event_channels' AS flag, missing_events AS detail FROM {_CHANNELS} WHERE missing_events <> '' UNION ALL SELECT run, 'missing_grid_channels', '' FROM {_CHANNELS} WHERE cells = 0
        UNION ALL SELECT run, 'incomplete_grid', CAST(n_rows * n_cols - cells AS VARCHAR) FROM {_CHANNELS} WHERE n_rows * n_cols > cells""",
)
def structure_flags(t: Tables) -> DataFrame:
    return A.structure_flags(A.channel_summary(t("channels")))


@query(
    "agreement_flags",
    """WITH targets AS (SELECT run, sample, stim_code, row_number() OVER (PARTITION BY run ORDER BY sample) - 1 AS k FROM {samples} WHERE stim_type = 1),
       counts AS (SELECT run, CASE WHEN run % 2 = 0 THEN 0 ELSE CAST(floor(k / 20) AS INT) END AS block, stim_code, count(*) AS n FROM targets GROUP BY ALL),
       blocks AS (SELECT run, block, max(n) / sum(n) AS agreement, sum(n) AS size FROM counts GROUP BY run, block)
       SELECT run, CAST(block AS INT) AS block, CASE WHEN run % 2 = 0 THEN 'adaptive_currenttarget_varies' ELSE 'low_currenttarget_agreement' END AS flag, round(agreement, 6) AS agreement
       FROM blocks WHERE agreement < 0.25 AND (run % 2 = 0 OR size = 20)""",
)
def agreement_flags(t: Tables) -> DataFrame:
    """Recordings of even number are adaptive."""
    targets = t("samples").where("stim_type = 1").select("run", "sample", F.col("stim_code").alias("code"))
    return A.agreement_flags(targets, F.col("run") % 2 == 0, low=0.25).withColumn("agreement", F.round("agreement", 6))


@query("flag_summary", f"SELECT flag, count(*) AS n FROM {_FLAGS} GROUP BY flag")
def flag_summary(t: Tables) -> DataFrame:
    return A.flag_summary(A.quality_flags(A.file_summary(t("samples"), 256.0), 6, 0.25))


@query("coverage_by_study", "SELECT o_orderpriority AS study, count(*) AS files, count(DISTINCT o_custkey) AS subjects, count(DISTINCT o_orderdate) AS sessions, round(sum(o_totalprice) / 3600, 6) AS hours FROM {orders} GROUP BY o_orderpriority")
def coverage_by_study(t: Tables) -> DataFrame:
    out = A.coverage_by_study(t("orders").withColumnRenamed("o_orderpriority", "study"), "study", "o_custkey", "o_orderdate", "o_totalprice")
    return out.withColumn("hours", F.round("hours", 6))


@query(
    "inventory_by_condition",
    """SELECT c_mktsegment, c_nationkey, count(*) AS files, quantile_cont(c_acctbal, 0.5) AS median, round(sum(c_acctbal), 4) AS total, CAST(grouping(c_mktsegment, c_nationkey) AS BIGINT) AS level FROM {customer}
       GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), ())""",
)
def inventory_by_condition(t: Tables) -> DataFrame:
    return A.inventory_by_condition(t("customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal").withColumn("total", F.round("total", 4))


@query("grid_summary", "SELECT p_brand, count(DISTINCT p_size) AS layouts, quantile_cont(p_size, 0.5) AS median_cells, max(p_size) AS max_cells FROM {part} GROUP BY p_brand")
def grid_summary(t: Tables) -> DataFrame:
    return A.grid_summary(t("part"), "p_brand", "p_size")


@query("segmentation_summary", f"SELECT run, count(*) AS trials, 20.0::DOUBLE AS median_flashes, round(avg(agreement), 6) AS mean_agreement FROM {_MAJORITY} GROUP BY run")
def segmentation_summary(t: Tables) -> DataFrame:
    blocks = S.block_majority(t("samples").where("stim_type = 1"), KEYS, "sample", "stim_code").withColumn("flashes", F.lit(20))
    return A.segmentation_summary(blocks, "run", "flashes", "agreement").withColumn("mean_agreement", F.round("mean_agreement", 6))


@query("top_targets", "SELECT p_brand, p_name, n, rank FROM (SELECT p_brand, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS rank FROM {part} GROUP BY p_brand, p_name) WHERE rank <= 15")
def top_targets(t: Tables) -> DataFrame:
    return A.top_targets(t("part"), "p_brand", "p_name")


@query("compact_stats", "SELECT round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max FROM {events}")
def compact_stats(t: Tables) -> DataFrame:
    return A.compact_stats(t("events"), "value").withColumn("mean", F.round("mean", 6))


@query(
    "state_value_profile",
    """SELECT state, value, n, rank FROM (SELECT state, value, count(*) AS n, row_number() OVER (PARTITION BY state ORDER BY value) AS rank FROM (
       SELECT 'stim_type' AS state, CAST(stim_type AS BIGINT) AS value FROM {samples} UNION ALL SELECT 'stim_code', stim_code FROM {samples} UNION ALL SELECT 'signal', CAST(signal AS BIGINT) FROM {samples}) GROUP BY state, value) WHERE rank <= 10""",
)
def state_value_profile(t: Tables) -> DataFrame:
    return A.state_value_profile(t("samples"), ["stim_type", "stim_code", "signal"])
