"""Segmentation of time series: edges, sequences, runs, blocks, masks.

``keys`` are the columns that identify a recording, ``order`` its sample number. All running
windows of a recording share one partitioning and sort, so chained operators shuffle once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .medians import with_medians

Keys = Sequence[str]


def _over(keys: Keys, order: str | Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def classify_channels(channels: DataFrame, col: str = "channel") -> DataFrame:
    """Kind of each channel: ``EEG_*`` is signal; ``label_row_col``, read from the right, is a grid cell."""
    pattern = r"^(.*)_([0-9]+)_([0-9]+)$"
    c = F.col(col)
    cell = c.rlike(pattern)
    kind = F.when(c.startswith("EEG_"), "signal").when(cell, "grid").otherwise("state")
    part = lambda k: F.when((kind == "grid"), F.regexp_extract(c, pattern, k))
    return channels.select(*channels.columns, kind.alias("kind"), part(1).alias("label"), part(2).cast("int").alias("row"), part(3).cast("int").alias("col"))


def grid_dims(grid: DataFrame, keys: Keys = ()) -> DataFrame:
    """Rows, columns and missing cells of each layout."""
    distinct = F.countDistinct("row", "col")
    return grid.groupBy(*keys).agg(F.max("row").alias("n_rows"), F.max("col").alias("n_cols"), (F.max("row") * F.max("col") - distinct).alias("missing"))


def fir_filter(samples: DataFrame, taps: Sequence[float], keys: Keys, order: str, value: str, chunk: int = 65_536) -> DataFrame:
    """Zero-phase filter with symmetric taps; edges are padded with the first and last value.

    A recording is cut into chunks of samples. Each chunk gets the samples that its convolution
    reaches over from its neighbours, so a long recording spreads over many tasks. Samples are
    numbered from 0 without gaps.
    """
    half = len(taps) // 2
    if len(taps) % 2 == 0:
        raise ValueError("give an odd number of taps")
    weights = np.asarray(taps, float)
    at, c = F.col(order), (F.floor(F.col(order) / chunk)).cast("long")
    near = F.array_distinct(F.array(F.floor((at - half) / chunk), F.floor((at + half) / chunk), c))
    if half > chunk:
        raise ValueError("chunks must be longer than half the taps")
    copies = samples.select(*keys, order, F.col(value).cast("double").alias("_v"), c.alias("_own"), F.explode(near).alias("_chunk"))
    schema = T.StructType([*[samples.schema[k] for k in keys], samples.schema[order], T.StructField("filtered", T.DoubleType())])

    def convolve(table: pa.Table) -> pa.Table:
        at = table[order].to_numpy()
        s = np.argsort(at)
        v = table["_v"].to_numpy(zero_copy_only=False)[s]
        out = np.convolve(np.pad(v, half, mode="edge"), weights, "valid")
        own = (table["_own"].to_numpy() == table["_chunk"].to_numpy())[s]
        cols = {k: table[k].take(pa.array(s[own])) for k in [*keys, order]}
        return pa.table({**cols, "filtered": out[own]})

    return copies.groupBy(*keys, "_chunk").applyInArrow(convolve, schema)


def rising_edges(samples: DataFrame, keys: Keys, order: str, value: str, threshold: float | None = None) -> DataFrame:
    """Samples where the value crosses the threshold upward; without one, the middle of each recording's range."""
    x = F.col(value)
    if threshold is None:
        whole = Window.partitionBy(*keys)
        thr = (F.min(value).over(whole) + F.max(value).over(whole)) / 2
    else:
        thr = F.lit(threshold)
    marked = samples.withColumn("_prev", F.lag(value).over(_over(keys, order))).withColumn("_thr", thr)
    return marked.where((F.col("_prev") <= F.col("_thr")) & (x > F.col("_thr"))).drop("_prev", "_thr")


def sample_at_edges(edges: DataFrame, type_col: str = "stim_type", code_col: str = "stim_code") -> DataFrame:
    """Label and code of each event, read from the state columns at its edge."""
    return edges.withColumn("y", (F.col(type_col) > 0.5).cast("int")).withColumn("code", F.rint(F.col(code_col)).cast("int"))


def pulse_edges(samples: DataFrame, keys: Keys, order: str, value: str) -> DataFrame:
    """Samples where the value goes from zero to something else."""
    marked = samples.withColumn("_prev", F.lag(value).over(_over(keys, order)))
    return marked.where((F.col("_prev") == 0) & (F.col(value) != 0)).drop("_prev")


def asof_char_index(events: DataFrame, pulses: DataFrame, keys: Keys, order: str, n_chars: int | None = None) -> DataFrame:
    """For each event the number of pulses at or before it; at or past ``n_chars`` it is -1.

    Events and pulses are stacked and counted in one running window, so no range join is needed.
    """
    rows = events.withColumn("_pulse", F.lit(0)).unionByName(pulses.select(*keys, order).withColumn("_pulse", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("_pulse").over(upto).cast("int")
    index = n if n_chars is None else F.when(F.col("_n") >= n_chars, -1).otherwise(F.col("_n"))
    out = rows.withColumn("_n", n)
    return out.withColumn("char_idx", F.col("_n") if n_chars is None else index).where("_pulse = 0").drop("_pulse", "_n")


def sequence_in_char(events: DataFrame, flashes_per_seq: int, keys: Keys = ("run", "char_idx"), order: str = "ord") -> DataFrame:
    k = F.row_number().over(_over(keys, order)) - 1
    return events.withColumn("sequence_in_char", (F.floor(k / flashes_per_seq) + 1).cast("int"))


def fixed_sequence_index(events: DataFrame, flashes_per_seq: int, seqs_per_char: int = 10, keys: Keys = ("run",), order: str = "ord", strict: bool = True) -> DataFrame:
    """Character (0-based) and sequence (1-based) from the flash order; incomplete sequences raise."""
    k = F.row_number().over(_over(keys, order)) - 1
    out = events.withColumn("_k", k)
    if strict:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        out = out.withColumn("_k", F.when(n % flashes_per_seq == 0, F.col("_k")).otherwise(F.raise_error(F.lit("a recording is no whole number of sequences")).cast("int")))
    s = F.floor(F.col("_k") / flashes_per_seq)
    return out.withColumn("fixed_char", F.floor(s / seqs_per_char).cast("int")).withColumn("fixed_seq", (s % seqs_per_char + 1).cast("int")).drop("_k")


def equal_runs(events: DataFrame, keys: Keys, order: str, code: str) -> DataFrame:
    """Runs of equal consecutive codes: number, code, first place and length."""
    w = _over(keys, order)
    new = F.coalesce((F.lag(code).over(w) != F.col(code)).cast("int"), F.lit(1))
    islands = events.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "run_no").agg(F.first(code).alias(code), F.min(order).alias("first"), F.count(F.lit(1)).alias("length"))


def block_majority(events: DataFrame, keys: Keys, order: str, code: str, block: int = 20, low: float = 0.9) -> DataFrame:
    """Most frequent code of each whole block (ties: the code seen first), agreement, and a flag if low."""
    k = F.row_number().over(_over(keys, order)) - 1
    placed = events.select(*keys, code, k.alias("_k")).withColumn("block", F.floor(F.col("_k") / block).cast("int"))
    counts = placed.groupBy(*keys, "block", code).agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    best = F.max(F.struct("_n", (-F.col("_first")).alias("_first"), F.col(code).alias("code")))
    out = counts.groupBy(*keys, "block").agg(best.alias("_b"), F.sum("_n").alias("size")).where(F.col("size") == block)
    agreement = F.col("_b._n") / F.lit(float(block))
    return out.select(*keys, "block", F.col("_b.code").alias("code"), agreement.alias("agreement"), (agreement < low).alias("low_agreement"))


def codes_to_text(codes: DataFrame, grid: DataFrame, keys: Keys, order: str, code: str = "code") -> DataFrame:
    """Labels of the codes in order, as one text per key; an unknown code shows as ``[code]``."""
    named = codes.join(grid.select(F.col("code").alias("_c"), F.col("label").alias("_l")), F.col(code) == F.col("_c"), "left")
    label = F.coalesce("_l", F.concat(F.lit("["), F.col(code).cast("string"), F.lit("]")))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("l"))))
    return named.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["l"]), "").alias("text"))


def detect_group_flash(events: DataFrame, shape: tuple[int, int], keys: Keys = ("run",), code: str = "stim_code") -> DataFrame:
    """Recordings whose codes go beyond rows and columns flash free groups."""
    return events.groupBy(*keys).agg(F.max(code).alias("max_code")).withColumn("group_flash", F.col("max_code") > sum(shape))


def segmentation_mode(runs: DataFrame) -> DataFrame:
    """How each recording is cut, from (adaptive, group_flash, has_pulse)."""
    pulses = F.col("adaptive") | (F.col("group_flash") & F.col("has_pulse"))
    return runs.withColumn("mode", F.when(pulses, "pulses").when(F.col("group_flash"), "equal_runs").otherwise("fixed_blocks"))


def lit_masks(cells: DataFrame, events: DataFrame, keys: Keys, order: str, n_cells: int, window: int = 8) -> DataFrame:
    """For each event the cells that light up within ``window`` samples from its onset, as a 0/1 text.

    ``cells`` has (keys, order, cell_idx, lit). Both sides carry the number of their window of
    samples, so the range join is an equi-join on two neighbouring windows.
    """
    bucket = lambda x: F.floor(x / window)
    on = events.select(*keys, F.col(order).alias("_on"), F.explode(F.array(bucket(F.col(order)), bucket(F.col(order)) + 1)).alias("_b"))
    lit = cells.where("lit > 0").select(*keys, F.col(order).alias("_at"), "cell_idx", bucket(F.col(order)).alias("_b"))
    hits = on.join(lit, [*keys, "_b"]).where((F.col("_at") >= F.col("_on")) & (F.col("_at") < F.col("_on") + window))
    found = hits.groupBy(*keys, "_on").agg(F.collect_set("cell_idx").alias("_lit")).withColumnRenamed("_on", order)
    out = events.join(found, [*keys, order], "left")
    bits = F.transform(F.sequence(F.lit(0), F.lit(n_cells - 1)), lambda i: F.when(F.array_contains(F.coalesce("_lit", F.array().cast("array<int>")), i), "1").otherwise("0"))
    return out.withColumn("lit_mask", F.array_join(bits, "")).drop("_lit")


def validate_lit_masks(events: DataFrame, shape: tuple[int, int], keys: Keys = ("run",)) -> DataFrame:
    """Is the number of lit cells the same for all flashes, not zero, and a divisor of the grid?"""
    n = F.length(F.replace("lit_mask", F.lit("0"), F.lit("")))
    out = events.groupBy(*keys).agg(F.min(n).alias("least"), F.max(n).alias("most"))
    cells = shape[0] * shape[1]
    return out.withColumn("valid", (F.col("least") == F.col("most")) & (F.col("least") > 0) & (F.lit(cells) % F.greatest(F.col("least"), F.lit(1)) == 0))


def sequence_coverage(events: DataFrame, flashes_per_seq: int, keys: Keys = ("run",), times: int = 1, min_perfect: float = 0.95) -> DataFrame:
    """Per recording: sequences, those with all flashes, those that light every cell ``times`` times."""
    seq = [*keys, "char_idx", "seq_idx"]
    flashes = events.groupBy(*seq).agg(F.count(F.lit(1)).alias("n"))
    lit = events.select(*seq, F.posexplode(F.split("lit_mask", "")).alias("cell", "bit")).where("bit <> ''")
    cells = lit.groupBy(*seq, "cell").agg(F.sum(F.col("bit").cast("int")).alias("k")).groupBy(*seq).agg(F.min("k").alias("low"), F.max("k").alias("high"))
    out = flashes.join(cells, seq).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.count_if(F.col("n") == flashes_per_seq).alias("complete"),
        F.count_if((F.col("n") == flashes_per_seq) & (F.col("low") == times) & (F.col("high") == times)).alias("perfect"),
    )
    return out.withColumn("ok", F.col("perfect") >= min_perfect * F.col("sequences"))


def median_interval(events: DataFrame, sfreq: float, keys: Keys = ("run",), order: str = "sample") -> DataFrame:
    gaps = events.withColumn("_gap", F.col(order) - F.lag(order).over(_over(keys, order)))
    out = with_medians(gaps.select(*keys).distinct(), gaps, keys, _median="_gap")
    return out.select(*keys, (F.col("_median") / sfreq).alias("median_interval"))


def layout_consistency(grid: DataFrame, study: str, keys: Keys) -> DataFrame:
    """Number of different layouts per study; more than one is not consistent."""
    cells: Column = F.array_sort(F.collect_set(F.struct("row", "col", "label")))
    layouts = grid.groupBy(study, *keys).agg(F.to_json(cells).alias("layout"))
    return layouts.groupBy(study).agg(F.countDistinct("layout").alias("layouts")).withColumn("consistent", F.col("layouts") == 1)
