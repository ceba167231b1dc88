"""Data set summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .medians import medians, with_medians
from .signal import block_majority, classify_channels


def file_summary(samples: DataFrame, sfreq: float, run: str = "run", order: str = "sample", type_col: str = "stim_type", code_col: str = "stim_code") -> DataFrame:
    """Duration, events, targets and codes of each recording, in one pass."""
    return samples.groupBy(run).agg(
        ((F.max(order) + 1) / sfreq).alias("seconds"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col(type_col) > 0).alias("targets"),
        F.avg((F.col(type_col) > 0).cast("double")).alias("target_fraction"),
        F.countDistinct(code_col).alias("codes"),
        F.min(code_col).alias("min_code"),
        F.max(code_col).alias("max_code"),
    )


def stimulus_code_counts(events: DataFrame, run: str = "run", code: str = "stim_code") -> DataFrame:
    counts = events.groupBy(run, code).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(run)))


def quality_flags(files: DataFrame, n_codes: int, low_fraction: float = 0.1, block: int = 20, run: str = "run") -> DataFrame:
    """One row per recording and problem, found in one pass over the summary."""
    tests = [
        ("no_events", F.col("events") == 0),
        ("unexpected_code_count", F.col("codes") != n_codes),
        ("few_targets", F.col("target_fraction") < low_fraction),
        ("no_targets", F.col("targets") == 0),
        ("remainder", F.col("targets") % block != 0),
    ]
    flags = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())
    return files.select(run, F.explode(flags).alias("flag"))


#: Event channels that a recording must have.
EVENT_CHANNELS = ("StimulusBegin", "StimulusType", "StimulusCode", "CurrentTarget")


def channel_summary(channels: DataFrame, event_channels: Sequence[str] = EVENT_CHANNELS, run: str = "run", col: str = "channel") -> DataFrame:
    """Per recording: signal and other channels, which event channels are missing, and its grid's rows,
    columns, cells and missing cells, from one row a channel in one pass."""
    kinds = classify_channels(channels.select(run, col).distinct(), col)
    cell = F.when(F.col("kind") == "grid", F.struct("row", "col"))
    out = kinds.groupBy(run).agg(
        F.count_if(F.col("kind") == "signal").alias("signal_channels"),
        F.count_if(F.col("kind") != "signal").alias("other_channels"),
        F.array_sort(F.array_except(F.array(*[F.lit(c) for c in event_channels]), F.collect_set(F.when(F.col(col).isin(list(event_channels)), F.col(col))))).alias("missing_events"),
        F.coalesce(F.max("row"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.max("col"), F.lit(0)).alias("n_cols"),
        F.countDistinct(cell).alias("cells"),
    )
    return out.withColumn("missing_cells", F.col("n_rows") * F.col("n_cols") - F.col("cells"))


def structure_flags(summary: DataFrame, run: str = "run") -> DataFrame:
    """One row per recording and problem of its channels: (run, flag, detail)."""
    tests = [
        ("missing_event_channels", F.size("missing_events") > 0, F.array_join("missing_events", ", ")),
        ("missing_grid_channels", F.col("cells") == 0, F.lit("")),
        ("incomplete_grid", F.col("missing_cells") > 0, F.col("missing_cells").cast("string")),
    ]
    flags = F.filter(F.array(*[F.when(test, F.struct(F.lit(name).alias("flag"), detail.alias("detail"))) for name, test, detail in tests]), lambda x: x.isNotNull())
    return summary.select(run, F.inline(flags))


def agreement_flags(targets: DataFrame, adaptive: Column, run: str = "run", order: str = "sample", code: str = "code", block: int = 20, low: float = 0.8) -> DataFrame:
    """Blocks of target flashes whose codes agree too little: (run, block, flag, agreement).

    A fixed recording is cut into whole blocks (``low_currenttarget_agreement``); an ``adaptive`` one is
    one block of any size, whose targets are known to change (``adaptive_currenttarget_varies``).
    """
    marked = targets.withColumn("_adaptive", adaptive)
    fixed = block_majority(marked.where(~F.col("_adaptive")), [run], order, code, block, low).select(run, "block", "agreement")
    counts = marked.where("_adaptive").groupBy(run, code).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.groupBy(run).agg((F.max("_n") / F.sum("_n")).alias("agreement")).select(run, F.lit(0).alias("block"), "agreement")
    both = fixed.withColumn("flag", F.lit("low_currenttarget_agreement")).unionByName(whole.withColumn("flag", F.lit("adaptive_currenttarget_varies")))
    return both.where(F.col("agreement") < low).select(run, "block", "flag", "agreement")


def coverage_by_study(files: DataFrame, study: str, subject: str, session: str, seconds: str) -> DataFrame:
    return files.groupBy(study).agg(F.count(F.lit(1)).alias("files"), F.countDistinct(subject).alias("subjects"), F.countDistinct(session).alias("sessions"), (F.sum(seconds) / 3600).alias("hours"))


def inventory_by_condition(files: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts, medians and totals per group and for the whole (keys null), by one rollup."""
    out = files.rollup(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum(value).alias("total"), F.grouping_id().alias("level"))
    out = out.where(F.col("level").isin(0, (1 << len(keys)) - 1))
    middle = medians(files, keys, value).withColumn("level", F.lit(0)).unionByName(medians(files, [], value).withColumn("level", F.lit((1 << len(keys)) - 1)), allowMissingColumns=True)
    middle = middle.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("level").alias("_k_level"), "median")
    same = [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("level") == F.col("_k_level")]
    return out.join(middle, same, "left").select(*keys, "files", "median", "total", "level")


def grid_summary(files: DataFrame, study: str, cells: str) -> DataFrame:
    out = files.groupBy(study).agg(F.countDistinct(cells).alias("layouts"), F.max(cells).alias("max_cells"))
    return with_medians(out, files, [study], median_cells=cells)


def segmentation_summary(trials: DataFrame, study: str, flashes: str, agreement: str) -> DataFrame:
    out = trials.groupBy(study).agg(F.count(F.lit(1)).alias("trials"), F.avg(agreement).alias("mean_agreement"))
    return with_medians(out, trials, [study], median_flashes=flashes)


def top_targets(trials: DataFrame, study: str, label: str, k: int = 15) -> DataFrame:
    counts = trials.groupBy(study, label).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(study).orderBy(F.desc("n"), label)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def flag_summary(flags: DataFrame, flag: str = "flag") -> DataFrame:
    return flags.groupBy(flag).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), flag)


def compact_stats(df: DataFrame, col: str) -> DataFrame:
    return with_medians(df.agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max")), df, [], median=col)


def state_value_profile(samples: DataFrame, states: Sequence[str], keep: int = 10) -> DataFrame:
    """Distinct values of each state column: how many, and the least ``keep``."""
    long = samples.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).cast("long").alias("value")) for s in states])).alias("_s"))
    counts = long.groupBy("_s.state", "_s.value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("state").orderBy("value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= keep)
