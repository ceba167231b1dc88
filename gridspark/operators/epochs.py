"""Windows of samples around events, and features from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_windows(samples: DataFrame, events: DataFrame, keys: Sequence[str], order: str, value: str, low: int, high: int) -> DataFrame:
    """The values from ``low`` to ``high`` samples around each event, as an array in order.

    Samples are packed into arrays of consecutive ones, at least two windows long; an event meets the
    one or two arrays that its window lies in, and takes its part of them. Events whose window is cut
    off by the recording's ends, or has a gap, are dropped, together with their other columns.
    """
    size = max(2 * (high - low + 1), 64)
    packed = samples.groupBy(*keys, F.floor(F.col(order) / size).alias("_b")).agg(F.collect_list(F.struct(F.col(order).alias("_at"), F.col(value).alias("_v"))).alias("_s"))
    on = F.col("_on")
    spans = F.sequence(F.floor((on + low) / size), F.floor((on + high) / size))
    need = events.withColumn("_on", F.col(order)).withColumn("_b", F.explode(spans))
    own = F.filter("_s", lambda s: (s["_at"] >= on + low) & (s["_at"] <= on + high))
    got = need.join(packed, [*keys, "_b"]).withColumn("_part", own)
    rest = [c for c in events.columns if c not in (*keys, order)]
    out = got.groupBy(*keys, "_on").agg(F.array_sort(F.flatten(F.collect_list("_part"))).alias("_w"), *[F.first(c).alias(c) for c in rest])
    out = out.where(F.size("_w") == high - low + 1)
    return out.select(*keys, F.col("_on").alias(order), *rest, F.transform("_w", lambda s: s["_v"]).alias("x"))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def baseline_correct(epochs: DataFrame, n_before: int, col: str = "x") -> DataFrame:
    """Subtract the mean of the first ``n_before`` samples."""
    base = epochs.withColumn("_base", _mean(F.slice(col, 1, n_before)))
    return base.withColumn(col, F.transform(col, lambda v: v - F.col("_base"))).drop("_base")


def _channel(col: str, k: int, length: int) -> Column:
    return F.slice(col, k * length + 1, length)


def reject_peak_to_peak(epochs: DataFrame, channels: int, length: int, most: float = 150.0, col: str = "x") -> DataFrame:
    """Epochs whose range stays within ``most`` on every channel (channel-major values)."""
    spans = [F.array_max(_channel(col, k, length)) - F.array_min(_channel(col, k, length)) for k in range(channels)]
    return epochs.where((F.greatest(*spans) if channels > 1 else spans[0]) <= most)


def crop_decimate(epochs: DataFrame, channels: int, length: int, tmin: float, sfreq: float, window_s: float, decim: int, col: str = "x") -> DataFrame:
    """Keep samples at times from 0 to ``window_s``, every ``decim``-th; an array per channel."""
    inside = [i for i in range(length) if -1e-12 <= tmin + i / sfreq <= window_s + 1e-8][::decim]
    keep = F.array(*[F.lit(i) for i in inside])

    def cut(k: int) -> Column:
        return F.transform(keep, lambda i: F.get(F.col(col), i + k * length))

    return epochs.withColumn(col, F.array(*[cut(k) for k in range(channels)]))


def pick_channels(epochs: DataFrame, have: Sequence[str], names: Sequence[str], col: str = "x") -> DataFrame:
    """The named channels, in the order named; a missing one is an error."""
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"no such channels: {missing}")
    return epochs.withColumn(col, F.array(*[F.get(F.col(col), F.lit(list(have).index(n))) for n in names]))


def flatten_features(epochs: DataFrame, col: str = "x") -> DataFrame:
    return epochs.withColumn(col, F.flatten(col))


def mean_trace(epochs: DataFrame, keys: Sequence[str], col: str = "x") -> DataFrame:
    """Average value at each sample over the epochs of a key."""
    rows = epochs.select(*keys, F.posexplode(col).alias("t", "v"))
    return rows.groupBy(*keys, "t").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def channel_trace(epochs: DataFrame, keys: Sequence[str], have: Sequence[str], channel: str | None = None, fallback: str = "Pz", col: str = "x") -> DataFrame:
    """``mean_trace`` of one channel of nested epochs: the one asked for, else the fallback, else the first."""
    name = next((c for c in (channel, fallback) if c in have), have[0])
    one = epochs.withColumn(col, F.get(F.col(col), F.lit(list(have).index(name))))
    return mean_trace(one, keys, col).withColumn("channel", F.lit(name))
