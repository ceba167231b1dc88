"""Temperatures that make scores calibrated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, logit_to_prob
from ..sources.scratch import written
from .posterior import log_softmax_at


def temperature_nll(df: DataFrame, temperatures: list[float], logit: str = "logit", y: str = "y", eps: float = 1e-12) -> DataFrame:
    """Mean binary loss at each temperature, all in one pass."""
    each = df.select(F.col(logit).alias("_z"), F.col(y).alias("_y"), F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature"))
    p = clip(logit_to_prob(F.col("_z") / F.col("temperature")), eps, 1 - eps)
    return each.groupBy("temperature").agg(F.avg(F.when(F.col("_y") == 1, -F.log(p)).otherwise(-F.log1p(-p))).alias("nll"))


def sequence_temperature_nll(sequences: DataFrame, temperatures: list[float]) -> DataFrame:
    """Mean row and column softmax loss at each temperature (``rows``, ``cols``, ``true_row``, ``true_col``)."""
    each = sequences.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))

    def loss(axis: str):
        scores = F.transform(axis + "s", lambda v: v / F.col("temperature"))
        return -log_softmax_at(scores, F.col("true_" + axis))

    return each.groupBy("temperature").agg(((F.avg(loss("row")) + F.avg(loss("col"))) / 2).alias("nll"))


def _search(measure, lo: float, hi: float, points: int = 9, rounds: int = 6) -> tuple[float, float]:
    """Least value of a function of log T on a shrinking grid; one pass over the data a round."""
    best = (math.inf, 0.0)
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        found = [r["nll"] for r in measure([math.exp(g) for g in grid]).orderBy("temperature").collect()]
        at = min(range(points), key=lambda i: found[i])
        best = min(best, (found[at], grid[at]))
        lo, hi = grid[max(at - 1, 0)], grid[min(at + 1, points - 1)]
    return math.exp(best[1]), best[0]


def fit_temperature(df: DataFrame, lo: float = -4, hi: float = 4, logit: str = "logit", y: str = "y") -> tuple[float, float]:
    """(temperature, loss) with the least mean binary loss of logits / T, log T in [lo, hi]."""
    return _search(lambda ts: temperature_nll(df, ts, logit, y), lo, hi)


def fit_sequence_temperature(sequences: DataFrame, lo: float = -4, hi: float = 4) -> tuple[float, float]:
    """(temperature, loss) with the least mean row and column loss. The sequences are made once: each round reads their scores and targets."""
    sequences = written(sequences.select("rows", "cols", "true_row", "true_col"), "sequences")
    return _search(lambda ts: sequence_temperature_nll(sequences, ts), lo, hi)
