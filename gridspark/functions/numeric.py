"""Numeric column expressions: clips, gates, rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def safe_int(x: Column) -> Column:
    """Nearest integer (half to even); NaN, infinities and null become 0."""
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(odd, F.lit(0)).otherwise(F.rint(x)).cast("long")


def prob_to_logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q) - F.log1p(-q)


def logit_to_prob(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def soft_gate(x: Column, mid: float, sharp: float) -> Column:
    return 1 / (1 + F.exp(-sharp * (x - mid)))


def sufficiency_gate(tokens: Column, mid: float = 15, sharp: float = 0.2) -> Column:
    return soft_gate(tokens.cast("double"), mid, sharp)


def subject_weight(n: Column, min_phrases: float = 10) -> Column:
    return F.least(F.lit(1.0), n / F.lit(float(min_phrases)))


def itr(n: int, accuracy: Column, seconds: Column) -> Column:
    """Wolpaw bits a minute for ``n`` choices, not below zero; no time gives 0."""
    p = accuracy
    bits = math.log2(n) + p * F.log2(p) + (1 - p) * F.log2((1 - p) / (n - 1))
    bits = F.when(p >= 1, F.lit(math.log2(n))).when(p <= 0, F.lit(0.0)).otherwise(bits)
    return F.when((seconds > 0) & (bits > 0), bits * 60 / seconds).otherwise(0.0)


def wpm(seconds_per_char: Column) -> Column:
    return F.when(seconds_per_char > 0, 60 / seconds_per_char / 5).otherwise(0.0)


def wpm_from_itr(rate: Column) -> Column:
    return rate / 5
