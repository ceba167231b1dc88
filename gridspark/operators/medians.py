"""Exact medians without a task that holds all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median", accuracy: int = 10_000) -> DataFrame:
    """(*by, median): the middle value of each group, or the mean of the two middle ones; nulls are no values.

    A quantile sketch of ``accuracy`` brackets the middle: its ranks are off by at most n / accuracy, and
    the bracket is twice as wide. A second pass counts what lies below it and adds up the distinct values
    inside, some 4 n / accuracy of them, which are all that is ever ordered. Null is a group like any other.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    e = 2.0 / accuracy
    around = F.percentile_approx("_v", [0.5 - e, 0.5 + e], accuracy)
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), around.alias("_q"))
    sketch = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_n", F.col("_q")[0].alias("_low"), F.col("_q")[1].alias("_high"))
    both = rows.join(sketch, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]) if by else rows.crossJoin(F.broadcast(sketch))  # one row
    # values below the bracket count together, those inside one by one, those above not at all
    inside = both.where(F.col("_v") <= F.col("_high")).withColumn("_v", F.when(F.col("_v") >= F.col("_low"), F.col("_v")))
    counts = inside.groupBy(*by, "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.asc_nulls_first("_v")))
    at = counts.withColumn("_to", upto).where("_v is not null")
    first = F.min(F.when(F.col("_to") >= F.expr("(_n + 1) div 2"), F.col("_v")))
    second = F.min(F.when(F.col("_to") >= F.expr("_n div 2 + 1"), F.col("_v")))
    return at.groupBy(*by).agg((first * 0.5 + second * 0.5).alias(name))


def with_medians(out: DataFrame, df: DataFrame, by: Sequence[str], **values: str) -> DataFrame:
    """``out``, a summary of ``df`` by the same keys, with a median (name=column) added for each of ``values``."""
    for name, value in values.items():
        found = medians(df, by, value, name).select(*[F.col(k).alias(f"_k_{k}") for k in by], name)
        out = out.join(found, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], "left").drop(*[f"_k_{k}" for k in by]) if by else out.join(F.broadcast(found), how="left")  # one row each
    return out
