"""As-of sums: what had come before a position, without one task holding a key's whole history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65_536


def sum_before(rows: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Add columns: for each row, the sum of ``sums`` over rows of its keys with a lesser ``order``.

    ``order`` is an integer that is never null. Positions are cut into spans: span totals give what
    earlier spans hold, and a window inside the span the rest, so a key with very many rows is spread
    over as many tasks as it has spans.
    """
    cut = rows.withColumn("_span", F.expr(f"`{order}` div {span}"))
    within = Window.partitionBy(*keys, "_span").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    part = {f"_in_{c}": F.coalesce(F.sum(v).over(within), F.lit(0)) for c, v in sums.items()}
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_span").agg(*[F.sum(v).alias(f"_all_{c}") for c, v in sums.items()])
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_span").alias("_k_span"), *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    out = cut.withColumns(part).join(totals, [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_span") == F.col("_k_span")])
    return out.select(*rows.columns, *[(F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(c) for c in sums])
