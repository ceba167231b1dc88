"""Checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parameter_table(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table of parameters, sent to all tasks; one with more than ``most`` rows is an error.

    Sweeps and arms meet every row with every parameter, so the table must be small by nature;
    the check makes sure of it.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a parameter table has more than {most} rows")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
