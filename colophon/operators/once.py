"""Columns that the optimizer does not copy into filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A filter on a plain computed column moves below the projection with the whole
    expression in place of the name, so it is evaluated again, once per mention.
    No filter moves below a generator.
    """
    rows = df.select("*", F.explode(F.array(F.struct(*columns))).alias("once"))
    return rows.select(*df.columns, "once.*")
