"""Rows that occur more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row; nulls count as equal. Copies are merged before the shuffle."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows before, distinct rows, rows removed."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_removed"),
    )
