"""Null profiles and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.nulls import holds

MISSING_LINE = 30.0


def missing(df: DataFrame, column: str):
    gone = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        gone = gone | F.isnan(column)
    return gone


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: missing cells, rows, share in percent; NaN counts as missing."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("n_missing"),
                 F.count(F.lit(1)).alias("n_rows"))
        for c in df.columns
    ]
    return (
        df.agg(F.array(*cells).alias("_cells"))
        .select(F.inline("_cells"))
        .withColumn("missing_percent", F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")))
    )


def missing_ranked(df: DataFrame, threshold: float = MISSING_LINE) -> DataFrame:
    """Columns with missing cells, most missing first; ``over_threshold`` marks those above the line."""
    return (
        null_profile(df)
        .where(F.col("n_missing") > 0)
        .withColumn("over_threshold", F.col("missing_percent") > threshold)
        .orderBy(F.desc("missing_percent"), "column")
    )


def total_missing(df: DataFrame) -> DataFrame:
    return null_profile(df).agg(F.sum("n_missing").alias("total_missing"))


def anomaly_summary(df: DataFrame, keys: Sequence[str], flag: str, digits: int = 4) -> DataFrame:
    """Rows, flagged rows and their share in percent per key, rounded half to even."""
    count = F.count_if(holds(F.col(flag)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        count.alias("anomalies"),
        F.bround(count / F.count(F.lit(1)) * 100, digits).alias("percentage"),
    )


def contract_nulls(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Missing cells in columns that must be filled; an absent column is missing in every row."""
    present = [c for c in required if c in df.columns]
    absent = [c for c in required if c not in df.columns]
    counted = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(True).alias("present"), F.count_if(missing(df, c)).alias("n_missing"))
        for c in present
    ], *[
        F.struct(F.lit(c).alias("column"), F.lit(False).alias("present"), F.count(F.lit(1)).alias("n_missing"))
        for c in absent
    ]).alias("_cells"))
    return counted.select(F.inline("_cells"))
