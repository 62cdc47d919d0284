"""Feature columns of a processing run, label encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import has_column, holds, number
from wellspring.operators.keyed import attach_by_key
from wellspring.operators.ordered import global_index

EPSILON = 1e-6


def pt_ratio(pressure: str = "Pressure_psi", temperature: str = "Temperature_C") -> Column:
    return F.try_divide(F.col(pressure).cast("double"), F.col(temperature) + EPSILON)


def flow_efficiency(flow: str = "Flow_Rate_bbl_day", permeability: str = "Permeability_mD",
                    porosity: str = "Porosity_pct") -> Column:
    return F.try_divide(F.col(flow).cast("double") * 100, F.col(permeability) * F.col(porosity) + EPSILON)


def indicator(column: str, value: str) -> Column:
    return F.when(holds(F.col(column) == value), 1).otherwise(0)


# Each feature: name, columns it needs, expression, whether it is one of the formation features.
FEATURES = [
    ("PT_Ratio", ["Pressure_psi", "Temperature_C"], pt_ratio, False),
    ("Flow_Efficiency", ["Flow_Rate_bbl_day", "Permeability_mD", "Porosity_pct"], flow_efficiency, False),
    ("Carbonate_Flag", ["Formation"], lambda: indicator("Formation", "Carbonate"), True),
    ("Sandstone_Flag", ["Formation"], lambda: indicator("Formation", "Sandstone"), True),
]


def add_features(df: DataFrame, formation_features: bool = True) -> tuple[DataFrame, list[str]]:
    """Add every feature whose columns are present; returns the names that were added."""
    made = {
        name: expression() for name, needs, expression, formation in FEATURES
        if all(has_column(df, c) for c in needs) and (formation_features or not formation)
    }
    return (df.withColumns(made) if made else df), list(made)


def encode_label(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Index of each label in sorted order, from 0; null stays null. Only the distinct labels are sorted."""
    return attach_by_key(df, label_index(df, column, name or f"{column}_index"), [column])


def label_index(df: DataFrame, column: str, name: str = "label_index") -> DataFrame:
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return global_index(labels, [column], name)


def decode_label(df: DataFrame, index_column: str, labels: DataFrame, name: str) -> DataFrame:
    """Text of a label index; ``labels`` comes from ``label_index``."""
    text, index = labels.columns
    table = labels.select(F.col(index).cast("double").alias("_index"), F.col(text).alias(name))
    indexed = df.withColumn("_index", F.col(index_column).cast("double"))
    return attach_by_key(indexed, table, ["_index"]).drop("_index")


def standard_scale(df: DataFrame, columns: Sequence[str], ending: str = "_scaled") -> DataFrame:
    """(x - mean) / population deviation; 0 for a constant column. NaN counts as unknown and gives null."""
    row = df.agg(*[f(number(F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = {}
    for c in columns:
        mean, std = row[f"{c}_m"], row[f"{c}_s"]
        spread = F.lit(std if std else 1.0)
        scaled[f"{c}{ending}"] = (number(F.col(c)) - F.lit(mean).cast("double")) / spread
    return df.withColumns(scaled)
