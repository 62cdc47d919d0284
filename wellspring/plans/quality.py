"""The quality report of a table as rows (check, column, metric, value), made in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import has_column
from wellspring.operators.combination_rules import combination_flag, flag_combinations, skipped_rules
from wellspring.operators.profile import missing
from wellspring.operators.validation import RANGES, missing_columns, suspicious_triple
from wellspring.sources.writers import write_report_json

FLAG = "Feature_Inconsistency"
TRIPLE = ["Fluid_Type", "Formation_Type", "Completion_Type"]


def _share(count: Column) -> Column:
    return F.bround(F.try_divide(count, F.count(F.lit(1))) * 100, 2)


def quality_report(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> tuple[DataFrame, DataFrame]:
    """(rows with the flag ``Feature_Inconsistency``, report). Checks whose columns are absent are left out."""
    gaps = {c: F.count_if(missing(df, c)) for c in df.columns}
    cells: list[tuple[str, str | None, str, Column]] = [
        ("missing_values", None, "total", sum(gaps.values(), F.lit(0))),
        *[("missing_values", c, "missing", n) for c, n in gaps.items()],
    ]
    for c, (low, high) in ranges.items():
        if has_column(df, c):
            cells += [("value_range_violations", c, "below_min", F.count_if(F.col(c) < low)),
                      ("value_range_violations", c, "above_max", F.count_if(F.col(c) > high))]
    if not missing_columns(df, TRIPLE):
        odd = F.count_if(suspicious_triple(*TRIPLE))
        cells += [("logical_inconsistencies", None, "suspicious_combinations_count", odd),
                  ("logical_inconsistencies", None, "suspicious_percentage", _share(odd))]
    hit = F.count_if(combination_flag(df))
    cells += [("feature_inconsistencies", None, "total", hit), ("feature_inconsistencies", None, "percentage", _share(hit)),
              ("feature_inconsistencies", None, "skipped_rules", F.lit(len(skipped_rules(df))))]
    report = df.agg(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"), F.lit(metric).alias("metric"),
                 value.cast("double").alias("value"))
        for check, column, metric, value in cells
    ]).alias("_cells")).select(F.inline("_cells"))
    return flag_combinations(df, FLAG), report


def save_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_report_json(report.repartition(1), path, mode)
