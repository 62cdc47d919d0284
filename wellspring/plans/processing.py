"""A processing run: clean, take out outliers, add features, check quality."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions.nulls import numeric_columns
from wellspring.operators.duplicates import remove_duplicates
from wellspring.operators.features import add_features
from wellspring.operators.imputation import handle_missing
from wellspring.operators.isolation import isolation_flags
from wellspring.operators.outliers import flag_outliers, split_by_flag
from wellspring.operators.validation import REQUIRED, InvalidData, require_rows, validate_structure
from wellspring.plans.quality import quality_report
from wellspring.session import settle
from wellspring.sources.readers import read_parquet

OUTLIER_METHODS = {"zscore": ["zscore"], "iqr": ["iqr"], "zscore_iqr": ["zscore", "iqr"]}


@dataclass(frozen=True)
class ProcessingConfig:
    imputation_strategy: str = "median"
    custom_strategy: Mapping[str, str] = field(default_factory=dict)
    remove_outliers: bool = True
    outlier_method: str = "isolation_forest"
    contamination: float = 0.05
    add_formation_features: bool = True


@dataclass(frozen=True)
class ProcessingResult:
    data: DataFrame
    report: DataFrame
    history: DataFrame
    created_features: list[str]


def load(spark: SparkSession, path: str, required: Mapping[str, str] = REQUIRED) -> DataFrame:
    """A table that has rows and the required columns."""
    df = require_rows(read_parquet(spark, path))
    ok, message = validate_structure(df, required)
    if not ok:
        raise InvalidData(message)
    return df


def clean(df: DataFrame, config: ProcessingConfig) -> tuple[DataFrame, DataFrame]:
    filled, history = handle_missing(df, config.imputation_strategy, config.custom_strategy)
    return remove_duplicates(filled), history


def without_outliers(df: DataFrame, config: ProcessingConfig) -> DataFrame:
    if not config.remove_outliers:
        return df
    flag = "_outlier"
    if config.outlier_method == "isolation_forest":
        flagged = isolation_flags(df, contamination=config.contamination, flag=flag)
    elif config.outlier_method in OUTLIER_METHODS:
        flagged = flag_outliers(df, numeric_columns(df), methods=OUTLIER_METHODS[config.outlier_method])
        flagged = flagged.withColumnRenamed("is_outlier", flag)
    else:
        raise ValueError(f"unknown outlier method {config.outlier_method!r}")
    return split_by_flag(flagged, flag)[0].drop(flag)


def process(df: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> ProcessingResult:
    """All four steps in order. Cleaned rows are written once, as the outlier limits and the rows both need them."""
    cleaned, history = clean(df, config)
    kept = without_outliers(settle(cleaned), config)
    enriched, created = add_features(kept, config.add_formation_features)
    data, report = quality_report(enriched)
    return ProcessingResult(data, report, history, created)


def process_file(spark: SparkSession, path: str, config: ProcessingConfig = ProcessingConfig()) -> ProcessingResult:
    return process(load(spark, path), config)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))
