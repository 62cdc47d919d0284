"""Jobs over a folder of well files; all files are one table and each result knows its file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wellspring.operators.combination_rules import flag_combinations
from wellspring.operators.masking import mask_and_noise
from wellspring.operators.ordered import first_rows_per_key
from wellspring.operators.outliers import DEFAULT_COLUMNS, flag_outliers, outlier_counts
from wellspring.operators.profile import anomaly_summary
from wellspring.session import settle
from wellspring.sources.readers import SOURCE_FILE, read_usable
from wellspring.sources.writers import append_jdbc, write_parquet, write_split, write_summary_csv
from wellspring.vocabulary import for_database

ANOMALY = "Combination_Anomaly"
SUMMARY = f"{SOURCE_FILE} string, total_records bigint, anomalies bigint, percentage double"


def flag_folder(spark: SparkSession, folder: str, output: str, summary: str,
                mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """Flag rule combinations in all usable files, one output folder per file: (summary row per file, skipped files)."""
    rows, skipped = read_usable(spark, folder)
    if rows is None:
        return spark.createDataFrame([], SUMMARY), skipped
    flagged = settle(flag_combinations(rows, ANOMALY))  # the output folder may hold rows of earlier runs
    write_parquet(flagged, output, [SOURCE_FILE], mode)
    counted = settle(anomaly_summary(flagged, [SOURCE_FILE], ANOMALY))
    write_summary_csv(counted, summary, mode)
    return counted, skipped


def split_outliers_folder(spark: SparkSession, folder: str, clean_output: str, outlier_output: str,
                          columns: Sequence[str] | None = None, z_threshold: float = 3.0, iqr_multiplier: float = 1.5,
                          mode: str = "errorifexists") -> tuple[DataFrame, DataFrame]:
    """Split the rows of all usable files by outlier, with limits per file: (counts per file, skipped files)."""
    columns = list(columns or DEFAULT_COLUMNS)
    rows, skipped = read_usable(spark, folder, columns)
    if rows is None:
        return spark.createDataFrame([], f"{SOURCE_FILE} string, n_clean bigint, n_outliers bigint"), skipped
    flagged = settle(flag_outliers(rows, columns, [SOURCE_FILE], z_threshold, iqr_multiplier))
    write_split(flagged, "is_outlier", clean_output, outlier_output, [SOURCE_FILE], mode, settled=True)
    return outlier_counts(flagged, [SOURCE_FILE]), skipped


def disturb_folder(spark: SparkSession, folder: str, output: str, keys: Sequence[str], percent: float = 5.0,
                   noise_mean: float = 0.0, noise_std: float = 0.1, seed: int = 42, mode: str = "errorifexists") -> DataFrame:
    """Put missing cells and noise into all files that have the keys; returns the skipped files with the reason."""
    rows, skipped = read_usable(spark, folder, keys)
    if rows is not None:
        disturbed = mask_and_noise(rows, [*keys, SOURCE_FILE], percent, noise_mean, noise_std, seed)
        write_parquet(disturbed, output, [SOURCE_FILE], mode)
    return skipped


def rows_for_database(df: DataFrame, keys: Sequence[str], order: Sequence[str], per_key: int | None = None) -> DataFrame:
    """All rows in the shape of the target table, or the first ``per_key`` of each well."""
    chosen = df if per_key is None else first_rows_per_key(df, keys, order, per_key)
    return for_database(chosen)


def load_folder_to_database(spark: SparkSession, folder: str, url: str, user: str, password: str,
                            order: Sequence[str] = ("DateTime",), per_file: int | None = None) -> DataFrame:
    """Append the rows of all usable files, or the first ``per_file`` of each; returns the skipped files with the reason."""
    rows, skipped = read_usable(spark, folder, list(order))
    if rows is not None:
        append_jdbc(rows_for_database(rows, [SOURCE_FILE], order, per_file), url, user, password)
    return skipped
