"""Z-score and IQR outliers, per key or over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import any_of, holds, nan_to_null
from wellspring.operators.keyed import attach_by_key
from wellspring.operators.quantiles import EXACT_LIMIT, approximate_percentiles, column_percentiles, grouped_percentiles
from wellspring.session import settle

# The columns checked when none are named.
DEFAULT_COLUMNS = ["temperature", "pressure", "permeability", "flow_rate", "depth", "porosity", "salinity", "mud_weight"]
METHODS = ("zscore", "iqr")


def outlier_statistics(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                       exact_limit: int = EXACT_LIMIT, accuracy: int | None = None) -> DataFrame:
    """Row count, mean, population deviation and quartiles of each column per key, settled."""
    moments = []
    for c in columns:
        moments += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    base = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *moments))
    quartiles = grouped_percentiles(df, keys, columns, [0.25, 0.75], base, exact_limit, accuracy)
    renamed = quartiles.withColumnsRenamed({k: f"_q_{k}" for k in keys})
    joined = base.join(renamed, [base[k].eqNullSafe(renamed[f"_q_{k}"]) for k in keys], "left")
    bounds = [F.col(f"{c}_p")[i].alias(f"{c}_{q}") for c in columns for i, q in enumerate(("q1", "q3"))]
    return settle(joined.select(*base.columns, *bounds))


def zscore_test(value: Column, mean: Column, std: Column, threshold: float) -> Column:
    """A constant column has no deviation and so no outliers."""
    return holds(F.abs(value - mean) / F.nullif(std, F.lit(0.0)) > threshold)


def iqr_test(value: Column, q1: Column, q3: Column, multiplier: float) -> Column:
    reach = (q3 - q1) * multiplier
    return holds((value < q1 - reach) | (value > q3 + reach))


def flag_outliers(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (),
                  z_threshold: float = 3.0, iqr_multiplier: float = 1.5, methods: Sequence[str] = METHODS,
                  exact_limit: int = EXACT_LIMIT, accuracy: int | None = None, details: bool = False) -> DataFrame:
    """Add ``is_outlier``: any checked column is an outlier by any of the methods, within the row's key.

    ``details`` adds ``<column>_zscore`` and ``<column>_iqr``.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown outlier methods: {sorted(unknown)}")
    columns = list(columns or DEFAULT_COLUMNS)
    clean = nan_to_null(df)
    if keys:
        stats = outlier_statistics(clean, keys, columns, exact_limit, accuracy)
        known = attach_by_key(clean, stats, keys, weight="n_rows", salt_by=columns)
        at = lambda c, what: F.col(f"{c}_{what}")
        extra = [n for n in stats.columns if n not in keys]
    else:
        known, extra = clean, []
        facts = table_statistics(clean, columns, exact_limit, accuracy)
        at = lambda c, what: F.lit(facts[c][what]).cast("double")
    tests = {}
    for c in columns:
        if "zscore" in methods:
            tests[f"{c}_zscore"] = zscore_test(F.col(c), at(c, "mean"), at(c, "std"), z_threshold)
        if "iqr" in methods:
            tests[f"{c}_iqr"] = iqr_test(F.col(c), at(c, "q1"), at(c, "q3"), iqr_multiplier)
    flagged = known.withColumn("is_outlier", any_of(tests.values()))
    return (flagged.withColumns(tests) if details else flagged).drop(*extra)


def table_statistics(df: DataFrame, columns: Sequence[str], exact_limit: int = EXACT_LIMIT,
                     accuracy: int | None = None) -> dict[str, dict[str, float]]:
    """Mean, population deviation and quartiles of whole columns: four numbers each."""
    row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    if accuracy is None:
        quartiles = column_percentiles(df, columns, [0.25, 0.75], exact_limit)
    else:
        quartiles = approximate_percentiles(df, columns, [0.25, 0.75], accuracy)
    return {
        c: {"mean": row[f"{c}_mean"], "std": row[f"{c}_std"], "q1": quartiles[c][0], "q3": quartiles[c][1]}
        for c in columns
    }


def split_by_flag(df: DataFrame, flag: str = "is_outlier") -> tuple[DataFrame, DataFrame]:
    """(rows without the flag, rows with it); together they are all rows."""
    mask = holds(F.col(flag))
    return df.where(~mask), df.where(mask)


def outlier_counts(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count_if(~F.col("is_outlier")).alias("n_clean"), F.count_if(F.col("is_outlier")).alias("n_outliers"))
