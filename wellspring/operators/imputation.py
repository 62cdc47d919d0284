"""Filling missing values with column statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import nan_to_null, numeric_columns, text_columns
from wellspring.operators.quantiles import EXACT_LIMIT, approximate_percentiles, column_percentiles

STRATEGIES = ("median", "mean", "knn", "iterative")
TEXT_STRATEGIES = ("mode", "most_frequent")
HISTORY = "step int, column string, strategy string, n_filled bigint"


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def column_medians(df: DataFrame, columns: Sequence[str], exact_limit: int = EXACT_LIMIT,
                   accuracy: int | None = None) -> dict[str, float | None]:
    if not columns:
        return {}
    if accuracy is not None:
        return {c: v[0] for c, v in approximate_percentiles(df, columns, [0.5], accuracy).items()}
    return {c: v[0] for c, v in column_percentiles(df, columns, [0.5], exact_limit).items()}


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: the most frequent value, the smallest of equally frequent ones, and how often it occurs.

    Values are counted before they are compared, so a column may have any number of different values.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    counted = (
        df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("_n")).alias("n"), "value")).alias("_best"))
    return best.select("column", F.col("_best.value").alias("value"), (-F.col("_best.n")).alias("n"))


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return {r["column"]: r["value"] for r in most_frequent(df, columns).collect()} if columns else {}


def missing_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first().asDict() if columns else {}


def handle_missing(df: DataFrame, strategy: str = "median", custom: Mapping[str, str] | None = None,
                   exact_limit: int = EXACT_LIMIT, accuracy: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill numeric columns by ``strategy`` and text columns by their most frequent value.

    ``custom`` names strategies for single columns; names of other than numeric columns only take a text
    strategy. Numeric columns become double. A column without any value stays empty. Returns the filled
    rows and the history (step, column, strategy, n_filled).
    """
    from wellspring.operators.chained import iterative_impute
    from wellspring.operators.neighbours import knn_impute

    custom = dict(custom or {})
    clean = nan_to_null(df)
    numbers, texts = numeric_columns(clean), text_columns(clean)
    for column, chosen in custom.items():
        allowed = STRATEGIES if column in numbers else TEXT_STRATEGIES if column in texts else None
        if allowed and chosen not in allowed:
            raise ValueError(f"unknown strategy {chosen!r} for column {column}")
    general = [c for c in numbers if c not in custom]
    if general and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    clean = clean.withColumns({c: F.col(c).cast("double") for c in numbers})
    gone = missing_counts(clean, numbers + texts)

    # A single column has no neighbours to learn from, so the model-based strategies give its mean.
    plan = {c: ("mean" if custom[c] in ("knn", "iterative") else custom[c]) for c in numbers if c in custom}
    if strategy in ("median", "mean"):
        plan.update({c: strategy for c in general})
    lacking = {c: s for c, s in plan.items() if gone[c]}
    values: dict[str, object] = column_means(clean, [c for c, s in lacking.items() if s == "mean"])
    values.update(column_medians(clean, [c for c, s in lacking.items() if s == "median"], exact_limit, accuracy))
    values.update(column_modes(clean, [c for c in texts if gone[c]]))
    known = {c: v for c, v in values.items() if v is not None}
    filled = clean.fillna(known) if known else clean
    if general and strategy == "knn" and any(gone[c] for c in general):
        filled = knn_impute(filled, general)
    if general and strategy == "iterative" and any(gone[c] for c in general):
        filled = iterative_impute(filled, general)

    steps = [(c, custom[c]) for c in numbers if c in custom] + [(c, strategy) for c in general]
    steps += [(c, "mode") for c in texts if gone[c]]
    history = [(i, c, s, int(gone[c])) for i, (c, s) in enumerate(steps)]
    return filled, df.sparkSession.createDataFrame(history, HISTORY)
