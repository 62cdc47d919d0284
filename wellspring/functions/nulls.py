"""Null and NaN rules, and column selection by type."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, include_boolean: bool = False) -> list[str]:
    kinds = (T.NumericType, T.BooleanType) if include_boolean else (T.NumericType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def has_column(df: DataFrame, name: str) -> bool:
    """Whether the column is there, whatever the case of its letters."""
    return name.lower() in {c.lower() for c in df.columns}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL: Spark sorts NaN above all numbers and lets it poison averages."""
    floating = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(kind)) for c, kind in floating.items()}) if floating else df


def number(column: Column) -> Column:
    """A numeric column as double with NaN read as unknown: comparisons would take it for larger than everything.

    The column is named once, so nesting such expressions does not double them at each level.
    """
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def holds(predicate: Column) -> Column:
    """The predicate with unknown read as false, so that its complement keeps the row."""
    return F.coalesce(predicate, F.lit(False))


def any_of(predicates: Iterable[Column]) -> Column:
    """Whether one of the predicates holds; an unknown one does not."""
    return holds(reduce(lambda a, b: a | b, predicates, F.lit(False)))


def lookup(key: Column, values: dict, default=None) -> Column:
    """Value for ``key`` in a small constant map, else ``default``."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))
