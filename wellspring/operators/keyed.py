"""Joining a table of per-key facts to many rows when some keys are very frequent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.session import settle

BROADCAST_BYTES = 32 * 1024 * 1024
CELL_BYTES = 16
SALTS_IN_TOTAL = 1000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   also: Column | None = None) -> DataFrame:
    """Join on equal keys where two nulls count as equal; keeps the left key columns.

    ``also`` is a further condition over column names that only one side has.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matches = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    joined = left.join(renamed, matches if also is None else [*matches, also], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def attach_by_key(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str | None = None,
                  how: str = "left", also: Column | None = None, salt_by: Sequence[str] | None = None,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` about keys, mostly one row for each, to ``rows``.

    ``facts`` should be settled, as it is counted to decide. Up to ``broadcast_bytes`` the rows
    stay where they are. Beyond that both sides are shuffled, and each key with more than a
    thousandth of all rows is spread over salts in proportion to its share. ``weight`` names the
    column of ``facts`` with the row count of the key; without it the keys of ``rows`` are counted.

    The salt is a hash of ``salt_by``, of all columns if not given. It is the same when a task runs again,
    as a random one would not be. Rows alike in those columns stay together; a partition of many such
    rows is split by Spark's skew join, which cuts by origin and not by content.
    """
    if fits_broadcast(facts, broadcast_bytes):
        return null_safe_join(rows, F.broadcast(facts), keys, how, also)
    heavy = settle(heavy_keys(facts if weight else rows, keys, weight))
    salted_rows = (
        null_safe_join(rows, F.broadcast(heavy), keys)
        .withColumn("_salt", F.pmod(F.xxhash64(*(salt_by or rows.columns)), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    salted_facts = (
        null_safe_join(facts, F.broadcast(heavy), keys)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return null_safe_join(salted_rows, salted_facts, [*keys, "_salt"], how, also).drop("_salt")


def fits_broadcast(facts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of a settled table is within the bound: fixed-size cells and lengths of texts."""
    size = F.count(F.lit(1)) * (len(facts.columns) * CELL_BYTES)
    for field in facts.schema:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cell = F.to_json(F.struct(cell))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        size = size + F.coalesce(F.sum(F.octet_length(cell).cast("long")), F.lit(0))
    return facts.agg(size).first()[0] <= broadcast_bytes


def heavy_keys(df: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Keys with more than a thousandth of all rows and the salts for each: at most a thousand rows."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*keys).agg(size.cast("double").alias("_n"))
    total = counted.agg(F.sum("_n")).first()[0] or 0.0
    return (
        counted.where(F.col("_n") > total / SALTS_IN_TOTAL)
        .withColumn("_salts", F.ceil(F.col("_n") * SALTS_IN_TOTAL / F.lit(max(total, 1.0))).cast("int"))
        .drop("_n")
    )
