"""Missing cells and noise put in on purpose, to test how well gaps are filled.

Every random choice is a hash of the row's key, the column and a seed, so a task that runs again after
an executor is lost makes the same choice. Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import numeric_columns

BITS = 53
CELLS = 4096
SPREAD = 7.0


def chance(keys: Sequence[str], *salt: object) -> Column:
    """A number in [0, 1), even in distribution and fixed for the key and the salt."""
    mixed = F.xxhash64(*keys, *[F.lit(str(s)) for s in salt])
    return F.shiftrightunsigned(mixed, 64 - BITS).cast("double") / float(1 << BITS)


def mask_share(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, share: float = 0.05,
               seed: int = 42, cells: int = CELLS) -> DataFrame:
    """Set exactly int(share * rows) cells of each column to null: those with the smallest draws.

    After the count one scan finds the limits of all columns, see ``draw_limits``. Rows with equal keys draw
    alike, so there a column may lose more cells.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    n_rows = df.count()
    n = int(share * n_rows)
    if n == 0 or not columns:
        return df
    draws = {c: chance(keys, c, seed) for c in columns}
    limits = draw_limits(df, draws, n, n_rows, cells)
    return df.withColumns({c: F.when(draws[c] > F.lit(limits[c]), F.col(f"`{c}`")) for c in columns})


def draw_limits(df: DataFrame, draws: dict[str, Column], n: int, n_rows: int, cells: int = CELLS) -> dict[str, float]:
    """The n-th smallest of each column of even draws in [0, 1) over ``n_rows`` rows.

    It lies within ``SPREAD`` standard deviations of n / n_rows, all but certainly. That stretch is cut into
    cells of equal width and only the draws in it are told apart: count, least and greatest draw for each
    cell, besides the number of those below. A wanted draw that is the first or last of its cell is found;
    otherwise its cell is cut again, and where a stretch misses it, the rest of the range.
    """
    part = n / n_rows
    reach = SPREAD * math.sqrt(part * (1 - part) / n_rows) + 1.0 / n_rows
    stretch = {name: (max(0.0, part - reach), min(1.0, part + reach)) for name in draws}
    limits: dict[str, float] = {}
    names = list(draws)
    while len(limits) < len(names):
        places = []
        for i, name in enumerate(names):
            if name in limits:
                continue
            draw, (low, high) = draws[name], stretch[name]
            cell = F.when(draw < low, -1).otherwise(F.least(F.floor((draw - low) / F.lit((high - low) / cells)), F.lit(cells - 1)))
            places.append(F.when(draw <= high, F.struct(F.lit(i).alias("i"), cell.cast("int").alias("cell"), draw.alias("draw"))))
        found = (
            df.select(F.inline(F.array_compact(F.array(*places)))).groupBy("i", "cell")
            .agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("low"), F.max("draw").alias("high")).collect()
        )
        for i, name in enumerate(names):
            if name in limits:
                continue
            left, (low, high) = n, stretch[name]
            for row in sorted((r for r in found if r["i"] == i), key=lambda r: r["cell"]):
                if left > row["n"]:
                    left -= row["n"]
                    continue
                if row["cell"] < 0:
                    stretch[name] = (0.0, low)
                elif left in (1, row["n"]) or row["low"] == row["high"]:
                    limits[name] = row["low"] if left == 1 else row["high"]
                else:
                    stretch[name] = (row["low"], row["high"])
                break
            else:
                stretch[name] = (high, 1.0)
    return limits


def mask_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, percent: float = 5.0,
               seed: int = 42) -> DataFrame:
    """Set numeric cells to null as often as int(percent of all cells) draws with replacement would hit them."""
    columns = [c for c in (columns or numeric_columns(df)) if c not in keys]
    cells = df.count() * len(columns)
    draws = int(percent / 100.0 * cells)
    if draws == 0:
        return df
    hit = -math.expm1(draws * math.log1p(-1.0 / cells)) if cells > 1 else 1.0
    return df.withColumns({c: F.when(chance(keys, c, seed) >= hit, F.col(f"`{c}`")) for c in columns})


def add_noise(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, mean: float = 0.0,
              std: float = 0.1, seed: int = 42) -> DataFrame:
    """Add normally distributed noise to every numeric cell that has a value."""
    columns = [c for c in (columns or numeric_columns(df)) if c not in keys]
    noise = {
        c: F.sqrt(-2 * F.log(1 - chance(keys, c, seed, "radius"))) * F.cos(2 * math.pi * chance(keys, c, seed, "angle"))
        for c in columns
    }
    return df.withColumns({c: F.col(f"`{c}`") + F.lit(mean) + F.lit(std) * noise[c] for c in columns})


def mask_and_noise(df: DataFrame, keys: Sequence[str], percent: float = 5.0, mean: float = 0.0, std: float = 0.1,
                   seed: int = 42) -> DataFrame:
    """Missing cells, then noise on the cells that are left."""
    return add_noise(mask_cells(df, keys, None, percent, seed), keys, None, mean, std, seed)
