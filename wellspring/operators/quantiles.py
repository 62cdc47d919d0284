"""Exact percentiles with linear interpolation, also where a column or a group is too long for one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.operators.keyed import attach_by_key
from wellspring.operators.ordered import running_totals
from wellspring.session import settle

EXACT_LIMIT = 1_000_000
SKETCH_ACCURACY = 10_000


def approximate_percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                            accuracy: int = SKETCH_ACCURACY) -> dict[str, list[float | None]]:
    row = df.agg(*[F.percentile_approx(c, list(probabilities), accuracy).alias(c) for c in columns]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}


@dataclass
class _Search:
    """Where the value of one rank still may be: strictly between ``low`` and ``high``."""

    column: str
    rank: int
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        c = F.col(self.column)
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c > self.low)
        if self.high is not None:
            test = test & (c < self.high)
        return test

    def fractions(self, accuracy: int) -> list[float]:
        middle = (self.rank - self.below) / max(self.size - 1, 1)
        margin = 2.0 / accuracy
        return [min(1.0, max(0.0, middle - margin)), min(1.0, max(0.0, middle + margin))]

    def narrow(self, first: float, second: float, counts: Sequence[int]) -> None:
        under_first, at_first, under_second, at_second = counts
        rank = self.rank - self.below
        if rank < under_first:
            self.high, self.size = first, under_first
        elif rank < under_first + at_first:
            self.value = first
        elif rank < under_second:
            self.below += under_first + at_first
            self.size = under_second - under_first - at_first
            self.low, self.high = first, second
        elif rank < under_second + at_second:
            self.value = second
        else:
            self.below += under_second + at_second
            self.size -= under_second + at_second
            self.low = second


def column_percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                       exact_limit: int = EXACT_LIMIT, accuracy: int = SKETCH_ACCURACY) -> dict[str, list[float | None]]:
    """Exact percentiles over the whole table.

    Up to ``exact_limit`` rows one aggregate does it. Beyond, each wanted rank is enclosed by two values
    of a quantile sketch, the rows around them are counted, and the search goes on between the two; each
    pass is one scan with small partial aggregates and leaves about 4/accuracy of the rows. The enclosing
    values leave the range at each pass, so long stretches of equal values cannot stall it.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    if df.count() <= exact_limit:
        row = df.agg(*[F.percentile(c, list(probabilities)).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    wanted = {c: [p * (sizes[c] - 1) for p in probabilities] for c in columns if sizes[c]}
    searches = {
        (c, r): _Search(c, r, sizes[c])
        for c, places in wanted.items() for place in places for r in (math.floor(place), math.ceil(place))
    }
    _find(df, list(searches.values()), exact_limit, accuracy)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        if c not in wanted:
            result[c] = [None] * len(probabilities)
            continue
        values = []
        for place in wanted[c]:
            low, high = searches[c, math.floor(place)].value, searches[c, math.ceil(place)].value
            values.append(low + (high - low) * (place - math.floor(place)))
        result[c] = values
    return result


def _find(df: DataFrame, searches: list[_Search], exact_limit: int, accuracy: int) -> None:
    keep = max(exact_limit // 10, 1)
    while True:
        long = [s for s in searches if s.value is None and s.size > keep]
        if not long:
            break
        sketch = df.agg(*[
            F.percentile_approx(F.when(s.inside(), F.col(s.column)), s.fractions(accuracy), accuracy).alias(f"s{i}")
            for i, s in enumerate(long)
        ]).first()
        bounds = [sketch[f"s{i}"] for i in range(len(long))]
        counted = df.agg(*[
            F.count_if(s.inside() & test).alias(f"n{i}_{j}")
            for i, (s, (a, b)) in enumerate(zip(long, bounds))
            for j, test in enumerate((F.col(s.column) < a, F.col(s.column) == a, F.col(s.column) < b, F.col(s.column) == b))
        ]).first()
        for i, (s, (a, b)) in enumerate(zip(long, bounds)):
            s.narrow(a, b, [counted[f"n{i}_{j}"] for j in range(4)])
    short = [s for s in searches if s.value is None]
    if short:
        row = df.agg(*[
            F.element_at(F.sort_array(F.collect_list(F.when(s.inside(), F.col(s.column)))), s.rank - s.below + 1)
            .alias(f"v{i}") for i, s in enumerate(short)
        ]).first()
        for i, s in enumerate(short):
            s.value = float(row[f"v{i}"])


def grouped_percentiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float],
                        sizes: DataFrame | None = None, exact_limit: int = EXACT_LIMIT,
                        accuracy: int | None = None) -> DataFrame:
    """Percentiles per key as array columns ``<column>_p``; exact unless ``accuracy`` is given.

    Groups up to ``exact_limit`` rows use the built-in aggregate. For longer groups a quantile sketch per
    key encloses each percentile between two values; only the cells between them, about 4/SKETCH_ACCURACY
    of all, are counted per distinct value, and the wanted ranks are read off running counts over these.
    A group of any length and any repeated value stays spread over many tasks. ``sizes`` may give the
    settled row count per key as column ``n_rows``.
    """
    shares = list(probabilities)
    if accuracy is not None:
        return df.groupBy(*keys).agg(*[F.percentile_approx(c, shares, accuracy).alias(f"{c}_p") for c in columns])
    built_in = [F.percentile(c, shares).alias(f"{c}_p") for c in columns]
    if sizes is None:
        sizes = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
    if (sizes.agg(F.max("n_rows")).first()[0] or 0) <= exact_limit:
        return df.groupBy(*keys).agg(*built_in)
    long_keys = settle(sizes.where(F.col("n_rows") > exact_limit).select(*keys, F.col("n_rows").alias("_long")))
    rows = attach_by_key(df.select(*keys, *columns), long_keys, keys, weight="_long", salt_by=columns)
    ordinary = rows.where(F.col("_long").isNull()).groupBy(*keys).agg(*built_in)
    long = rows.where(F.col("_long").isNotNull()).drop("_long")
    return ordinary.unionByName(_long_group_percentiles(long, keys, columns, shares, exact_limit))


def _long_group_percentiles(df, keys, columns, shares, exact_limit) -> DataFrame:
    """Percentiles by enclosing and counting. A key whose sketch missed a rank is done again without bounds."""
    margin = 2.0 / SKETCH_ACCURACY + 2.0 / exact_limit
    sketched = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        edges = [min(1.0, max(0.0, p + side)) for p in shares for side in (-margin, margin)]
        sketched += [F.count(c).alias(f"_n{i}"), F.percentile_approx(c, edges, SKETCH_ACCURACY).alias(f"_e{i}")]
    bounds = settle(df.groupBy(*keys).agg(*sketched))
    enclosed = settle(_ranks_by_counting(df, keys, columns, shares, exact_limit, bounds, True))
    wanted = F.lit(True)
    for i, c in enumerate(columns):
        wanted = wanted & ((F.col(f"_n{i}") == 0) | F.forall(f"{c}_p", lambda v: v.isNotNull()))
    checked = attach_by_key(bounds.select(*keys, "_rows", *[f"_n{i}" for i in range(len(columns))]), enclosed, keys)
    missed = settle(checked.where(~F.coalesce(wanted, F.lit(False))).select(*keys, F.col("_rows").alias("_again")))
    result = [f"{c}_p" for c in columns]
    if missed.isEmpty():
        return checked.select(*keys, *result)
    again = attach_by_key(df, missed, keys, weight="_again", salt_by=columns).where(F.col("_again").isNotNull()).drop("_again")
    return attach_by_key(checked, missed, keys).where(F.col("_again").isNull()).select(*keys, *result).unionByName(
        _ranks_by_counting(again, keys, columns, shares, exact_limit, bounds, False).select(*keys, *result))


def _ranks_by_counting(df, keys, columns, shares, rows_per_run, bounds, enclosed) -> DataFrame:
    """Read the ranks off running counts over the distinct values of each (key, column, share)."""
    rows = attach_by_key(df.select(*keys, *columns), bounds, keys, weight="_rows", salt_by=columns)
    targets = [(i, j) for i in range(len(columns)) for j in range(len(shares))]
    below, inside = {}, {}
    for i, j in targets:
        v, low, high = F.col(columns[i]), F.col(f"_e{i}")[2 * j], F.col(f"_e{i}")[2 * j + 1]
        below[i, j] = v < low if enclosed else F.lit(False)
        inside[i, j] = (v >= low) & (v <= high) if enclosed else v.isNotNull()
    cells = F.array_compact(F.array(*[
        F.when(inside[i, j], F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(columns[i]).cast("double").alias("_value")))
        for i, j in targets
    ]))
    groups = [*keys, "_i", "_j"]
    counted = settle(
        rows.select(*keys, F.explode(cells).alias("_cell")).groupBy(*keys, "_cell._i", "_cell._j", "_cell._value")
        .agg(F.count(F.lit(1)).alias("_copies")))
    before = rows.groupBy(*keys).agg(*[F.count_if(below[t]).alias(f"_b{t[0]}_{t[1]}") for t in targets])
    starts = attach_by_key(bounds, settle(before), keys).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_b{i}_{j}").alias("_before"),
                 (F.lit(shares[j]) * (F.col(f"_n{i}") - 1)).alias("_place"))
        for i, j in targets
    ])))
    reached = running_totals(counted, groups, ["_value"], {"_upto": F.col("_copies")}, True, rows_per_run)
    placed = attach_by_key(reached, settle(starts), groups, salt_by=["_value"]).withColumn("_upto", F.col("_upto") + F.col("_before"))

    def at(rank):
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_copies")), F.col("_value")))

    found = placed.groupBy(*groups).agg(
        at(F.floor("_place")).alias("_low"), at(F.ceil("_place")).alias("_high"), F.max(F.col("_place") - F.floor("_place")).alias("_part"))
    valued = found.withColumn("_v", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
    return valued.groupBy(*keys).agg(*[
        F.array(*[F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("_v"))) for j in range(len(shares))]).alias(f"{c}_p")
        for i, c in enumerate(columns)
    ])


def order_statistics(df: DataFrame, ranks: dict[str, int], exact_limit: int = EXACT_LIMIT,
                     accuracy: int = SKETCH_ACCURACY) -> dict[str, float]:
    """Value at a rank (from 0) among the non-null values of each column."""
    if not ranks:
        return {}
    sizes = df.agg(*[F.count(c).alias(c) for c in ranks]).first()
    searches = [_Search(c, r, sizes[c]) for c, r in ranks.items()]
    _find(df, searches, exact_limit, accuracy)
    return {s.column: s.value for s in searches}
