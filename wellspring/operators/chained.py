"""Chained regression imputation: each incomplete column is predicted from all others, in rounds.

A Bayesian ridge regression needs only sums of products of the columns. In a row every filled value is a
linear function of the known ones, and the same function in all rows with gaps in the same columns. So the sums
are taken once for each such pattern of gaps, and all rounds are computed from them. Only the largest step of a
round needs the rows again, as it decides when to end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wellspring.functions.nulls import nan_to_null
from wellspring.operators.keyed import BROADCAST_BYTES
from wellspring.session import settle

ROUNDS = 10
TOLERANCE = 1e-3
ROUNDING = 1e-12
PATTERN = "_pattern"


def bayesian_ridge(gram: np.ndarray, moment: np.ndarray, square: float, n: float, max_iter: int = 300,
                   tol: float = 1e-3) -> np.ndarray:
    """Coefficients that maximise the evidence (MacKay 1992), from centred sums of products.

    Directions in which the columns do not vary, up to rounding, get no weight.
    """
    hyper = 1e-6
    eigenvalues, vectors = np.linalg.eigh(gram)
    varied = eigenvalues > ROUNDING * eigenvalues.max()
    eigenvalues, vectors = eigenvalues[varied], vectors[:, varied]
    rotated = vectors.T @ moment
    noise, weight = 1.0 / (square / n + np.finfo(float).eps), 1.0
    previous = None

    def solve() -> np.ndarray:
        return vectors @ (rotated / (eigenvalues + weight / noise))

    for _ in range(max_iter):
        coefficients = solve()
        residual = max(square - 2 * coefficients @ moment + coefficients @ gram @ coefficients, 0.0)
        effective = np.sum(noise * eigenvalues / (weight + noise * eigenvalues))
        weight = (effective + 2 * hyper) / (coefficients @ coefficients + 2 * hyper)
        noise = (n - effective + 2 * hyper) / (residual + 2 * hyper)
        if previous is not None and np.sum(np.abs(previous - coefficients)) < tol:
            break
        previous = coefficients
    return solve()


def _product_columns(terms: Sequence[Column]) -> list[Column]:
    size = len(terms)
    return [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]


def _square_matrix(row: Row, size: int) -> np.ndarray:
    result = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            result[i, j] = result[j, i] = row[f"g{i}_{j}"] or 0.0
    return result


def _products(df: DataFrame, columns: Sequence[str], centre: dict[str, float]) -> np.ndarray:
    """Sums of products of (1, columns) with each column shifted by its centre."""
    terms = [F.lit(1.0)] + [F.col(f"`{c}`") - F.lit(centre[c]) for c in columns]
    return _square_matrix(df.agg(*_product_columns(terms)).first(), len(terms))


def _regression(sums: np.ndarray, target: int) -> np.ndarray:
    """Row of factors on (1, columns) that predicts the column at place ``target`` from the others."""
    n = sums[0, 0]
    means = sums[0] / n
    centred = sums - n * np.outer(means, means)
    others = [i for i in range(1, len(sums)) if i != target]
    weights = bayesian_ridge(centred[np.ix_(others, others)], centred[others, target], centred[target, target], n)
    factors = np.zeros(len(sums))
    factors[others] = weights
    factors[0] = means[target] - weights @ means[others]
    return factors


def _filled(maps: Column, place: int, readings: Sequence[Column]) -> Column:
    """The product of row ``place`` of a flat matrix with (1, readings)."""
    width = len(readings) + 1
    value = maps[place * width]
    for i, reading in enumerate(readings, 1):
        value = value + maps[place * width + i] * reading
    return value


def iterative_impute(df: DataFrame, columns: Sequence[str], rounds: int = ROUNDS, tol: float = TOLERANCE,
                     pattern_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fill the gaps of the numeric ``columns``, starting from the means, the column with fewest gaps first.

    One aggregate gives the sums of products for each pattern of gaps, one pass over the incomplete rows ends
    each round, and the result is one projection of ``df``. The sums and the functions of all patterns travel,
    so where they pass ``pattern_bytes`` the rows are filled column by column instead, with the same values but
    a pass for each column and round. Known cells stay as they are. A column without any value stays empty;
    NaN counts as a gap.
    """
    clean = nan_to_null(df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns}))
    facts = clean.agg(*[
        f(F.col(f"`{c}`")).alias(f"{c}_{n}") for c in columns for n, f in
        (("mean", F.avg), ("n", F.count), ("reach", lambda v: F.max(F.abs(v))))
    ], F.count(F.lit(1)).alias("_rows")).first()
    columns = [c for c in columns if facts[f"{c}_n"]]
    centre = {c: facts[f"{c}_mean"] for c in columns}
    gaps = sorted((c for c in columns if facts[f"{c}_n"] < facts["_rows"]), key=lambda c: -facts[f"{c}_n"])
    if not gaps or len(columns) == 1:
        return clean.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(centre[c])) for c in columns})
    limit = tol * max(facts[f"{c}_reach"] for c in columns)
    size = len(columns) + 1
    patterns = pattern_bytes // (8 * size * size)
    pattern = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in gaps])
    readings = [F.coalesce(F.col(f"`{c}`") - F.lit(centre[c]), F.lit(0.0)) for c in columns]
    sums = clean.groupBy(pattern.alias(PATTERN)).agg(*_product_columns([F.lit(1.0), *readings])).limit(patterns + 1).collect()
    if len(sums) > patterns:
        return _fill_by_column(clean, columns, gaps, centre, rounds, limit)
    names = [row[PATTERN] for row in sums]
    grams = np.array([_square_matrix(row, size) for row in sums])
    open_in = {c: np.array([name[i] == "1" for name in names]) for i, c in enumerate(gaps)}
    whole = [0, *[1 + columns.index(c) for c in gaps]]
    maps = np.tile(np.eye(size), (len(names), 1, 1))
    for c in gaps:
        maps[open_in[c], 1 + columns.index(c)] = 0.0
    rows = settle(clean.where(pattern.contains("1")).select(
        pattern.alias(PATTERN), *[reading.alias(f"_x{i}") for i, reading in enumerate(readings)]))
    spark = df.sparkSession
    schema = f"{PATTERN} string, _maps array<double>"

    def with_maps(table: DataFrame, matrices: np.ndarray) -> DataFrame:
        """Join the rows of the matrices for the incomplete columns, at most ``pattern_bytes``, by pattern."""
        held = [(name, matrix[whole[1:]].ravel().tolist()) for name, matrix in zip(names, matrices) if "1" in name]
        return table.join(F.broadcast(spark.createDataFrame(held, schema)), PATTERN, "left")

    for _ in range(rounds):
        before = maps.copy()
        for c in gaps:
            place, known = 1 + columns.index(c), ~open_in[c]
            seen = (maps[known] @ grams[known] @ maps[known].transpose(0, 2, 1)).sum(axis=0)
            factors = _regression(seen, place)
            maps[open_in[c], place] = factors @ maps[open_in[c]]
        steps = [F.abs(_filled(F.col("_maps"), i, [F.col(f"_x{j}") for j in range(len(columns))])) for i in range(len(gaps))]
        moved = with_maps(rows, maps - before).agg(F.max(F.greatest(*steps) if len(steps) > 1 else steps[0])).first()[0]
        if moved is None or moved < limit:
            break
    return with_maps(clean.withColumn(PATTERN, pattern), maps).withColumns({
        c: F.coalesce(F.col(f"`{c}`"), F.lit(centre[c]) + _filled(F.col("_maps"), i, readings)) for i, c in enumerate(gaps)
    }).select(*[f"`{c}`" for c in clean.columns])


def _fill_by_column(clean: DataFrame, columns: Sequence[str], gaps: Sequence[str], centre: dict[str, float], rounds: int,
                    limit: float) -> DataFrame:
    """The same rounds with the filled rows written after each."""
    whole = F.lit(True)
    for c in gaps:
        whole = whole & F.col(f"`{c}`").isNotNull()
    base = _products(clean.where(whole), columns, centre)
    state = settle(clean.where(~whole).withColumns({f"_gap_{c}": F.col(f"`{c}`").isNull() for c in gaps}).withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.lit(centre[c])) for c in gaps}))
    for _ in range(rounds):
        current = state.withColumns({f"_old_{c}": F.col(f"`{c}`") for c in gaps})
        for c in gaps:
            factors = _regression(base + _products(current.where(~F.col(f"`_gap_{c}`")), columns, centre), 1 + columns.index(c))
            guess = F.lit(centre[c] + float(factors[0]))
            for name, w in zip(columns, factors[1:]):
                if name != c:
                    guess = guess + F.lit(float(w)) * (F.col(f"`{name}`") - F.lit(centre[name]))
            current = current.withColumn(c, F.when(F.col(f"`_gap_{c}`"), guess).otherwise(F.col(f"`{c}`")))
        current = settle(current)
        steps = [F.abs(F.col(f"`{c}`") - F.col(f"`_old_{c}`")) for c in gaps]
        moved = current.agg(F.max(F.greatest(*steps) if len(steps) > 1 else steps[0])).first()[0]
        state = current.drop(*[f"_old_{c}" for c in gaps])
        if moved is None or moved < limit:
            break
    return clean.where(whole).unionByName(state.drop(*[f"_gap_{c}" for c in gaps]))
