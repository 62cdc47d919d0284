"""Isolation forest: rows that random cuts separate early are outliers (Liu, Ting and Zhou 2008).

Each tree is grown from a small random sample, one group per tree. The finished forest has a fixed
size, so it travels with the scoring function; all rows are then scored batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.nulls import number, numeric_columns
from wellspring.operators.quantiles import EXACT_LIMIT, column_percentiles
from wellspring.session import settle, spread

TREES = 100
SAMPLE = 256
EXTRA = 40  # rows let through for each tree besides twice the sample
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
NODE = "tree int, node int, feature int, cut double, below int, above int, length double"


def average_path(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n entries."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def tree_samples(df: DataFrame, columns: Sequence[str], trees: int, sample: int, seed: int, by: Sequence[str] | None = None) -> DataFrame:
    """``sample`` different rows for each tree (all, if there are fewer): those with the smallest hashes of row, tree and seed.

    The hash covers the columns ``by``, all if not given, so the draw does not depend on how the rows lie in partitions, and rows equal in
    all of them count once. Only hashes below a limit are shuffled. The limit lets through about twice as many as are wanted
    and is raised until every tree has its rows; it does not change which rows are the smallest.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema if f.name in (by or df.columns) and not isinstance(f.dataType, T.MapType)]
    rows = spread(df.select(F.xxhash64(*hashed).alias("_row"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
    share = min(1.0, (2 * sample + EXTRA) / max(df.count(), 1))
    while True:
        limit = int(share * (MOST_LONG - LEAST_LONG)) + LEAST_LONG if share < 1 else MOST_LONG
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.xxhash64("_row", tree, F.lit(seed)) <= limit)
        drawn = rows.withColumn("tree", F.explode(chosen)).dropDuplicates(["tree", "_row"])
        place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("_row", "tree", F.lit(seed)), "_row"))
        taken = settle(drawn.withColumn("_place", place).where(F.col("_place") <= sample).drop("_row", "_place"))
        full = taken.groupBy("tree").count().where(F.col("count") >= sample).count()
        if share >= 1 or full == trees:
            return taken
        share = min(1.0, 4 * share)


def _grow(seed: int, depth_limit: int, width: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        random = np.random.default_rng([seed, tree])
        data = rows[[f"x{i}" for i in range(width)]].to_numpy(dtype=float)
        nodes: list[list] = []

        def build(points: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + average_path(len(points))])
            if depth >= depth_limit or len(points) <= 1:
                return at
            low, high = points.min(axis=0), points.max(axis=0)
            usable = np.flatnonzero(high > low)
            if len(usable) == 0:
                return at
            feature = int(random.choice(usable))
            cut = float(random.uniform(low[feature], high[feature]))
            left = points[:, feature] <= cut
            nodes[at][2:6] = [feature, cut, build(points[left], depth + 1), build(points[~left], depth + 1)]
            return at

        build(data, 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "below", "above", "length"])

    return fit


def _level_order(nodes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree filled up to ``depth`` levels: feature and cut of its inner nodes level by level, and the lengths of the last level.

    The children of node i are 2i + 1 and 2i + 2, so no step looks them up. Below a leaf every way leads to its length.
    """
    inner = (1 << depth) - 1
    feature, cut, length, of = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1), np.zeros(2 * inner + 1, np.int64)
    for i in range(inner):
        here = nodes[of[i]]
        if here[0] >= 0:
            feature[i], cut[i] = int(here[0]), here[1]
        of[2 * i + 1], of[2 * i + 2] = (here[2], here[3]) if here[0] >= 0 else (of[i], of[i])
    length[:] = nodes[of[inner:], 4]
    return feature, cut, length


def isolation_scores(df: DataFrame, columns: Sequence[str] | None = None, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = 42, name: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score between 0 and 1 of each row over the numeric columns; null and NaN count as the column mean.

    The trees are grown from ``tree_samples``: the same table gives the same forest, however its rows are laid out.
    """
    columns = list(columns or numeric_columns(df))
    means = df.agg(*[F.avg(number(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    whole = [F.coalesce(number(F.col(f"`{c}`")), F.lit(means[f"m{i}"] or 0.0)) for i, c in enumerate(columns)]
    ready = df.withColumns({f"_x{i}": w for i, w in enumerate(whole)})
    names = [f"_x{i}" for i in range(len(columns))]
    samples = tree_samples(ready, names, trees, sample, seed, df.columns)  # the means may differ in the last bit
    size = samples.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    forest = samples.groupBy("tree").applyInPandas(_grow(seed, limit, len(columns)), NODE).toPandas()
    forest = forest.sort_values(["tree", "node"])
    grown = [_level_order(g[["feature", "cut", "below", "above", "length"]].to_numpy(dtype=float), limit) for _, g in forest.groupby("tree")]
    scale = average_path(size) or 1.0
    forest_of_all = df.sparkSession.sparkContext.broadcast(grown)  # trees x at most 4 x sample nodes

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        data = np.column_stack([v.to_numpy(dtype=float) for v in values])
        cells, first = data.ravel(), np.arange(len(data)) * data.shape[1]
        total, grown = np.zeros(len(data)), forest_of_all.value
        for feature, cut, length in grown:
            at = np.zeros(len(data), dtype=np.int64)
            for _ in range(limit):
                right = cells.take(first + feature.take(at)) > cut.take(at)
                at += at + 1
                at += right
            total += length.take(at - (len(length) - 1))
        return pd.Series(np.power(2.0, -total / len(grown) / scale))

    return spread(ready).withColumn(name, score(*[F.col(n) for n in names])).drop(*names)


def isolation_flags(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = 0.05,
                    trees: int = TREES, sample: int = SAMPLE, seed: int = 42, flag: str = "is_outlier",
                    exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """Mark the share ``contamination`` of the rows with the highest scores."""
    scored = settle(isolation_scores(df, columns, trees, sample, seed, "_score"))
    limit = column_percentiles(scored, ["_score"], [1.0 - contamination], exact_limit)["_score"][0]
    return scored.withColumn(flag, F.col("_score") > F.lit(limit)).drop("_score")
