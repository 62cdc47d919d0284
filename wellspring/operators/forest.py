"""Random forests whose cost is in proportion to the rows, as models of Spark ML.

The rules are those of Spark ML: every row counts for each tree as often as a Poisson draw of mean one says, features are cut into at
most ``maxBins`` bins, each node looks at a random subset of the features and takes the split with the largest gain, and a split
whose leaves predict alike is taken back. Rows are coded once, a byte a feature, and kept in blocks. For each level one pass over the
blocks adds up what every bin of every node holds; what is shuffled are these sums, for a tree and a few nodes at a time.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.session import scratch_path, settle

BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 22
TASK_BYTES = 1 << 25
TASKS_PER_CORE = 2
SUMMARY_POINTS = 4096
SUMMARY_BUFFER = 1 << 18
COUNTED_CELLS = 1 << 22
GROUP_CELLS = 1 << 17
PURE = 2.0 ** -52
NOT_USED = ("minInstancesPerNode", "minInfoGain", "minWeightFractionPerNode", "subsamplingRate", "bootstrap", "weightCol", "impurity")

_POINTS = "feature int, points binary, counts binary"
_BLOCK = "block bigint, n int, codes binary, target binary"
_SUMS = "tree int, first int, cells binary, sums binary"
_BEST = "tree int, first int, best binary"


def fit_forest(estimator: Estimator, rows: DataFrame):
    """The model of a forest estimator of Spark ML, fitted to all ``rows``: number of trees, depth, bins, features of a node and seed are the estimator's."""
    spark, classify = rows.sparkSession, isinstance(estimator, RandomForestClassifier)
    if not 2 <= estimator.getMaxBins() <= 256:
        raise ValueError("maxBins must be from 2 to 256")
    if other := [name for name in NOT_USED if estimator.isSet(name)]:
        raise ValueError(f"not used in this fit: {', '.join(other)}")
    numbers = settle(rows.select(
        vector_to_array(F.col(f"`{estimator.getFeaturesCol()}`")).alias("x"), F.col(f"`{estimator.getLabelCol()}`").cast("double").alias("y")))
    facts = numbers.agg(F.max("y").alias("y"), F.max(F.size("x")).alias("d")).first()
    if not facts["d"]:
        raise ValueError("a forest needs rows and features to learn from")
    classes = max(2, int(facts["y"]) + 1) if classify else 0
    cuts = feature_cuts(numbers, facts["d"], estimator.getMaxBins())
    blocks = settle(numbers.mapInArrow(_coded(cuts, classify), _BLOCK))
    grown = _grow(blocks, cuts, classes, estimator.getNumTrees(), estimator.getMaxDepth(),
                  _features_per_node(estimator.getFeatureSubsetStrategy(), facts["d"], classify, estimator.getNumTrees()), estimator.getSeed())
    return estimator._copyValues(_as_model(spark, estimator, grown, cuts, classes))


def _features_per_node(strategy: str, d: int, classify: bool, trees: int) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classify else "onethird"
    counts = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "onethird": math.ceil(d / 3)}
    if strategy not in counts:
        raise ValueError(f"unknown choice of features {strategy!r}: auto, {', '.join(counts)}")
    return counts[strategy]


def _thinned(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal values as one; where more than ``most`` are left, the last values of so many equal shares of the rows."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, ends = values[starts], np.add.reduceat(counts, starts).cumsum()
    if len(values) > most:
        kept = np.unique(np.r_[0, np.searchsorted(ends, np.arange(1, most) * (ends[-1] / (most - 1)), "left").clip(max=len(ends) - 1), len(ends) - 1])
        values, ends = values[kept], ends[kept]
    return values, np.diff(ends, prepend=0)


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The cuts of Spark ML: between all values if they are few, else where the running count comes nearest to equal shares."""
    middles = (values[1:] + values[:-1]) / 2
    if len(values) <= bins:
        return middles
    ends, found, stride = counts.cumsum().tolist(), [], counts.sum() / bins
    target = stride
    for i in range(1, len(ends)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found[:bins - 1])


def feature_cuts(numbers: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` rising cuts for each place of the array ``x``, from all rows: exact shares as long as a task meets at most
    ``SUMMARY_POINTS`` different values of a feature, else from as many points with equal shares of its rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = [([], []) for _ in range(d)], np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for f in range(d):
                values, counts = np.unique(x[:, f], return_counts=True)
                held[f][0].append(values), held[f][1].append(counts)
                sizes[f] += len(values)
                if sizes[f] > SUMMARY_BUFFER:
                    values, counts = _thinned(np.concatenate(held[f][0]), np.concatenate(held[f][1]), SUMMARY_BUFFER // 2)
                    held[f], sizes[f] = ([values], [counts]), len(values)
        done = [_thinned(np.concatenate(v), np.concatenate(c), SUMMARY_POINTS) for v, c in held if v]
        if done:
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(range(d), pa.int32()), "points": [v.tobytes() for v, _ in done],
                "counts": [c.astype(np.int64).tobytes() for _, c in done]})

    def cut(table: pa.Table) -> pa.Table:
        values, counts = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("points", float), ("counts", np.int64)))
        found = _cuts(*_thinned(values, counts, SUMMARY_BUFFER), bins)
        return pa.table({"feature": table["feature"][:1], "points": [found.tobytes()], "counts": [b""]})

    found = numbers.select("x").mapInArrow(summarise, _POINTS).groupBy("feature").applyInArrow(cut, _POINTS).collect()
    return [np.frombuffer(r["points"]) for r in sorted(found, key=lambda r: r["feature"])]


def _coded(cuts: Sequence[np.ndarray], classify: bool):
    """Blocks of rows: the number of the bin of each feature, feature after feature, and the targets."""
    d = len(cuts)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // d))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def block(codes: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "n": pa.array([len(target)], pa.int32()), "codes": [codes.tobytes()], "target": [target.tobytes()]})

        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch["y"].to_numpy(zero_copy_only=False)
            codes = np.empty((d, len(y)), np.uint8)
            for f, cut in enumerate(cuts):
                codes[f] = np.searchsorted(cut, x[:, f], "left")
            held.append((codes, y.astype(np.int32) if classify else y.astype(float)))
            rows += len(y)
            if rows >= most:
                codes, y = np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held])
                whole = rows // most * most
                for a in range(0, whole, most):
                    yield block(codes[:, a:a + most], y[a:a + most])
                    number += 1
                held, rows = [(codes[:, whole:], y[whole:])], rows - whole
        if rows:
            yield block(np.concatenate([c for c, _ in held], axis=1), np.concatenate([t for _, t in held]))

    return code


class _Draws:
    """Poisson draws of mean one, alike whenever the same tree asks for the same block. Eight random bits settle nearly all of them;
    where these leave two numbers open, further bits decide."""

    OPEN = 255

    def __init__(self, seed: int):
        self.seed = seed & (1 << 64) - 1
        self.shares = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
        low, high = (np.searchsorted(self.shares, (np.arange(256) + end) / 256, side) for end, side in ((0, "right"), (1, "left")))
        self.known = np.where(low == high, low, self.OPEN).astype(np.uint8).tobytes()

    def of(self, tree: int, block: int, n: int) -> np.ndarray:
        source = np.random.SFC64(np.random.SeedSequence([self.seed, tree, block]))
        slots = source.random_raw(n // 8 + 1).tobytes()[:n]
        drawn = np.frombuffer(bytearray(slots.translate(self.known)), np.uint8)
        still = np.flatnonzero(drawn == self.OPEN)
        more = np.random.Generator(source).random(len(still))
        drawn[still] = np.searchsorted(self.shares, (np.frombuffer(slots, np.uint8)[still] + more) / 256, "right")
        return drawn


class _Tree:
    """Nodes in the order of their making; the right child follows the left. ``feature`` is negative in leaves and open nodes."""

    def __init__(self):
        self.feature, self.bin, self.left = np.array([-1]), np.array([0]), np.array([0])
        self.gain, self.stats, self.depth = np.array([-1.0]), None, np.array([0])
        self.open = np.array([0])

    def state(self, classes: int) -> tuple:
        """What a walk needs: leaves lead to themselves, and whether many rows have ended at a depth, so that dropping them pays."""
        split, closed = self.feature >= 0, self.feature < 0
        closed[self.open] = False
        drop = []
        if self.stats is not None:
            weight = _weight_of(self.stats, classes)
            drop = [weight[closed & (self.depth == i)].sum() * 8 > weight[0] for i in range(self.depth.max() + 1)]
        return (np.where(split, self.feature, 0), np.where(split, self.bin, 255).astype(np.uint8), np.where(split, self.left, np.arange(len(split))),
                closed, drop, self.open)


def _spread_of(sums: np.ndarray, classes: int) -> np.ndarray:
    """Gini impurity of class counts, variance of (weight, sum, sum of squares), along the last axis; nothing has none."""
    if classes:
        n = sums.sum(axis=-1)
        return np.where(n > 0, 1 - ((sums / np.where(n > 0, n, 1)[..., None]) ** 2).sum(axis=-1), 0.0)
    n = np.where(sums[..., 0] > 0, sums[..., 0], 1)
    return np.where(sums[..., 0] > 0, (sums[..., 2] - sums[..., 1] ** 2 / n) / n, 0.0)


def _weight_of(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(axis=-1) if classes else sums[..., 0]


def _grow(blocks: DataFrame, cuts: Sequence[np.ndarray], classes: int, trees: int, max_depth: int, per_node: int, seed: int) -> list[_Tree]:
    """All trees, level after level."""
    spark, d = blocks.sparkSession, len(cuts)
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).first()
    cores = spark.sparkContext.defaultParallelism
    tasks = min(size["blocks"], cores * max(TASKS_PER_CORE, math.ceil(size["n"] * d / TASK_BYTES / cores)))  # whole waves
    bins, width = max(len(c) for c in cuts) + 1, classes or 3
    splits = np.array([len(c) for c in cuts])
    choice, grown = np.random.default_rng(seed & (1 << 64) - 1), [_Tree() for _ in range(trees)]
    dealt = blocks.repartition(tasks).persist()
    for depth in range(max_depth + (max_depth == 0)):
        features = {}
        for t, tree in enumerate(grown):
            if len(tree.open):
                features[t] = (np.tile(np.arange(d), (len(tree.open), 1)) if per_node == d else
                               choice.random((len(tree.open), d)).argpartition(per_node - 1, axis=1)[:, :per_node])
        if not features:
            break
        step = max(1, GROUP_CELLS // (per_node * bins * width))
        known = spark.sparkContext.broadcast(({t: grown[t].state(classes) for t in features}, features))
        found = dealt.mapInArrow(_counted(known, d, bins, classes, step, seed), _SUMS).groupBy("tree", "first").applyInArrow(
            _chosen(known, splits, bins, classes, step), _BEST).collect()
        known.unpersist()
        best = {t: np.zeros((len(chosen), 3 + 2 * width)) for t, chosen in features.items()}
        for r in found:
            part = np.frombuffer(r["best"]).reshape(-1, 3 + 2 * width)
            best[r["tree"]][r["first"]:r["first"] + len(part)] = part
        for t, rows in best.items():
            _split(grown[t], rows, width, classes, depth + 1 >= max_depth, max_depth == 0)
    dealt.unpersist()
    return grown


def _split(tree: _Tree, best: np.ndarray, width: int, classes: int, last: bool, never: bool) -> None:
    """Split the open nodes that gain by it. Children are open unless they are pure or as deep as allowed."""
    left, right = best[:, 3:3 + width], best[:, 3 + width:]
    if tree.stats is None:
        tree.stats = left + right
    gains = best[:, 2] > 0
    if never:
        gains[:] = False
    nodes, n = tree.open[gains], len(tree.feature)
    tree.feature[nodes], tree.bin[nodes], tree.gain[nodes] = best[gains, 0], best[gains, 1], best[gains, 2]
    tree.left[nodes] = n + 2 * np.arange(len(nodes))
    stats = np.stack([left[gains], right[gains]], axis=1).reshape(-1, width)
    fresh = len(stats)
    tree.feature, tree.bin = np.r_[tree.feature, np.full(fresh, -1)], np.r_[tree.bin, np.zeros(fresh, int)]
    tree.left, tree.gain = np.r_[tree.left, np.zeros(fresh, int)], np.r_[tree.gain, np.full(fresh, -1.0)]
    tree.depth, tree.stats = np.r_[tree.depth, np.repeat(tree.depth[nodes] + 1, 2)], np.concatenate([tree.stats, stats])
    tree.open = n + np.flatnonzero(np.abs(_spread_of(stats, classes)) >= PURE) if not last else np.array([], int)


def _counted(known, d: int, bins: int, classes: int, step: int, seed: int):
    """For each tree, the sums in each bin of the features that its open nodes look at, over the rows of a task."""
    width = classes or 3

    def walk(state: tuple, codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        feature, bin_, left, closed, drop, open_ = state
        at, node = feature * n, np.zeros(len(row), np.intp)
        for depth in range(len(drop) - 1):
            place = at.take(node)
            place += row
            beyond = codes.take(place) > bin_.take(node)
            node = left.take(node)
            node += beyond
            if drop[depth + 1]:
                on = np.flatnonzero(~closed.take(node))
                row, node = row.take(on), node.take(on)
        if closed.any():
            on = np.flatnonzero(~closed.take(node))
            row, node = row.take(on), node.take(on)
        slot = np.zeros(len(feature), np.intp)
        slot[open_] = np.arange(len(open_))
        return row, slot.take(node)

    def add(sums: list, met: list, weights: tuple, nodes: int) -> None:
        for j, codes in enumerate(met):
            for i, part in enumerate(weights):
                found = np.bincount(codes, part, (classes or 1) * nodes * bins)
                if sums[j][i] is None:
                    sums[j][i] = found
                else:
                    sums[j][i] += found

    def of_nodes(t: int, a: int, nodes: int, held: list, draws: _Draws) -> np.ndarray:
        """Sums of the open nodes from ``a`` on. Keys are gathered until there are as many as cells: small tables stay in the cache, large ones are made seldom."""
        states, features = known.value
        looked = features[t]
        k, m = looked.shape
        sums: list[list] = [[None] * (1 if classes else 3) for _ in range(m)]
        met, weights, waiting = [[] for _ in range(m)], [], 0
        for i, (block, n, codes, target) in enumerate(held):
            drawn = draws.of(t, block, n)
            row, slot = walk(states[t], codes, np.flatnonzero(drawn.view(bool)), n)
            if nodes < k:
                some = np.flatnonzero((slot >= a) & (slot < a + nodes))
                row, slot = row.take(some), slot.take(some) - a
            w, y = drawn.take(row).astype(float), target.take(row)
            if classes:
                base = y
                base *= nodes
                base += slot
                base *= bins
                weights.append((w,))
            else:
                base, wy = slot * bins, w * y
                weights.append((w, wy, wy * y))
            for j in range(m):
                place = (looked[a:a + nodes, j] * n).take(slot)
                place += row
                met[j].append(codes.take(place) + base)
            waiting += len(row)
            if waiting >= (classes or 1) * nodes * bins or i + 1 == len(held):
                together = (lambda parts: parts[0]) if len(weights) == 1 else np.concatenate
                add(sums, [together(x) for x in met], tuple(map(together, zip(*weights, strict=True))), nodes)
                met, weights, waiting = [[] for _ in range(m)], [], 0
        if classes:
            return np.stack([x[0].reshape(classes, nodes, bins).transpose(1, 2, 0) for x in sums], axis=1)
        return np.stack([np.stack([part.reshape(nodes, bins) for part in x], axis=2) for x in sums], axis=1)

    def of_tree(t: int, held: list, draws: _Draws) -> Iterator[dict]:
        k, m = known.value[1][t].shape
        span = max(1, COUNTED_CELLS // (m * bins * width * step)) * step
        for a in range(0, k, span):
            cells = of_nodes(t, a, min(span, k - a), held, draws)
            for first in range(0, len(cells), step):
                part = cells[first:first + step].ravel()
                filled = np.flatnonzero(part)
                if len(filled):
                    yield {"tree": t, "first": a + first, "cells": filled.astype(np.int32).tobytes(),
                           "sums": part[filled].astype(np.int32 if classes else float).tobytes()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, draws = [], _Draws(seed)
        for batch in batches:
            for r in batch.to_pylist():
                held.append((r["block"], r["n"], np.frombuffer(r["codes"], np.uint8), np.frombuffer(r["target"], np.int32).astype(np.intp) if classes else np.frombuffer(r["target"])))
        if held:
            for t in known.value[0]:
                for out in of_tree(t, held, draws):
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([out["tree"]], pa.int32()), "first": pa.array([out["first"]], pa.int32()),
                        "cells": [out["cells"]], "sums": [out["sums"]]})

    return count


def _chosen(known, splits: np.ndarray, bins: int, classes: int, step: int):
    """The best split of each node: feature, bin, gain and the sums on both sides. The gain of a node without a split is negative."""
    width = classes or 3

    def choose(table: pa.Table) -> pa.Table:
        tree, first = table["tree"][0].as_py(), table["first"][0].as_py()
        looked = known.value[1][tree][first:first + step]
        k, m = looked.shape
        flat = np.zeros(k * m * bins * width)
        for cells, sums in zip(table["cells"], table["sums"], strict=True):
            flat[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer(), np.int32 if classes else float)
        left = flat.reshape(k, m, bins, width).cumsum(axis=2)
        whole = left[:, :, -1:]
        left = left[:, :, :-1] if bins > 1 else np.zeros_like(left)
        right = whole - left
        n, n_left, n_right = (_weight_of(x, classes) for x in (whole, left, right))
        gain = _spread_of(whole, classes) - (n_left * _spread_of(left, classes) + n_right * _spread_of(right, classes)) / np.where(n > 0, n, 1)
        allowed = (np.arange(left.shape[2]) < splits[looked][:, :, None]) & (n_left >= 1) & (n_right >= 1)
        gain = np.where(allowed, gain, -1.0).reshape(k, -1)
        at, rows = gain.argmax(axis=1), np.arange(k)
        j, cut = at // left.shape[2], at % left.shape[2]
        best = np.concatenate([
            np.stack([looked[rows, j], cut, gain[rows, at]], axis=1), left[rows, j, cut], right[rows, j, cut]], axis=1)
        return pa.table({"tree": pa.array([tree], pa.int32()), "first": pa.array([first], pa.int32()), "best": [best.tobytes()]})

    return choose


def _as_model(spark: SparkSession, estimator: Estimator, grown: Sequence[_Tree], cuts: Sequence[np.ndarray], classes: int):
    """The trees in the form in which Spark ML stores forests, read as its model."""
    kind = ("classification.RandomForestClassificationModel", "classification.DecisionTreeClassificationModel") if classes else (
        "regression.RandomForestRegressionModel", "regression.DecisionTreeRegressionModel")
    settings = {
        "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
        "paramMap": {p.name: v for p, v in estimator._paramMap.items()}, "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()}}
    whole = {"class": f"org.apache.spark.ml.{kind[0]}", "uid": estimator.uid, "numFeatures": len(cuts), "numTrees": len(grown), **settings}
    single = {"class": f"org.apache.spark.ml.{kind[1]}", **settings, "paramMap": {}, "defaultParamMap": {}}
    path = scratch_path(spark, "forest")
    nodes = pa.concat_tables([_stored(t, tree, cuts, classes) for t, tree in enumerate(grown)])
    spark.createDataFrame(nodes).write.parquet(f"{path}/data")
    spark.createDataFrame(
        [(t, json.dumps(single | {"uid": f"{estimator.uid}_{t}"}), 1.0) for t in range(len(grown))], "_1 int, _2 string, _3 double",
    ).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(whole | ({"numClasses": classes} if classes else {})),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(path)


def _stored(number: int, tree: _Tree, cuts: Sequence[np.ndarray], classes: int) -> pa.Table:
    """The nodes of a tree in depth-first order; where both children are leaves that predict alike the split is left out."""
    weight = _weight_of(tree.stats, classes)
    predicted = tree.stats.argmax(axis=1).astype(float) if classes else tree.stats[:, 1] / np.where(weight > 0, weight, 1)
    left, inner = tree.left.tolist(), tree.feature >= 0
    for node in np.flatnonzero(inner)[::-1].tolist():
        a = left[node]
        if not inner[a] and not inner[a + 1] and predicted[a] == predicted[a + 1]:
            inner[node] = False
    order, place, stack = [], {}, [0]
    while stack:
        node = stack.pop()
        place[node] = len(order)
        order.append(node)
        if inner[node]:
            stack += [left[node] + 1, left[node]]
    at = np.array(order)
    split = inner[at]
    child = lambda node, side: place[left[node] + side] if inner[node] else -1
    data = pa.StructArray.from_arrays([
        pa.array(range(len(order)), pa.int32()), pa.array(predicted[at]), pa.array(_spread_of(tree.stats[at], classes)),
        pa.array(list(tree.stats[at]), pa.list_(pa.float64())), pa.array(weight[at].astype(np.int64)), pa.array(np.where(split, tree.gain[at], -1.0)),
        pa.array([child(node, 0) for node in order], pa.int32()), pa.array([child(node, 1) for node in order], pa.int32()),
        pa.StructArray.from_arrays([
            pa.array(np.where(split, tree.feature[at], -1).astype(np.int32)),
            pa.array([[cuts[tree.feature[node]][tree.bin[node]]] if inner[node] else [] for node in order], pa.list_(pa.float64())),
            pa.array(np.full(len(order), -1, np.int32))], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]),
    ], ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": pa.array([number] * len(order), pa.int32()), "nodeData": data})
