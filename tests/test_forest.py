"""Forests: each pass against a plain version on the same draws, and whole fits against those of Spark ML."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from wellspring.operators import forest, learning


def test_draws_are_poisson_of_mean_one():
    draws = forest._Draws(-7)
    drawn = np.concatenate([draws.of(t, b << 32, 50_000) for t in range(10) for b in range(4)])
    assert (draws.of(3, 2 << 32, 50_000) == drawn[14 * 50_000:15 * 50_000]).all() and len(draws.of(0, 0, 3)) == 3
    for value in range(8):
        share = math.exp(-1) / math.factorial(value)
        assert abs((drawn == value).mean() - share) < 5 * math.sqrt(share / len(drawn))
    assert drawn.max() < 20


def test_cuts_are_those_of_spark():
    few = forest._cuts(*forest._thinned(np.array([3.0, 1.0, 2.0, 1.0]), np.array([1, 1, 1, 1]), 10), 4)
    assert few.tolist() == [1.5, 2.5]
    many = forest._cuts(np.arange(100.0), np.ones(100, int), 4)
    assert many.tolist() == [24.5, 49.5, 74.5]
    values, counts = forest._thinned(np.arange(10_000.0), np.ones(10_000, int), 100)
    assert counts.sum() == 10_000 and len(values) <= 101 and counts.max() <= 103


def test_cuts_of_a_table_come_from_all_rows(spark):
    rows = spark.range(3000, numPartitions=3).select(F.array(F.col("id") % 5, F.col("id") * 1.0).cast("array<double>").alias("x"))
    some, spread = forest.feature_cuts(rows, 2, 10)
    assert some.tolist() == [0.5, 1.5, 2.5, 3.5] and spread.tolist() == [300 * i - 0.5 for i in range(1, 10)]


def plain_best(codes, y, w, features, cuts, classes):
    """Feature, cut and gain of the best split of some rows, one cut after the other."""
    def spread(some):
        n = w[some].sum()
        if classes:
            return 1 - sum((w[some][y[some] == c].sum() / n) ** 2 for c in range(classes))
        return np.average((y[some] - np.average(y[some], weights=w[some])) ** 2, weights=w[some])

    tried, everything = [], np.ones(len(y), bool)
    for f in features:
        for cut in range(cuts[f]):
            left = codes[f] <= cut
            a, b = w[left].sum(), w[~left].sum()
            if a and b:
                tried.append((spread(everything) - (a * spread(left) + b * spread(~left)) / (a + b), f, cut))
    return max(tried)


@pytest.mark.parametrize("classes", [3, 0])
@pytest.mark.parametrize("small", [False, True])
def test_a_pass_equals_a_plain_one(classes, small, monkeypatch):
    """Two levels of two trees, dealt over two tasks; with small limits nodes are counted in several goes and groups."""
    if small:
        monkeypatch.setattr(forest, "COUNTED_CELLS", 40)
    rng, d, bins, cuts, step = np.random.default_rng(5), 4, 6, np.array([5, 5, 3, 0]), 1 if small else 100
    width = classes or 3
    blocks = []
    for number in range(4):
        codes = np.stack([rng.integers(0, c + 1, 300) for c in cuts]).astype(np.uint8)
        y = (codes[0] + rng.integers(0, 2, 300) + (codes[1] > 2)) % 3 if classes else codes[1] * 2.0 + codes[0] + rng.random(300)
        blocks.append((number, codes, y.astype(np.int32 if classes else float)))
    trees = [forest._Tree() for _ in range(2)]
    for depth in range(2):
        looked = {t: rng.random((len(tree.open), d)).argpartition(1, axis=1)[:, :3] for t, tree in enumerate(trees)}
        known = SimpleNamespace(value=({t: tree.state(classes) for t, tree in enumerate(trees)}, looked))
        count, parts = forest._counted(known, d, bins, classes, step, 11), {}
        for task in (blocks[:3], blocks[3:]):
            batch = pa.RecordBatch.from_pydict({
                "block": [b[0] for b in task], "n": [300] * len(task), "codes": [b[1].tobytes() for b in task], "target": [b[2].tobytes() for b in task]})
            for out in count(iter([batch])):
                parts.setdefault((out["tree"][0].as_py(), out["first"][0].as_py()), []).append(out)
        for t, tree in enumerate(trees):
            best = np.zeros((len(tree.open), 3 + 2 * width))
            for (of, first), found in parts.items():
                if of == t:
                    got = np.frombuffer(forest._chosen(known, cuts, bins, classes, step)(pa.Table.from_batches(found))["best"][0].as_py()).reshape(-1, 3 + 2 * width)
                    best[first:first + len(got)] = got
            codes, y = np.concatenate([b[1] for b in blocks], axis=1), np.concatenate([b[2] for b in blocks])
            w = np.concatenate([forest._Draws(11).of(t, b[0], 300) for b in blocks]).astype(float)
            node = np.zeros(len(y), int)
            for _ in range(depth):
                node = tree.left[node] + (codes[tree.feature[node], np.arange(len(y))] > tree.bin[node])
            for i, at in enumerate(tree.open):
                here = (node == at) & (w > 0)
                gain, f, cut = plain_best(codes[:, here], y[here], w[here], looked[t][i], cuts, classes)
                assert (best[i, 0], best[i, 1]) == (f, cut) and best[i, 2] == pytest.approx(gain)
                left = here & (codes[f] <= cut)
                sums = [w[left & (y == c)].sum() for c in range(classes)] if classes else [w[left].sum(), (w * y)[left].sum(), (w * y * y)[left].sum()]
                assert best[i, 3:3 + width].tolist() == pytest.approx(sums)
            forest._split(tree, best, width, classes, False, False)


def test_forests_are_as_good_as_those_of_spark(spark):
    """The same shares of right labels and squared errors on rows kept apart, with labels that follow from the numbers only in part."""
    x, y, z = ((F.hash("id", F.lit(s)) % 1000 / 1000.0) for s in (1, 2, 3))
    rows = spark.range(6000).select("id", x.alias("a"), y.alias("b"), z.alias("c")).withColumn("size", F.col("a") * 10 + F.col("b") * F.col("c") * 5 + F.hash("id") % 100 / 100.0)
    rows = rows.withColumn("kind", F.when(F.col("size") > 3, 2.0).when(F.col("a") * F.col("b") > 0, 1.0).otherwise(0.0))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    setting = {"numTrees": 20, "maxDepth": 7, "seed": 3}
    right = [learning.accuracy(kind(labelCol="kind", **setting).fit(train).transform(test), "kind") for kind in (RandomForestClassifier, learning.SpreadForest)]
    wrong = [learning.mean_squared_error(kind(labelCol="size", featureSubsetStrategy="all", **setting).fit(train).transform(test), "size")
             for kind in (RandomForestRegressor, learning.SpreadForestRegressor)]
    assert abs(right[0] - right[1]) < 0.02 and right[1] > 0.85 and 0.9 < wrong[1] / wrong[0] < 1.1


def test_a_fit_leaves_no_tree_to_spark_and_refuses_what_it_does_not_use(spark, monkeypatch):
    """Spark's own fit sends statistics of all nodes from all tasks as objects, which took most of the time."""
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(float(i % 8), float(i % 8 > 4)) for i in range(200)], "x double, label double"))
    for kind in (learning.SpreadForest, learning.SpreadForestRegressor):
        monkeypatch.setattr(kind, "_fit_java", lambda *_: pytest.fail("fitted by Spark"))
        model = kind(numTrees=4, maxDepth=3, seed=1).fit(rows)
        assert "feature 0 <= 4.5" in model.toDebugString and model.getNumTrees == 4 and model.totalNumNodes == 12
        assert model.transform(rows).where("prediction <> label").isEmpty()
        with pytest.raises(ValueError, match="minInstancesPerNode"):
            kind(minInstancesPerNode=5).fit(rows)
        with pytest.raises(ValueError, match="rows"):
            kind().fit(rows.limit(0))


def test_a_split_writes_the_rows_to_learn_from_once(spark, monkeypatch):
    written, rows = [], spark.range(500).withColumn("x", F.col("id") % 7)
    settle = learning.settle
    monkeypatch.setattr(learning, "settle", lambda table: written.append(table) or settle(table))
    train, test = learning.split_rows(rows)
    assert len(written) == 1 and train.inputFiles()
    for got, want in zip((train, test), rows.randomSplit([0.8, 0.2], learning.SEED), strict=True):
        assert got.exceptAll(want).isEmpty() and got.count() == want.count()
