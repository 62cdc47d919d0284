import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellspring.operators import isolation
from wellspring.operators.isolation import isolation_flags, isolation_scores, tree_samples
from wellspring.operators.keyed import attach_by_key, fits_broadcast
from wellspring.operators.outliers import flag_outliers, outlier_counts, split_by_flag
from wellspring.operators import keyed, ordered, quantiles
from wellspring.operators.quantiles import approximate_percentiles, column_percentiles, grouped_percentiles, order_statistics
from wellspring.session import settle


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows belong to one key, half of those share one value."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.when(F.col("id") % 3 == 1, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")).alias("v"),
        (F.col("id") % 97).cast("double").alias("w"), "id")


def as_dict(df, *columns):
    return {r["k"]: tuple(tuple(r[c]) for c in columns) for r in df.collect()}


def test_grouped_percentiles_of_a_hot_key(skewed):
    plain = as_dict(grouped_percentiles(skewed, ["k"], ["v", "w"], [0.1, 0.25, 0.75]), "v_p", "w_p")
    counted = as_dict(grouped_percentiles(skewed, ["k"], ["v", "w"], [0.1, 0.25, 0.75], exact_limit=300), "v_p", "w_p")
    assert plain.keys() == counted.keys()
    for k in plain:
        np.testing.assert_allclose(plain[k], counted[k], rtol=1e-12)


def test_grouped_percentiles_when_the_sketch_misses(skewed, monkeypatch):
    """A sketch this coarse cannot enclose the ranks, so the keys are counted again without bounds."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 10**9)
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, shares, accuracy: F.percentile(c, [min(1.0, s + 0.3) for s in shares]))
    got = as_dict(grouped_percentiles(skewed, ["k"], ["v", "w"], [0.1, 0.5], exact_limit=1000), "v_p", "w_p")
    want = as_dict(skewed.groupBy("k").agg(*[F.percentile(c, [0.1, 0.5]).alias(f"{c}_p") for c in "vw"]), "v_p", "w_p")
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)


def test_long_groups_need_no_sort_merge_join(spark, skewed, monkeypatch):
    plans, threshold = [], "spark.sql.autoBroadcastJoinThreshold"
    for module in (quantiles, keyed, ordered):
        monkeypatch.setattr(module, "settle", lambda table: plans.append(table) or settle(table))
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = grouped_percentiles(skewed, ["k"], ["v", "w"], [0.25, 0.75], exact_limit=300)
        texts = [table._jdf.queryExecution().executedPlan().toString() for table in [*plans, found]]
    finally:
        spark.conf.set(threshold, before)
    assert len(texts) > 3 and any("BroadcastHashJoin" in t for t in texts)
    assert not any("SortMergeJoin" in t or "ShuffledHashJoin" in t for t in texts)


def test_grouped_percentiles_with_an_empty_column(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    got = {r["k"]: r for r in grouped_percentiles(df, ["k"], ["a", "b"], [0.5], exact_limit=10).collect()}
    assert got[0]["a_p"] == [49.0] and got[1]["a_p"] == [50.0]
    assert got[0]["b_p"] in (None, [None])


@pytest.mark.parametrize("limit,accuracy", [(10**6, 10_000), (100, 50), (20, 20)])
def test_column_percentiles_by_narrowing(skewed, limit, accuracy):
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = column_percentiles(skewed, ["v", "w"], shares, limit, accuracy)
    pdf = skewed.select("v", "w").toPandas()
    for c in ("v", "w"):
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], shares), rtol=1e-12)
    assert order_statistics(skewed, {"w": 17}, limit, accuracy)["w"] == np.sort(pdf["w"])[17]


def test_percentiles_of_empty_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert column_percentiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.5]}
    assert column_percentiles(df, ["a", "b"], [0.5], exact_limit=1) == {"a": [None], "b": [1.5]}
    assert approximate_percentiles(df, ["a"], [0.5]) == {"a": [None]}


def test_split_is_a_partition_of_the_rows(skewed):
    flagged = flag_outliers(skewed, ["v", "w"], ["k"], z_threshold=1.5)
    clean, outliers = split_by_flag(flagged)
    both = clean.unionAll(outliers).drop("is_outlier")
    assert both.exceptAll(skewed).isEmpty() and skewed.exceptAll(both).isEmpty()
    counts = outlier_counts(flagged, ["k"]).agg(F.sum("n_clean"), F.sum("n_outliers")).first()
    assert counts[0] + counts[1] == 6000 and counts[1] > 0


def test_null_constant_and_null_key(spark):
    df = spark.createDataFrame([(None, 3.0, 1.0), (None, 3.0, None), (None, 3.0, 1.0), ("a", 3.0, 100.0)], "k string, c double, v double")
    flagged = flag_outliers(df, ["c", "v"], ["k"])
    assert flagged.count() == 4 and flagged.where("is_outlier").count() == 0
    with pytest.raises(ValueError):
        flag_outliers(df, ["c"], methods=["mad"])


def test_keyed_join_with_salts_equals_broadcast(spark, skewed):
    facts = skewed.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    facts = facts.unionByName(spark.createDataFrame([(None, 1, 9.0)], "k string, n long, m double"))
    rows = skewed.select("k", "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    broadcast = attach_by_key(rows, facts, ["k"], weight="n")
    salted = attach_by_key(rows, facts, ["k"], weight="n", broadcast_bytes=0)
    counted = attach_by_key(rows, facts, ["k"], broadcast_bytes=0)
    assert salted.count() == 6001
    assert broadcast.exceptAll(salted).isEmpty() and salted.exceptAll(counted).isEmpty()
    assert salted.where("id = -1").first()["m"] == 9.0


def test_long_texts_are_not_broadcast(spark):
    few_but_long = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert fits_broadcast(few_but_long, 11_000) and not fits_broadcast(few_but_long, 10_000)
    assert fits_broadcast(few_but_long.limit(0), 0)
    nested = spark.range(10).select(F.array_repeat(F.lit("abcdefghij"), 100).alias("a"))
    assert not fits_broadcast(nested, 10_000)


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1500, 2)))]
    rows += [(10_000 + i, 9.0 + i, -9.0 - i) for i in range(15)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    flagged = isolation_flags(df, ["a", "b"], contamination=0.02, exact_limit=100)
    found = {r["id"] for r in flagged.where("is_outlier").collect()}
    assert {10_000 + i for i in range(15)} <= found
    assert abs(len(found) / len(rows) - 0.02) < 0.005
    scores = isolation_scores(df, ["a", "b"]).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 < scores[0] < 0.5 < scores[1] < 1


def test_isolation_forest_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), None if i % 9 == 0 else float("nan") if i % 9 == 1 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    samples = tree_samples(df, ["a"], 10, 64, 1)
    assert {r["count"] for r in samples.groupBy("tree").count().collect()} == {64}
    assert samples.select("tree", "x0").distinct().count() == 640

    def scores(frame):
        return [r[0] for r in isolation_scores(frame, ["a", "b"], trees=20).orderBy("id").select(F.round("anomaly_score", 9)).collect()]

    assert scores(df.coalesce(1)) == scores(df.repartition(7, "a"))


def test_isolation_samples_of_repeated_and_few_rows(spark):
    """A third of the rows are one row: it counts once. A limit that lets too few through is raised."""
    df = spark.range(900).selectExpr("IF(id % 3 = 0, -1, id) AS a")
    samples = tree_samples(df, ["a"], 4, 700, 1)
    assert sorted(r["count"] for r in samples.groupBy("tree").count().collect()) == [601] * 4
    drawn = tree_samples(df, ["a"], 4, 256, 1)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {256}
    assert drawn.where("x0 = -1").groupBy("tree").count().where("count > 1").isEmpty()
    assert tree_samples(df.limit(0), ["a"], 4, 256, 1).isEmpty()


def test_isolation_samples_of_one_file_are_drawn_by_all_cores(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id", "id % 97 * 1.5 AS x").coalesce(1).write.parquet(f"{tmp_path}/one")
    one, dealt, deal = spark.read.parquet(f"{tmp_path}/one"), [], isolation.spread
    monkeypatch.setattr(isolation, "spread", lambda df: [deal(df), dealt.append(deal(df).rdd.getNumPartitions())][0])
    drawn = {tuple(r) for r in tree_samples(one, ["x"], 5, 50, 1).select("tree", "x0").collect()}
    assert dealt == [spark.sparkContext.defaultParallelism]
    monkeypatch.setattr(isolation, "spread", lambda df: df)
    assert drawn == {tuple(r) for r in tree_samples(one, ["x"], 5, 50, 1).select("tree", "x0").collect()}


def test_trees_in_level_order_lead_to_the_same_lengths():
    grown = isolation._grow(3, 6, 2)(pd.DataFrame(np.column_stack([np.zeros(60), np.random.default_rng(1).normal(size=(60, 2)).round(1)]), columns=["tree", "x0", "x1"]))
    nodes = grown[["feature", "cut", "below", "above", "length"]].to_numpy(float)
    feature, cut, length = isolation._level_order(nodes, 6)
    for point in np.vstack([np.random.default_rng(2).normal(size=(200, 2)).round(1), [[np.inf, -np.inf]]]):
        at, place = 0, 0
        while nodes[at, 0] >= 0:
            at = int(nodes[at, 2] if point[int(nodes[at, 0])] <= nodes[at, 1] else nodes[at, 3])
        for _ in range(6):
            place = 2 * place + 1 + (point[feature[place]] > cut[place])
        assert length[place - len(feature)] == nodes[at, 4]
