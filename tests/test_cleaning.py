import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.functions.nulls import holds, nan_to_null
from wellspring.operators import chained, learning
from wellspring.operators.chained import iterative_impute
from wellspring.operators.duplicates import duplicate_count, remove_duplicates
from wellspring.operators.imputation import column_medians, handle_missing
from wellspring.operators.learning import forest_impute
from wellspring.operators.masking import add_noise, chance, mask_cells, mask_share
from wellspring.operators.neighbours import knn_impute
from wellspring.operators.profile import contract_nulls, missing_ranked, null_profile
from wellspring.session import settle


def test_three_wells_are_filled(three_wells):
    filled, history = handle_missing(three_wells, "median", {"Damage_Type": "most_frequent"})
    rows = {r["Well_ID"]: r for r in filled.collect()}
    assert filled.columns == three_wells.columns
    assert rows["WELL_003"]["Temperature_C"] == pytest.approx(100.4)
    assert rows["WELL_003"]["Formation"] == "Carbonate"
    assert rows["WELL_002"]["Damage_Type"] == "Clay & Iron"
    assert filled.schema["Pressure_psi"].dataType.simpleString() == "double"
    steps = {(r["column"], r["strategy"]): r["n_filled"] for r in history.collect()}
    assert steps["Temperature_C", "median"] == 1 and steps["Formation", "mode"] == 1


def test_two_columns(spark):
    df = spark.createDataFrame([(1500.0, 80.0), (None, 120.0), (3000.0, None)], "Pressure double, Temperature double")
    filled, _ = handle_missing(df)
    assert sorted(tuple(r) for r in filled.collect()) == [(1500.0, 80.0), (2250.0, 120.0), (3000.0, 100.0)]


@pytest.mark.parametrize("strategy", ["median", "mean", "knn", "iterative"])
def test_no_gaps_remain_and_known_cells_stay(spark, strategy):
    rows = [(float(i), 2.0 * i + 1 if i % 7 else None, float("nan") if i % 11 == 0 else i % 5 + 0.0, "abc"[i % 3] if i % 4 else None)
            for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double, t string")
    filled, _ = handle_missing(df, strategy)
    got = {r["a"]: r for r in filled.collect()}
    assert len(got) == 120
    for a, b, c, t in rows:
        r = got[a]
        assert None not in tuple(r) and not math.isnan(r["c"])
        assert b is None or r["b"] == b
        assert math.isnan(c) or r["c"] == c


def test_unknown_strategies_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, None)], "a double, b double, t string")
    with pytest.raises(ValueError):
        handle_missing(df, "nearest")
    with pytest.raises(ValueError):
        handle_missing(df, "mean", {"a": "best"})
    filled, _ = handle_missing(df, "mean", {"no_such_column": "best"})
    assert [tuple(r) for r in filled.collect()] == [(1.0, None, None), (1.0, None, None)]


def brute_force_neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        near = []
        for other in x:
            if np.isnan(other[j]):
                continue
            shared = ~np.isnan(x[i]) & ~np.isnan(other)
            if shared.any():
                near.append((math.sqrt(((x[i, shared] - other[shared]) ** 2).sum() * x.shape[1] / shared.sum()), other[j]))
        out[i, j] = np.mean([v for _, v in sorted(near)[:k]]) if near else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_knn_equals_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [20, 5, 2, 1]
    x[:, 1] = np.round(x[:, 1])
    if hot:
        x[:100] = x[0]  # a third of the rows are copies
        x[100:220, 0] = 3.0  # a further third shares the widest-spread value
    x[rng.random(x.shape) < 0.2] = np.nan
    x[7] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (i,) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, i int")
    got = knn_impute(df, ["a", "b", "c", "d"], k=5, rows_per_leaf=10).orderBy("i").select("a", "b", "c", "d").toPandas().to_numpy()
    np.testing.assert_allclose(got, brute_force_neighbours(x, 5), rtol=1e-9)


def test_knn_of_sparse_columns(spark):
    """Columns known in few rows, rows with few columns, ties; small leaves make trees of several levels."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 5)) * [20, 5, 2, 1, 3])
    x[rng.random(x.shape) < [0.97, 0.5, 0.3, 0.9, 0.4]] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (i,) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, i int")
    got = knn_impute(df, list("abcde"), k=3, rows_per_leaf=8).orderBy("i").select(*"abcde").toPandas().to_numpy()
    np.testing.assert_allclose(got, brute_force_neighbours(x, 3), rtol=1e-9)


def test_knn_of_more_columns_than_bits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 70))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(70)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (i,) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", i int")
    got = knn_impute(df, names, k=2, rows_per_leaf=16).orderBy("i").select(*names).toPandas().to_numpy()
    np.testing.assert_allclose(got, brute_force_neighbours(x, 2), rtol=1e-9)


def test_knn_compares_few_pairs_of_a_sparse_column(spark, monkeypatch):
    """Twice the rows make about twice the comparisons, not four times as many."""
    from wellspring.operators import neighbours

    def compared(n: int) -> int:
        pairs = spark.sparkContext.accumulator(0)
        inner = neighbours._nearest_donors

        def counted(d, k):
            work = inner(d, k)

            def run(facts, labels, asked):
                pairs.add(len(facts) * len(asked))
                return work(facts, labels, asked)
            return run

        with monkeypatch.context() as patch:
            patch.setattr(neighbours, "_nearest_donors", counted)
            df = spark.range(n).selectExpr("IF(id % 20 = 0, sin(id), NULL) AS a", "pmod(id * 7919, 10007) / 10007 AS b", "CAST(id % 3 AS DOUBLE) AS c")
            knn_impute(df, ["a", "b", "c"], k=3, rows_per_leaf=16).write.format("noop").mode("overwrite").save()
        return pairs.value

    small, large = compared(4000), compared(16000)
    assert large < 6 * small and large < 16000 * 800 / 4


def test_knn_settles_as_many_tables_for_more_rows(spark, monkeypatch):
    """Donors are moved once, not once for each level of cells."""
    from wellspring.operators import neighbours

    def settled(n: int) -> int:
        tables, inner = [], neighbours.settle
        with monkeypatch.context() as patch:
            patch.setattr(neighbours, "settle", lambda df: tables.append(1) or inner(df))
            df = spark.range(n).selectExpr("IF(id % 20 = 0, NULL, sin(id)) AS a", "pmod(id * 7919, 10007) / 10007 AS b", "CAST(id % 3 AS DOUBLE) AS c")
            knn_impute(df, ["a", "b", "c"], k=3, rows_per_leaf=4)
        return len(tables)

    assert settled(4000) == settled(50) < 6


def test_knn_with_a_small_sample_equals_brute_force(spark, monkeypatch):
    """Cells cut by a sample of a tenth, visitors of a cell in several parts, donors alike besides the value."""
    from wellspring.operators import neighbours

    for name, value in (("SAMPLE_ROWS", 50), ("SAMPLE_AT_LEAST", 50), ("ASKING_ROWS", 100), ("VISITS_PER_PART", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(500, 3)) * [9, 4, 30])
    x[:60, 1:] = [2.0, 5.0]
    x[rng.random(x.shape) < [0.6, 0.15, 0.1]] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (i,) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, i int")
    got = knn_impute(df, list("abc"), k=4, rows_per_leaf=4).orderBy("i").select(*"abc").toPandas().to_numpy()
    np.testing.assert_allclose(got, brute_force_neighbours(x, 4), rtol=1e-9)


def test_iterative_finds_a_linear_relation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    x[:, 2] = 3 * x[:, 0] - x[:, 1] + 2
    holes = np.zeros_like(x, dtype=bool)
    for i in range(0, 600, 4):
        holes[i, i // 4 % 3] = True
    y = np.where(holes, np.nan, x)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) + (i,) for i, r in enumerate(y)],
                               "a double, b double, c double, i int")
    got = iterative_impute(df, ["a", "b", "c"]).orderBy("i").select("a", "b", "c").toPandas().to_numpy()
    assert np.abs(got - x).max() < 1e-2


def test_iterative_by_patterns_equals_by_columns(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 2))
    x = np.column_stack([base[:, 0] * 4 + 7, base[:, 1], base.sum(axis=1) + rng.normal(size=500) * 0.1, base[:, 0] - base[:, 1]])
    holes = rng.random(x.shape) < [0.3, 0.0, 0.2, 0.1]
    rows = [(i, *[None if h else float(v) for v, h in zip(r, g)], None) for i, (r, g) in enumerate(zip(x, holes))]
    df = spark.createDataFrame(rows, "i int, `a.b` double, b double, c double, d double, hollow double")
    names, written = ["a.b", "b", "c", "d"], []
    monkeypatch.setattr(chained, "settle", lambda table: written.append(table) or settle(table))
    one = iterative_impute(df, [*names, "hollow"]).orderBy("i").toPandas()
    assert len(written) == 1 and one.columns.tolist() == df.columns and one["hollow"].isna().all()
    two = iterative_impute(df, [*names, "hollow"], pattern_bytes=0).orderBy("i").toPandas()
    assert len(written) > 2
    one, two = one[names].to_numpy(), two[names].to_numpy()
    assert np.allclose(one, two, atol=1e-8) and (one[~holes] == x[~holes]).all()
    assert np.abs(one - x)[holes].sum() < 0.5 * np.abs(x.mean(axis=0) - x)[holes].sum()


def test_forest_imputation(spark):
    rows = [(i, float(i % 10), 5.0 * (i % 10) if i % 6 else None, ("low" if i % 10 < 5 else "high") if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double, t string")
    filled, counts = forest_impute(df, ["y", "t"], trees=10, max_depth=6)
    got = filled.collect()
    assert counts == {"y": 67, "t": 58} and len(got) == 400
    assert all(r["t"] == ("low" if r["x"] < 5 else "high") for r in got)
    assert all(abs(r["y"] - 5 * r["x"]) < 6 for r in got)


def test_forest_imputation_writes_the_table_once(spark, monkeypatch):
    rows = [(i, float(i % 10), 5 * (i % 10) if i % 6 else None, i % 10 > 4 if i % 7 else None, None, "a") for i in range(300)]
    df = spark.createDataFrame(rows * 2, "id int, x double, y int, b boolean, hollow string, t string")
    written = []
    monkeypatch.setattr(learning, "settle", lambda table: written.append(table) or settle(table))
    filled, counts = forest_impute(df, trees=5, max_depth=5)
    assert filled.columns == df.columns and counts == {"y": 100, "b": 86, "hollow": 600}
    assert len(written) == 3 and all(c.startswith("_") for table in written[1:] for c in table.columns)
    got = filled.collect()
    assert len(got) == 600 and all(r["hollow"] is None and abs(r["y"] - 5 * r["x"]) < 6 for r in got)
    assert all(r["b"] == (r["x"] > 4) for r in got) and all(r["y"] == 5 * (r["id"] % 10) for r in got if r["id"] % 6)
    same, none = forest_impute(df.select("id", "t"))
    assert none == {} and same.count() == 600


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (2, "a"), (2, "a")], "k int, t string")
    once = remove_duplicates(df)
    assert once.count() == 3 and remove_duplicates(once).count() == 3
    assert tuple(duplicate_count(df).first()) == (6, 3, 3)


def test_null_rules(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "v double")
    clean = nan_to_null(df)
    mask = holds(F.col("v") > 3)
    assert clean.where(mask).count() == 1 and clean.where(~mask).count() == 3
    assert null_profile(df).first()["n_missing"] == 2
    assert missing_ranked(df).first()["over_threshold"]
    absent = {r["column"]: r["n_missing"] for r in contract_nulls(df, ["v", "w"]).collect()}
    assert absent == {"v": 2, "w": 4}


def test_masking(spark):
    df = spark.range(5000).select("id", (F.col("id") * 1.0).alias("x"), F.lit("t").alias("t"))
    masked = mask_share(df, ["id"], share=0.05, cells=8)
    counts = masked.agg(F.count_if(F.col("x").isNull()), F.count_if(F.col("t").isNull()), F.count("*")).first()
    assert tuple(counts) == (250, 250, 5000)
    share = mask_cells(df, ["id"], percent=20.0).agg(F.avg(F.col("x").isNull().cast("int"))).first()[0]
    assert abs(share - (1 - math.exp(-0.2))) < 0.02
    noise = add_noise(df.withColumn("was", F.col("x")), ["id"], ["x"], 0.0, 0.1).select((F.col("x") - F.col("was")).alias("e"))
    mean, std = noise.agg(F.avg("e"), F.stddev_pop("e")).first()
    assert abs(mean) < 0.01 and abs(std - 0.1) < 0.01
    even = spark.range(20000).select(chance(["id"], "x").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(even[0] - 0.5) < 0.02 and 0 <= even[1] and even[2] < 1


def test_median_of_long_column_with_ties(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10.0).alias("v"))
    exact = df.agg(F.median("v")).first()[0]
    assert column_medians(df, ["v"], exact_limit=200)["v"] == pytest.approx(exact, abs=1e-12)
