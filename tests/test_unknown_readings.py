"""NaN counts as unknown in models and probabilities, and a fitted pipeline can be saved."""

import math

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from wellspring.operators import learning
from wellspring.operators.damage import damage_probability
from wellspring.operators.isolation import isolation_scores

NAN = float("nan")


def test_unknown_readings_leave_the_probability(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, NAN), (3, None), (4, 1e9)], "id int, weight double")
    one = F.lit(1.0)
    found = {r["id"]: r["p"] for r in rows.select("id", damage_probability(F.lit("Salt"), F.col("weight"), one, one, F.lit(10.0), one, one).alias("p")).collect()}
    assert math.isclose(found[1], 0.5 * found[2]) and found[2] == found[3] and found[4] > found[2]


def test_saved_pipeline_predicts_alike_and_takes_nan_as_gap(spark, tmp_path):
    rows = [(float(i % 7), NAN if i % 9 == 0 else float(i % 11), "ab"[i % 2], "high" if i % 7 > 3 else "low") for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, kind string, label string")
    gaps = df.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    model = learning.build_classifier(["x", "y"], ["kind"], trees=5, max_depth=4).fit(df)
    assert learning.build_classifier(["x", "y"], ["kind"], trees=5, max_depth=4).fit(gaps).stages[0].facts == model.stages[0].facts
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    answers = lambda m, d: [tuple(r) for r in learning.predict_labels(m, d).orderBy("x", "kind").select("x", "kind", "predicted_label").collect()]
    assert answers(again, df) == answers(model, df) == answers(model, gaps)
    assert all(math.isfinite(r["y_scaled"]) for r in model.transform(df).select("y_scaled").collect())


def test_scores_with_nan(spark):
    df = spark.createDataFrame([(i, NAN if i % 10 == 0 else float(i % 13), float(i % 5)) for i in range(150)] + [(999, 500.0, 90.0)], "id int, a double, b double")
    scores = {r["id"]: r["anomaly_score"] for r in isolation_scores(df, ["a", "b"], trees=40).collect()}
    assert all(math.isfinite(s) for s in scores.values()) and max(scores, key=scores.get) == 999
