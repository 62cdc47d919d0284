import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.jobs import arguments, run
from wellspring.operators import learning
from wellspring.operators.outliers import flag_outliers
from wellspring.plans import folder_jobs
from wellspring.plans.processing import ProcessingConfig, load, process, process_file
from wellspring.plans.quality import quality_report, save_report
from wellspring.session import scratch_root
from wellspring.sources import readers, writers
from wellspring.streaming import records
from wellspring.vocabulary import to_canonical
from workloads.flows import stored_file
from workloads.inputs import table, telemetry


def test_file_to_features(spark, three_wells, tmp_path):
    path = str(tmp_path / "wells")
    three_wells.write.parquet(path)
    done = process_file(spark, path, ProcessingConfig(remove_outliers=False))
    rows = done.data.collect()
    assert len(rows) == 3 and "PT_Ratio" in done.data.columns and all(None not in tuple(r) for r in rows)
    assert "Feature_Inconsistency" in done.data.columns and done.created_features[0] == "PT_Ratio"
    report = {(r["check"], r["metric"]): r["value"] for r in done.report.where("column IS NULL").collect()}
    assert report["feature_inconsistencies", "skipped_rules"] == 20
    assert process(load(spark, path)).data.count() <= 3
    with pytest.raises(ValueError):
        process(three_wells, ProcessingConfig(outlier_method="magic"))
    three_wells.limit(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "empty"))


def test_report_file(spark, sf, tmp_path):
    flagged, report = quality_report(telemetry(spark, sf))
    save_report(report, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report"))
    total = back.where("check = 'feature_inconsistencies' AND metric = 'total'").first()["value"]
    assert total == flagged.where("Feature_Inconsistency").count() > 0
    assert back.where("check = 'logical_inconsistencies'").count() == 2


@pytest.fixture()
def folder(spark, tmp_path):
    """Two files with outliers, one without a needed column, one that is no parquet file."""
    path = tmp_path / "in"
    os.makedirs(path)
    base = spark.range(200).select(F.col("id"), *[(F.col("id") % 10).cast("double").alias(c) for c in ("temperature", "pressure")])
    for i, name in enumerate(("a", "b")):
        wide = base.withColumn("temperature", F.when(F.col("id") < 3 + i, 500.0).otherwise(F.col("temperature")))
        _single(wide, str(path / f"{name}.parquet"))
    _single(base.drop("pressure"), str(path / "c.parquet"))
    (path / "d.parquet").write_text("no parquet")
    return str(path)


def _single(df, target):
    import shutil
    df.coalesce(1).write.parquet(target + ".dir")
    shutil.move(glob.glob(target + ".dir/part-*.parquet")[0], target)
    shutil.rmtree(target + ".dir")


def test_outlier_folder(spark, folder, tmp_path):
    counts, skipped = folder_jobs.split_outliers_folder(
        spark, folder, str(tmp_path / "clean"), str(tmp_path / "out"), ["temperature", "pressure"])
    assert {r["source_file"]: (r["n_clean"], r["n_outliers"]) for r in counts.collect()} == {
        "a.parquet": (197, 3), "b.parquet": (196, 4)}
    reasons = {os.path.basename(r["file"]): r["reason"] for r in skipped.collect()}
    assert reasons["c.parquet"] == "missing columns: pressure" and reasons["d.parquet"].startswith("unreadable")
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 393
    assert spark.read.parquet(str(tmp_path / "out")).where("source_file = 'b.parquet'").count() == 4
    none, _ = folder_jobs.split_outliers_folder(spark, folder, str(tmp_path / "x"), str(tmp_path / "y"), ["salinity"])
    assert none.isEmpty()


def test_flag_and_disturb_folder(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    telemetry(spark, sf).drop("datetime").coalesce(2).write.parquet(source)
    counted, skipped = folder_jobs.flag_folder(spark, source, str(tmp_path / "flagged"), str(tmp_path / "summary"))
    row = counted.agg(F.sum("total_records"), F.sum("anomalies")).first()
    assert row[0] == telemetry(spark, sf).count() and 0 < row[1] < row[0]
    assert spark.read.csv(str(tmp_path / "summary"), header=True).count() == counted.count()
    folder_jobs.disturb_folder(spark, source, str(tmp_path / "noisy"), ["order_id", "line_id", "part_id", "well_id"])
    share = spark.read.parquet(str(tmp_path / "noisy")).agg(F.avg(F.col("viscosity").isNull().cast("int"))).first()[0]
    assert 0.03 < share < 0.07 and skipped.isEmpty()


def test_folders_with_bad_files_and_equal_names(spark, folder, tmp_path):
    deeper = os.path.join(folder, "north field")
    os.makedirs(deeper)
    base = spark.range(50).select("id", (F.col("id") % 10).cast("double").alias("temperature"), F.lit(1.0).alias("pressure"))
    _single(base, os.path.join(deeper, "a.parquet"))
    _single(base.limit(0), os.path.join(folder, "hollow.parquet"))
    found = {r["file"].split("/in/")[1]: (r["n_rows"], r["reason"]) for r in
             readers.file_manifest(spark, folder, ["Pressure"]).collect()}
    assert found.pop("d.parquet")[1].startswith("unreadable")
    assert found == {"a.parquet": (200, None), "b.parquet": (200, None), "c.parquet": (200, "missing columns: Pressure"),
                     "north field/a.parquet": (50, None), "hollow.parquet": (0, None)}
    counted, skipped = folder_jobs.flag_folder(spark, folder, str(tmp_path / "flagged"), str(tmp_path / "summary"))
    assert {r["source_file"]: r["total_records"] for r in counted.collect()} == {
        "a.parquet": 200, "b.parquet": 200, "c.parquet": 200, "north%20field/a.parquet": 50}
    assert skipped.count() == 1
    missed = folder_jobs.disturb_folder(spark, folder, str(tmp_path / "noisy"), ["id"])
    noisy = spark.read.parquet(str(tmp_path / "noisy"))
    assert missed.count() == 1 and noisy.count() == 650 and noisy.where("source_file IS NULL").isEmpty()
    none, all_of_them = readers.read_usable(spark, folder, ["salinity"])
    assert none is None and all_of_them.count() == 6


def test_jobs(spark, sf, folder, three_wells, tmp_path):
    out = str(tmp_path / "jobs")
    run(spark, arguments(["split-outliers", "--input", folder, "--output", f"{out}/split", "--columns", "temperature", "pressure"]))
    assert spark.read.parquet(f"{out}/split/outliers").count() == 7 and spark.read.json(f"{out}/split/skipped").count() == 2
    three_wells.write.parquet(str(tmp_path / "wells"))
    run(spark, arguments(["process", "--input", str(tmp_path / "wells"), "--output", f"{out}/done", "--outlier-method", "iqr"]))
    assert "PT_Ratio" in spark.read.parquet(f"{out}/done/data").columns
    assert spark.read.json(f"{out}/done/history").count() > 0 and spark.read.json(f"{out}/done/report").count() > 0
    with pytest.raises(SystemExit):
        arguments(["flag"])


def test_readers_and_writers(spark, sf, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.5), (2, None, None)], "a int, b string, c double")
    writers.write_summary_csv(df, str(tmp_path / "csv"))
    assert sorted(readers.read_csv(spark, str(tmp_path / "csv"), df.schema).collect()) == sorted(df.collect())
    flagged = flag_outliers(table(spark, sf, "events"), ["value"])
    writers.write_split(flagged, "is_outlier", str(tmp_path / "clean"), str(tmp_path / "out"))
    sizes = [spark.read.parquet(str(tmp_path / n)).count() for n in ("clean", "out")]
    assert sum(sizes) == flagged.count() and all(sizes)
    options = writers.jdbc_options("jdbc:postgresql://db/x", "u", "p")
    assert options["batchsize"] == "100" and options["dbtable"] == "well_records"
    assert readers.kafka_options("h:1", "t", "g")["startingOffsets"] == "earliest"


def test_nanosecond_files(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    moments = pd.to_datetime(["2023-01-01 00:00:01.000000001", "1969-12-31 23:59:59.999999500", None])
    pq.write_table(pa.table({"DateTime": pa.array(moments, pa.timestamp("ns")), "v": [1, 2, 3]}), str(tmp_path / "n.parquet"))
    df = readers.read_nano_parquet(spark, str(tmp_path / "n.parquet")).orderBy("v")
    assert [str(r["DateTime"]) for r in df.collect()] == ["2023-01-01 00:00:01", "1969-12-31 23:59:59.999999", "None"]


def test_stream_equals_batch(spark, sf, tmp_path):
    """Records as JSON files in two batches, with a broken line, through alerts; a second start finds nothing new."""
    tel = to_canonical(stored_file(spark, sf)).withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss"))
    fields = [f for f in tel.columns if f in {x.name for x in __import__("wellspring").vocabulary.record_schema()}]
    schema = T.StructType([tel.schema[f] for f in fields])
    messages = records.encode_records(tel, "record_id", fields)
    bad = spark.createDataFrame([("x", '{"record_id": 1, "rop"')], "key string, value string")
    source = str(tmp_path / "topic")
    messages.unionByName(bad).repartition(2).write.json(source)
    stream = readers.read_file_stream(spark, source, "key string, value string", "json", files_per_batch=1)
    decoded = records.decode_records(stream, schema)
    found = records.run_available(records.alerts(records.readable_records(decoded), ["Generic Damage"]))
    want = records.alerts(tel.select(*fields), ["Generic Damage"])
    assert found.count() == want.count() > 0
    assert found.groupBy("damage_type").count().exceptAll(want.groupBy("damage_type").count()).isEmpty()
    paths = [str(tmp_path / n) for n in ("good", "broken", "check")]
    for _ in range(2):
        records.start_with_broken_branch(stream, schema, *paths).awaitTermination()
        assert spark.read.parquet(paths[0]).count() == tel.count()
        assert [r["key"] for r in spark.read.parquet(paths[1]).collect()] == ["x"]


def test_classifier(spark):
    rows = [(float(i % 20), "red" if i % 2 else None, "big" if i % 20 >= 10 else "small") for i in range(400)]
    df = spark.createDataFrame(rows, "x double, colour string, size string")
    model = learning.build_classifier(["x"], ["colour"], "size", trees=5, max_depth=4).fit(df)
    unseen = spark.createDataFrame([(2.0, "blue"), (None, None), (17.0, "red")], "x double, colour string")
    got = [r["predicted_label"] for r in learning.predict_labels(model, unseen).collect()]
    assert got[0] == "small" and got[2] == "big" and len(got) == 3
    assert learning.accuracy(model.transform(df)) > 0.95
    selected, features = learning.training_selection(df.withColumn("Record_ID", F.lit(1)), "size")
    assert features == ["x"] and selected.columns == ["size", "x"]
    boosted = learning.build_classifier(["x"], ["colour"], "size", trees=3, max_depth=3, method="boosted").fit(df)
    assert [r["predicted_label"] for r in learning.predict_labels(boosted, unseen).collect()][::2] == ["small", "big"]
    with pytest.raises(ValueError):
        learning.build_classifier(["x"], [], "size", method="straight")
    squares = df.select(F.col("x").alias("prediction"), (F.col("x") + 2).alias("y"))
    assert learning.mean_squared_error(squares, "y") == pytest.approx(4.0)


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.sparkContext.getCheckpointDir()


def test_models_are_fitted_by_all_cores_to_equal_rows_once(spark, monkeypatch):
    """A table in one file is dealt out before the trees pass over it; boosted trees see equal rows as one."""
    rows = spark.createDataFrame([(float(i % 6), "low" if i % 6 < 3 else "high") for i in range(600)], "x double, grade string").coalesce(1)
    seen, deal = [], learning.training_rows

    def noted(df, *columns):
        dealt = deal(df, *columns)
        seen.append((dealt.rdd.getNumPartitions(), dealt.count()))
        return dealt

    monkeypatch.setattr(learning, "training_rows", noted)
    for method, fitted_to in (("forest", 600), ("boosted", 6)):
        model = learning.build_classifier(["x"], [], "grade", trees=3, max_depth=3, method=method).fit(rows)
        assert seen.pop() == (spark.sparkContext.defaultParallelism, fitted_to) and not seen
        assert learning.predict_labels(model, rows).where("grade <> predicted_label").isEmpty()


def test_clusters_are_fitted_in_small_tasks(spark, monkeypatch):
    """A task keeps its rows as vectors, many times what they take in a file."""
    rows, parts, deal = spark.range(4000).selectExpr("id", "id % 4 * 10.0 AS x").coalesce(1), [], learning.training_rows
    monkeypatch.setattr(learning, "ROWS_PER_TASK", 400)
    monkeypatch.setattr(learning, "training_rows", lambda df, *columns: [deal(df, *columns), parts.append(deal(df, *columns).rdd.getNumPartitions())][0])
    found = learning.cluster_rows(rows, ["x"], 4)
    assert parts == [10] and found.columns == ["id", "x", "cluster"] and found.count() == 4000
    assert found.groupBy("x").agg(F.countDistinct("cluster").alias("n")).where("n > 1").isEmpty()
