import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wellspring.operators import ordered
from workloads.inputs import event_steps

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Events where one user owns a third of the rows, some users are unknown, and one second holds many rows."""
    e = event_steps(spark, sf)
    owner = F.when(F.col("event_id") % 3 == 0, F.lit(1)).when(F.col("event_id") % 10 == 1, F.lit(None)).otherwise(F.col("user_id") % 5)
    return e.withColumn("user_id", owner.cast("long")).withColumn(
        "ts", F.when(F.col("event_id") % 4 == 0, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts"))).cache()


def place():
    return Window.partitionBy(*KEYS).orderBy(*ORDER)


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("run", [10**6, 60, 7])
def test_running_totals(steps, run):
    for own, end in ((True, 0), (False, -1)):
        got = ordered.running_totals(steps, KEYS, ORDER, {"t": F.col("value")}, own, run)
        want = steps.withColumn("t", F.coalesce(F.sum("value").over(place().rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0)))
        assert same(got.select("event_id", F.round("t", 6)), want.select("event_id", F.round("t", 6)))


@pytest.mark.parametrize("run", [10**6, 60, 7])
def test_changes_numbers_and_windows(steps, run):
    changed = ordered.with_changes(steps, KEYS, ORDER, "event_type", "c", run)
    want = steps.withColumn("c", F.coalesce(F.lag("event_type").over(place()) != F.col("event_type"), F.lit(False)))
    assert same(changed.select("event_id", "c"), want.select("event_id", "c"))
    numbered = ordered.numbered(steps, KEYS, ORDER, "n", run)
    assert same(numbered.select("event_id", "n"), steps.select("event_id", F.row_number().over(place()).cast("long").alias("n")))
    windows = ordered.sequence_windows(steps, KEYS, ORDER, "value", "event_type", 6, run)
    full = steps.withColumns({
        "window": F.collect_list("value").over(place().rowsBetween(-5, 0)), "next_label": F.lead("event_type").over(place()),
    }).where((F.size("window") == 6) & F.col("next_label").isNotNull())
    assert same(windows.select("event_id", "window", "next_label"), full.select("event_id", "window", "next_label"))


@pytest.mark.parametrize("run,fan_out", [(10**6, 256), (50, 4)])
def test_bit_wear_equals_a_loop(steps, run, fan_out):
    scale = 3411 / 7
    got = ordered.bit_wear(steps, KEYS, ORDER, "event_type", "formation", wear_scale=scale, rows_per_run=run, fan_out=fan_out).toPandas()
    rows = steps.toPandas().sort_values(["user_id", "ts", "event_id"], na_position="first")
    want = {}
    for _, group in rows.groupby("user_id", dropna=False):
        wear, last = 0.0, None
        for r in group.itertuples():
            if last is not None and r.event_type != last:
                wear *= ordered.WEAR_KEPT.get(r.formation, ordered.WEAR_KEPT_DEFAULT)
            want[r.event_id] = wear
            wear, last = min(1.0, wear + ordered.WEAR_STEP.get(r.formation, ordered.WEAR_STEP_DEFAULT) * scale), r.event_type
    assert len(got) == len(want)
    assert max(abs(w - want[i]) for i, w in zip(got.event_id, got.bit_wear)) < 1e-12


def test_capped_and_floored(steps):
    capped = ordered.capped_running_sum(steps, KEYS, ORDER, F.lit(0.3), 1.0, "c", 50)
    assert {round(r[0], 6) for r in capped.select("c").distinct().collect()} == {0.0, 0.3, 0.6, 0.9, 1.0}
    floored = ordered.floored_running_loss(steps, KEYS, ORDER, F.lit(1.0), F.lit(0.2), 0.5, "e", 50)
    assert {round(r[0], 6) for r in floored.select("e").distinct().collect()} == {1.0, 0.8, 0.6, 0.5}


def test_first_rows_and_global_index(spark, steps):
    first = ordered.first_rows_per_key(steps, KEYS, ORDER, 3)
    assert {r["count"] for r in first.groupBy("user_id").count().collect()} == {3}
    texts = spark.createDataFrame([(t,) for t in "fbdaec"], "t string").repartition(3)
    assert [tuple(r) for r in ordered.global_index(texts, ["t"]).orderBy("t").collect()] == [(t, i) for i, t in enumerate("abcdef")]


def test_runs_stay_short_whatever_the_order_column(spark, steps):
    """Text as the order, one time for a third of the rows, and one time for all rows."""
    one_time = steps.withColumn("ts", F.lit("2024-01-03").cast("timestamp_ntz"))
    for rows, order in ((steps, ["event_type", "event_id"]), (steps, ORDER), (one_time, ORDER)):
        cut, several = ordered.cut_into_runs(rows, KEYS, order, 20)
        assert several and cut.count() == steps.count()
        assert cut.groupBy(*KEYS, ordered.RUN).count().agg(F.max("count")).first()[0] <= 4 * 20
        window = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = ordered.running_totals(rows, KEYS, order, {"t": F.col("value")}, True, 20)
        want = rows.withColumn("t", F.sum("value").over(window))
        assert same(got.select("event_id", F.round("t", 6)), want.select("event_id", F.round("t", 6)))


def test_runs_across_a_clock_change(spark):
    """The order of instants holds where the wall clock runs back, and NaN is last, with runs and without."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.range(240).select(F.lit("w").alias("well"), F.timestamp_seconds(F.lit(1_603_576_800) + F.col("id") * 60).alias("at"), F.col("id").cast("double").alias("x"))
        for few in (7, 1_000):
            got = ordered.running_totals(rows, ["well"], ["at"], {"total": F.col("x")}, rows_per_run=few).orderBy("at").collect()
            assert [r["total"] for r in got] == [i * (i + 1) / 2 for i in range(240)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    odd = spark.createDataFrame([("w", float(i) if i % 9 else float("nan"), 1.0) for i in range(1, 60)], "well string, at double, x double")
    got = ordered.running_totals(odd, ["well"], ["at"], {"total": F.col("x")}, rows_per_run=5)
    assert sorted(r["total"] for r in got.collect()) == [float(i) for i in range(1, 60)]
