"""Streams that keep state over several starts, against the batch operators."""

import pytest
from pyspark.sql import functions as F

from wellspring.operators import ordered
from wellspring.session import settle
from wellspring.sources.readers import read_file_stream
from wellspring.streaming.records import alert_rate, latest_rows, start_latest, start_to_folder
from wellspring.streaming.wells import walk_wells

SCHEMA = "well long, at long, layer string, formation string, rop double, `own name` int"


def drilled(spark):
    kinds = ["Shale", "Sandstone", "Limestone", "Salt", None]
    rows = [(w, t, kinds[(t // (3 + w)) % 5], kinds[(t // (3 + w)) % 5], None if t % 11 == 0 else float("nan") if t % 13 == 0 else t % 17 * 100.0, t)
            for w in range(3) for t in range(60)]
    return settle(spark.createDataFrame(rows + [(None, t, "Salt", "Salt", 1.0, t) for t in range(4)], SCHEMA))


def test_well_state_goes_on_after_a_restart(spark, tmp_path):
    rows = drilled(spark)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low, high in ((0, 20), (20, 45), (45, 60)):
        rows.where((F.col("at") >= low) & (F.col("at") < high)).repartition(2).write.mode("append").parquet(source)
        walked = walk_wells(read_file_stream(spark, source, rows.schema), ["well"], ["at"], "layer", "formation", "rop", wear_scale=700.0, contamination_scale=30.0,
                            efficiency_step=0.01)
        start_to_folder(walked, out, check).awaitTermination()
    start_to_folder(walked, out, check).awaitTermination()  # nothing new
    found = spark.read.schema(walked.schema).parquet(out)
    keys, order = ["well"], ["at"]
    want = ordered.running_depth(rows.withColumn("rop", F.nanvl("rop", F.lit(None).cast("double"))), keys, order, "rop")
    want = ordered.with_changes(want, keys, order, "layer", "changed")
    want = ordered.bit_wear(want, keys, order, "layer", "formation", wear_scale=700.0)
    want = ordered.capped_running_sum(want, keys, order, ordered.contamination_step(F.col("formation")) * 30.0, 1.0, "contamination")
    want = ordered.floored_running_loss(want, keys, order, F.lit(1.0), F.lit(0.01), 0.5, "efficiency")
    numbers = ["depth", "bit_wear", "contamination", "efficiency"]
    shape = lambda df: sorted(((r.well is None, r.well or 0, r.at, r.changed, r["own name"], *[round(r[c], 9) for c in numbers]) for r in df.collect()))
    assert shape(found) == shape(want) and found.count() == rows.count()


def test_state_of_idle_wells_is_dropped(spark, tmp_path):
    """Well 1 pauses while well 2 moves time on beyond the idle time; well 0 stays within it."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spans = [[(0, 0), (1, 0)], [(2, 500_000)], [(2, 500_010), (0, 500_010)], [(0, 500_020), (1, 500_020)]]
    for rows in spans:
        df = spark.createDataFrame([(w, t, "Salt", "Salt", 3600.0) for w, t in rows], "well long, at long, layer string, formation string, rop double")
        df = df.withColumn("moment", F.timestamp_seconds(F.col("at") + 1_000_000))
        df.write.mode("append").parquet(source)
        walked = walk_wells(read_file_stream(spark, source, df.schema), ["well"], ["at"], "layer", "formation", "rop", moment="moment", lateness="1 minute", idle_ms=3_600_000)
        start_to_folder(walked, out, check).awaitTermination(60)
    found = sorted((r.well, r["at"], round(r.depth, 6)) for r in spark.read.schema(walked.schema).parquet(out).collect())
    assert found == [(0, 0, 1.0), (0, 500_010, 1.0), (0, 500_020, 2.0), (1, 0, 1.0), (1, 500_020, 1.0), (2, 500_000, 1.0), (2, 500_010, 2.0)]


def test_clashing_names_are_refused(spark, tmp_path):
    rows = drilled(spark).withColumn("depth", F.lit(1.0))
    rows.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="depth"):
        walk_wells(read_file_stream(spark, str(tmp_path / "in"), rows.schema), ["well"], ["at"], "layer", "formation", "rop")


def test_every_window_comes_once(spark, tmp_path):
    """One batch, a stop and a second start; the last windows, still open, are there."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = settle(spark.range(400).select((F.col("id") % 3).alias("well"), F.timestamp_seconds(F.col("id") * 37).alias("at"), (F.col("id") % 5 == 0).alias("is_alert")))
    for part in (rows.where("at < timestamp_seconds(7000)"), rows.where("at >= timestamp_seconds(7000)"), None):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(source)
        rates = alert_rate(read_file_stream(spark, source, rows.schema, files_per_batch=1), "well", "at", "10 minutes")
        start_latest(rates, out, check).awaitTermination()
    found = latest_rows(spark, out, rates.schema, ["well", "window_start", "window_end"])
    want = alert_rate(rows, "well", "at", "10 minutes")
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
