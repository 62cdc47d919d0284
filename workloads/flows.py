"""Streams, models, deliberate gaps and whole runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.text import iso_time
from wellspring.operators import learning
from wellspring.operators.chained import iterative_impute
from wellspring.operators.damage import damage_type
from wellspring.operators.imputation import handle_missing
from wellspring.operators.layers import formation_additives
from wellspring.operators.masking import add_noise, mask_cells, mask_share
from wellspring.operators.neighbours import knn_impute
from wellspring.operators.profile import null_profile
from wellspring.operators.ordered import EFFICIENCY_STEP
from wellspring.plans.folder_jobs import rows_for_database
from wellspring.plans.processing import ProcessingConfig, process
from wellspring.session import scratch_path
from wellspring.sources.readers import read_file_stream
from wellspring.streaming.records import (
    alert_rate, alerts, cards, decode_records, encode_records, latest_rows, readable_records, run_available, start_latest, start_to_folder,
    start_with_broken_branch,
)
from wellspring.streaming.wells import walk_wells
from workloads.enrichment import SQL as WALKS
from workloads.inputs import event_steps_of, table, table_stream, telemetry, telemetry_of, with_gaps
from workloads.screening import DAMAGE_CASE, RULE_SQL
from workloads.states import TELEMETRY, over

RECORD = T.StructType([T.StructField(name, kind()) for name, kind in (
    ("order_id", T.LongType), ("part_id", T.LongType), ("line_id", T.IntegerType), ("well_id", T.LongType),
    ("datetime", T.StringType), ("formation_type", T.StringType), ("mud_type", T.StringType), ("viscosity", T.DoubleType),
    ("mud_ph", T.DoubleType), ("depth_measured", T.DoubleType))])
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CRITICAL = ["Stress/Corrosion Cracking", "Generic Damage"]


def _messages(spark, folder):
    tel = telemetry_of(table_stream(spark, folder, "lineitem")).withColumn("datetime", iso_time(F.col("datetime")))
    return encode_records(tel, "order_id", RECORD.names)


def stream_decode(spark, folder):
    """Records through their JSON messages and back."""
    records = run_available(readable_records(decode_records(_messages(spark, folder), RECORD)), "decoded")
    return records.groupBy("well_id", "formation_type", "mud_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("key").alias("n_keys"), F.max("datetime").alias("last"),
        F.round(F.sum("viscosity"), 4).alias("viscosity"), F.round(F.sum("depth_measured"), 3).alias("depth"))


def stream_alerts(spark, folder):
    found = alerts(telemetry_of(table_stream(spark, folder, "lineitem")), CRITICAL)
    kept = run_available(found.select("well_id", "damage_type", F.size("fired_rules").alias("n_rules")), "alerts")
    return kept.groupBy("well_id", "damage_type", "n_rules").agg(F.count(F.lit(1)).alias("n_rows"))


def stream_window_rate(spark, folder):
    """Records and errors per window, emitted once no earlier rows are waited for."""
    events = table_stream(spark, folder, "events").withColumns({"well_id": F.col("user_id") % 5, "is_alert": F.col("event_type") == "error"})
    return run_available(alert_rate(events, "well_id", "ts", "1 hour", "5 minutes"), "rates")


def window_rate(spark, folder):
    """The same rates over a finished table: all windows."""
    events = table(spark, folder, "events").withColumns({"well_id": F.col("user_id") % 5, "is_alert": F.col("event_type") == "error"})
    return alert_rate(events, "well_id", "ts", "1 hour", "5 minutes")


def _events_in_parts(spark, folder, parts=2):
    """Writers of the events of successive spans of time, each as one more file of a stream, and the stream's folder."""
    events, path = table(spark, folder, "events"), scratch_path(spark, "events")
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(moment, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        span = events.where((F.lit(True) if low is None else moment >= low) & (F.lit(True) if high is None else moment < high))
        yield path, lambda span=span: span.coalesce(1).write.mode("append").parquet(path)


def stream_window_rate_all(spark, folder):
    """All windows, those still open at the end included, over two starts of one stream."""
    out, schema = scratch_path(spark, "rates"), table(spark, folder, "events").schema
    for path, arrive in _events_in_parts(spark, folder):
        arrive()
        events = read_file_stream(spark, path, schema, files_per_batch=1).withColumns(
            {"well_id": F.col("user_id") % 5, "is_alert": F.col("event_type") == "error"})
        rates = alert_rate(events, "well_id", "ts", "1 hour", "5 minutes")
        start_latest(rates, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return latest_rows(spark, f"{out}/rows", rates.schema, ["well_id", "window_start", "window_end"])


def stream_well_states(spark, folder):
    """Depth, layer change, wear, contamination and efficiency per well, over two starts of one stream."""
    out, schema = scratch_path(spark, "wells"), table(spark, folder, "events").schema
    for path, arrive in _events_in_parts(spark, folder):
        arrive()
        steps = event_steps_of(read_file_stream(spark, path, schema))
        additives = formation_additives(F.when(F.col("event_id") % 2 == 0, F.col("formation")))
        walked = walk_wells(steps, ["user_id"], ["ts", "event_id"], "event_type", "formation", "value", additives,
                            wear_scale=math.sqrt(237443), contamination_scale=20, efficiency_step=EFFICIENCY_STEP * 400)
        start_to_folder(walked, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema(walked.schema).parquet(f"{out}/rows")
    return rows.select("event_id", "changed", *[F.round(c, 6).alias(c) for c in ("depth", "bit_wear", "contamination", "efficiency")])


def stream_bad_records(spark, folder):
    messages = encode_records(table_stream(spark, folder, "events"), "event_id", ["event_id", "user_id", "event_type", "value"])
    damaged = messages.withColumn("value", F.when(F.col("key").cast("long") % 50 == 0, F.left("value", F.lit(20))).otherwise(F.col("value")))
    path = scratch_path(spark, "branches")
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string, value double")
    start_with_broken_branch(damaged, schema, f"{path}/good", f"{path}/broken", f"{path}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{path}/good").select(F.lit("good").alias("branch"), "key", F.col("value").alias("v"))
    broken = spark.read.parquet(f"{path}/broken").select(F.lit("broken").alias("branch"), "key", F.lit(0.0).alias("v"))
    return good.unionByName(broken).groupBy("branch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("key").cast("long")).alias("keys"), F.round(F.sum("v"), 3).alias("total"))


def stream_cards(spark, folder):
    tel = telemetry_of(table_stream(spark, folder, "lineitem"))
    named = tel.withColumns({
        "key": F.col("order_id").cast("string"), "record_id": F.col("order_id"), "datetime": iso_time(F.col("datetime")),
        "lat": F.col("well_id") / 8.0, "long": F.col("line_id") / 4.0})
    return run_available(cards(named), "cards").groupBy("key").agg(
        F.count(F.lit(1)).alias("n_cards"), F.sum(F.length("card")).alias("n_chars"), F.min("card").alias("first_card"))


def mask_exact_share(spark, folder):
    masked = mask_share(table(spark, folder, "lineitem"), KEYS, share=0.05)
    return null_profile(masked).select("column", "n_missing", "n_rows")


def mask_random_cells(spark, folder):
    masked = mask_cells(table(spark, folder, "lineitem"), KEYS)
    return null_profile(masked).select("column", "n_missing", "n_rows")


def noise_effect(spark, folder):
    li = table(spark, folder, "lineitem")
    noisy = add_noise(li.withColumn("before", F.col("l_quantity")), KEYS, ["l_quantity"], 0.5, 0.1)
    shift = F.col("l_quantity") - F.col("before")
    return noisy.groupBy("l_linestatus").agg(F.count(shift).alias("n_rows"), F.round(F.avg(shift), 2).alias("mean"),
                                             F.round(F.stddev_pop(shift), 2).alias("std"))


def _order_gaps(spark, folder):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders").select(
        o.alias("id"), F.when(o % 23 != 0, F.col("o_totalprice")).alias("price"),
        F.when((o + c) % 29 != 0, c.cast("double")).alias("customer"),
        F.when((o * 3 + c) % 31 != 0, F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")).alias("day"),
        F.when(o % 37 != 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"))


def impute_knn(spark, folder):
    filled = knn_impute(_order_gaps(spark, folder), ["price", "customer", "day"])
    return filled.select("id", *[F.round(c, 5).alias(c) for c in ("price", "customer", "day")])


def impute_knn_sparse(spark, folder):
    """The price is known in one order of a hundred."""
    gaps = _order_gaps(spark, folder).withColumn("price", F.when(F.col("id") % 100 == 7, F.col("price")))
    return knn_impute(gaps.select("id", "price", "customer", "day"), ["price", "customer", "day"]).select(
        "id", *[F.round(c, 5).alias(c) for c in ("price", "customer", "day")])


def impute_iterative(spark, folder):
    filled, _ = handle_missing(with_gaps(spark, folder).drop("l_orderkey", "l_partkey", "l_suppkey"), "iterative")
    return filled.groupBy("l_linestatus").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])


def impute_iterative_relations(spark, folder):
    """Three readings that follow from the quantity, with a gap in one of them at most: how many cells are as they were."""
    tel, o, p, n = telemetry(spark, folder), F.col("order_id"), F.col("part_id"), F.col("line_id")
    whole = tel.select("well_id", "order_id", "line_id", "part_id", (F.col("viscosity") / 1.6 * 5).alias("weight"), "viscosity",
                       "reservoir_temperature", "rop")
    holes = {"weight": (o + n) % 7 == 0, "viscosity": (o + n) % 5 == 0, "reservoir_temperature": (p + n) % 11 == 0, "rop": p % 13 == 0}
    holes["viscosity"] &= ~holes["weight"]
    holes["reservoir_temperature"] &= ~holes["weight"] & ~holes["viscosity"]
    kept = whole.withColumns({f"true_{c}": F.col(c) for c in holes}).withColumns({f"gap_{c}": hole for c, hole in holes.items()})
    filled = iterative_impute(kept.withColumns({c: F.when(~F.col(f"gap_{c}"), F.col(c)) for c in holes}), list(holes))
    return filled.groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNotNull()).alias(f"n_{c}") for c in holes],
        *[F.count_if(~F.col(f"gap_{c}") & (F.col(c) != F.col(f"true_{c}"))).alias(f"changed_{c}") for c in holes],
        *[F.count_if(F.abs(F.col(c) - F.col(f"true_{c}")) < 0.5).alias(f"right_{c}") for c in holes if c != "rop"])


def impute_forest(spark, folder):
    filled, _ = learning.forest_impute(_order_gaps(spark, folder), ["price", "priority"])
    return filled.groupBy("priority").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("price"), 1).alias("price"))


def impute_forest_kept(spark, folder):
    """A price that follows from day and customer and a text that follows from the price, with gaps: cells kept, filled and near."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
    whole = table(spark, folder, "orders").select(
        o.alias("id"), day.alias("day"), (c % 10).cast("double").alias("desk"), ((c % 10) * 100.0 + 50.0).alias("fee"),
        F.when(c % 10 >= 5, "late").otherwise("early").alias("shift"))
    gaps = whole.select("id", "day", "desk", F.when(F.col("id") % 11 != 0, F.col("fee")).alias("fee"), F.when(F.col("id") % 13 != 0, F.col("shift")).alias("shift"))
    filled, counts = learning.forest_impute(gaps, ["fee", "shift"], max_depth=5)
    truth = F.col("desk") * 100.0 + 50.0
    return filled.groupBy("desk").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("fee").alias("n_fee"), F.count("shift").alias("n_shift"),
        F.count_if((F.col("id") % 11 != 0) & (F.col("fee") != truth)).alias("n_changed"),
        F.count_if(F.abs(F.col("fee") - truth) < 50).alias("n_near"),
        F.count_if(F.col("shift") == F.when(F.col("desk") >= 5, "late").otherwise("early")).alias("n_right"),
        F.lit(counts["fee"]).cast("bigint").alias("fee_gaps"), F.lit(counts["shift"]).cast("bigint").alias("shift_gaps"))


def boosted_labels(spark, folder):
    """Three grades of viscosity learned by boosted trees on four fifths of the orders: rows of the others and whether 19 of 20 are right."""
    tel = telemetry(spark, folder).select("order_id", "viscosity", "rop", "mud_type", F.when(F.col("viscosity") < 20, "thin").when(
        F.col("viscosity") < 50, "medium").otherwise("thick").alias("grade"))
    kept_apart = F.col("order_id") % 5 == 0
    model = learning.build_classifier(["viscosity", "rop"], ["mud_type"], "grade", trees=10, max_depth=4, method="boosted").fit(tel.where(~kept_apart))
    guessed = learning.predict_labels(model, tel.where(kept_apart))
    right = F.count_if(F.col("grade") == F.col("predicted_label"))
    return guessed.groupBy("grade").agg(F.count(F.lit(1)).alias("n_rows"), (right * 20 >= F.count(F.lit(1)) * 19).alias("mostly_right"))


def model_metrics(spark, folder):
    """Accuracy of a guess by line number and squared error of a price by quantity."""
    li = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") % 3).cast("double").alias("label_index"), (F.col("l_linenumber") % 3).cast("double").alias("guess"),
        "l_extendedprice", (F.col("l_quantity") * 1000).alias("by_quantity"))
    share = learning.accuracy(li.withColumnRenamed("guess", "prediction"))
    error = learning.mean_squared_error(li.withColumnRenamed("by_quantity", "prediction"), "l_extendedprice")
    return spark.createDataFrame([(round(share, 9), round(error / 1e6, 4))], "accuracy double, squared_error double")


def classifier_flow(spark, folder):
    """Order status from numbers and the priority; the share of right predictions on rows kept apart."""
    train, test = learning.split_rows(_order_gaps(spark, folder))
    model = learning.build_classifier(["price", "customer", "day"], ["priority"], "status").fit(train)
    guessed = learning.predict_labels(model, test)
    return guessed.groupBy("status", "predicted_label").agg(F.count(F.lit(1)).alias("n_rows"))


def damage_classifier(spark, folder):
    tel = telemetry(spark, folder).withColumn("Type_Damage", damage_type())
    rows, features = learning.training_selection(tel.drop("order_id", "part_id", "line_id", "well_id", "total_depth"), "Type_Damage", [])
    train, test = learning.split_rows(rows)
    guessed = learning.predict_labels(learning.build_classifier(features, [], "Type_Damage").fit(train), test)
    return guessed.groupBy("Type_Damage", "predicted_label").agg(F.count(F.lit(1)).alias("n_rows"))


def clusters(spark, folder):
    grouped = learning.cluster_rows(telemetry(spark, folder), ["viscosity", "depth_measured", "weight_on_bit"], 5)
    return grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("depth_measured"), 1).alias("depth"))


def _run_input(spark, folder):
    tel, o, p = telemetry(spark, folder), F.col("order_id"), F.col("part_id")
    return tel.select(
        F.when(o % 20 != 0, F.round(F.col("reservoir_temperature"))).alias("Temperature_C"),
        F.when(p % 25 != 0, F.col("weight_on_bit") * F.when(p % 97 == 0, 10.0).otherwise(1.0)).alias("Pressure_psi"),
        F.col("line_id").cast("double").alias("Flow_Rate_bbl_day"), (p % 9 + 1.0).alias("Permeability_mD"), (p % 5 + 1.0).alias("Porosity_pct"),
        F.when(o % 30 != 0, F.when(F.col("formation_type") == "Limestone", "Carbonate").otherwise(F.col("formation_type"))).alias("Formation"),
        F.col("mud_type").alias("Mud_Type"), F.round(F.col("viscosity") / 10).alias("Viscosity_cP"))


def processing_run(spark, folder):
    done = process(_run_input(spark, folder), ProcessingConfig(outlier_method="zscore_iqr"))
    return done.data.groupBy("Formation").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("PT_Ratio"), 6).alias("pt_ratio"), F.round(F.avg("Flow_Efficiency"), 6).alias("flow"),
        F.sum("Carbonate_Flag").alias("n_carbonate"), F.sum("Sandstone_Flag").alias("n_sandstone"),
        F.count_if("Feature_Inconsistency").alias("n_flagged"))


def processing_run_forest(spark, folder):
    done = process(_run_input(spark, folder))
    return done.data.groupBy("Formation").agg(F.count(F.lit(1)).alias("n_rows"))


def stored_file(spark, folder):
    """Telemetry under the names of a stored well file."""
    tel, c = telemetry(spark, folder), F.col
    zero = F.lit(0.0)
    return tel.select(
        c("order_id").alias("Record_ID"), c("well_id").alias("API_Well_ID"), zero.alias("LONG_deg"), zero.alias("LAT_deg"),
        c("datetime").alias("DateTime"), c("days_age_well").alias("Days_Age_Well_days"), F.lit("Vertical").alias("Drilling_Direction"),
        c("depth_measured").alias("Depth_Measured_m"), c("depth_bit").alias("Depth_Bit_m"), c("line_id").alias("Layer_ID"),
        c("formation_type").alias("Formation_Type"), F.lit("None").alias("Layer_Type"), c("clay_mineralogy_type").alias("Clay_Mineralogy_Type"),
        c("clay_content_percent").alias("Clay_Content_Percent_%"), c("formation_permeability").alias("Formation_Permeability_mD"),
        c("porosity_formation").alias("Porosity_Formation_%"), c("fractures_presence").alias("Fractures_Presence"),
        c("phase_operation").alias("Phase_Operation"), c("weight_on_bit").alias("Weight_on_Bit_kg"), c("rop").alias("ROP_m_hr"),
        zero.alias("RPM_rev_min"), zero.alias("Torque_Nm"), c("mud_type").alias("Mud_Type"), c("mud_weight_in").alias("Mud_Weight_In_ppg"),
        c("mud_weight_in").alias("Mud_Weight_Out_ppg"), zero.alias("Mud_Temperature_In_C"), zero.alias("Mud_Temperature_Out_C"),
        c("in_rate_flow_mud").alias("In_Rate_Flow_Mud_l_min"), zero.alias("Out_Rate_Flow_Mud_l_min"), c("viscosity").alias("Viscosity_cP"),
        c("mud_ph").alias("Mud_pH"), c("fluid_loss_api").alias("Fluid_Loss_API_ml_30min"), c("solid_content").alias("Solid_Content_%"),
        c("chloride_content").alias("Chloride_Content_mg_l"), zero.alias("Volume_Pit_bbl"), c("pressure_standpipe").alias("Pressure_Standpipe_psi"),
        c("pressure_annulus").alias("Pressure_Annulus_psi"), c("pressure_reservoir").alias("Pressure_Reservoir_psi"),
        c("overbalance").alias("Overbalance_psi"), c("reservoir_temperature").alias("Reservoir_Temperature_C"),
        c("completion_type").alias("Completion_Type"), c("density_perforation").alias("Density_Perforation_shots_m"),
        F.lit("No").alias("Active_Damage"), F.lit("None").alias("Type_Damage"), zero.alias("Damage_Severity"), F.lit("No").alias("Controllable"))


def database_rows(spark, folder):
    """All rows of each well in the shape of the target table."""
    rows = rows_for_database(stored_file(spark, folder), ["API_Well_ID"], ["DateTime", "Record_ID"])
    return rows.groupBy("api_well_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("fractures_presence").alias("n_fractured"), F.max("datetime").alias("last"),
        F.sum("mud_weight_in_ppg").cast("double").alias("weight"), F.count("clay_content_percent_p").alias("n_clay"),
        F.sum("density_perforation_shots_m").alias("perforation"))


QUERIES = {f.__name__: f for f in (
    stream_decode, stream_alerts, stream_window_rate, stream_window_rate_all, stream_well_states, window_rate, stream_bad_records, stream_cards, mask_exact_share,
    mask_random_cells, noise_effect, impute_knn, impute_knn_sparse, impute_iterative, impute_iterative_relations, impute_forest, impute_forest_kept,
    boosted_labels, model_metrics, classifier_flow, damage_classifier,
    clusters, processing_run, processing_run_forest, database_rows)}

_RULES_FIRED = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in RULE_SQL.values())
_RATE = """SELECT user_id % 5 AS well_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
  time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n_records,
  count(*) FILTER (WHERE event_type = 'error') AS n_alerts FROM events GROUP BY 1, 2, 3"""
_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
       "l_linestatus", "l_shipdate"]
_GAPPED = """gapped AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS price,
  CASE WHEN (o_orderkey + o_custkey) % 29 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer,
  CASE WHEN (o_orderkey * 3 + o_custkey) % 31 <> 0 THEN CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) END AS day
  FROM orders)"""


def _knn(target: str) -> str:
    cols = ("price", "customer", "day")
    square = " + ".join(f"COALESCE((q.{c} - d.{c}) * (q.{c} - d.{c}), 0)" for c in cols)
    shared = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    return f"""knn_{target} AS (SELECT id, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, v) AS rn FROM (
  SELECT q.id, sqrt(({square}) * 3e0 / ({shared})) AS dist, d.{target} AS v FROM gapped q, gapped d
  WHERE q.{target} IS NULL AND d.{target} IS NOT NULL AND ({shared}) > 0)) WHERE rn <= 5 GROUP BY 1)"""


def _knn_filled(gapped: str) -> str:
    names = ("price", "customer", "day")
    filled = ", ".join(f"ROUND(COALESCE(g.{c}, k_{c}.v, (SELECT avg({c}) FROM gapped)), 5) AS {c}" for c in names)
    joins = " ".join(f"LEFT JOIN knn_{c} k_{c} ON k_{c}.id = g.id" for c in names)
    return f"WITH {', '.join([gapped, *[_knn(c) for c in names]])} SELECT g.id, {filled} FROM gapped g {joins}"


_RELATED = ["weight", "viscosity", "reservoir_temperature", "rop"]
_LIMITS = ["temp", "press", "flow", "perm", "por", "visc"]

SQL = {
    "stream_decode": over(TELEMETRY) + """SELECT well_id, formation_type, mud_type, count(*) AS n_rows, count(*) AS n_keys,
  strftime(max(datetime), '%Y-%m-%dT%H:%M:%S') AS last, ROUND(sum(viscosity), 4) AS viscosity, ROUND(sum(depth_measured), 3) AS depth FROM tel GROUP BY 1, 2, 3""",
    "stream_alerts": over(TELEMETRY) + f""", marked AS (SELECT well_id, {DAMAGE_CASE} AS damage_type, CAST({_RULES_FIRED} AS INTEGER) AS n_rules FROM tel)
SELECT well_id, damage_type, n_rules, count(*) AS n_rows FROM marked
WHERE n_rules > 0 OR damage_type IN ('Stress/Corrosion Cracking', 'Generic Damage') GROUP BY 1, 2, 3""",
    "stream_window_rate": f"SELECT * FROM ({_RATE}) WHERE window_end <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM events)",
    "stream_window_rate_all": _RATE,
    "stream_well_states": f"""SELECT * FROM ({WALKS["bit_wear_walk"]}) JOIN ({WALKS["running_depths"]}) USING (event_id)
JOIN ({WALKS["layer_changes"]}) USING (event_id) JOIN ({WALKS["capped_contamination"]}) USING (event_id) JOIN ({WALKS["efficiency_floor"]}) USING (event_id)""",
    "window_rate": _RATE,
    "stream_bad_records": """SELECT CASE WHEN event_id % 50 = 0 THEN 'broken' ELSE 'good' END AS branch, count(*) AS n_rows,
  CAST(sum(event_id) AS BIGINT) AS keys, ROUND(sum(CASE WHEN event_id % 50 = 0 THEN 0 ELSE value END), 3) AS total FROM events GROUP BY 1""",
    "stream_cards": over(TELEMETRY) + """, c AS (SELECT CAST(order_id AS VARCHAR) AS key,
  printf('Record ID: %d | Phase: %s', order_id, phase_operation) || chr(10) || 'DateTime: ' || strftime(datetime, '%Y-%m-%dT%H:%M:%S') || chr(10)
  || printf('Location: (%.4f, %.4f) | Formation: %s', well_id / 8e0, line_id / 4e0, formation_type) || chr(10)
  || printf('Temp: %.2f | Pressure: %.2f psi', reservoir_temperature, pressure_reservoir) || chr(10)
  || printf('Mud Type: %s | pH: %.2f | Viscosity: %.2f', mud_type, mud_ph, viscosity) || chr(10)
  || printf('Clay: %s | Content: %.2f %%', clay_mineralogy_type, clay_content_percent) AS card FROM tel)
SELECT key, count(*) AS n_cards, CAST(sum(length(card)) AS BIGINT) AS n_chars, min(card) AS first_card FROM c GROUP BY 1""",
    "mask_exact_share": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + ("CAST(0 AS BIGINT)" if c in KEYS else "CAST(floor(count(*) * 0.05e0) AS BIGINT)")
        + " AS n_missing, count(*) AS n_rows FROM lineitem" for c in _LI),
    "noise_effect": "SELECT l_linestatus, count(*) AS n_rows, 0.5e0 AS mean, 0.1e0 AS std FROM lineitem GROUP BY 1",
    "impute_knn": _knn_filled(_GAPPED),
    "impute_knn_sparse": _knn_filled(_GAPPED.replace("CASE WHEN o_orderkey % 23 <> 0 THEN", "CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 100 = 7 THEN")),
    "impute_forest_kept": """SELECT CAST(o_custkey % 10 AS DOUBLE) AS desk, count(*) AS n_rows, count(*) AS n_fee, count(*) AS n_shift, 0 AS n_changed,
  count(*) AS n_near, count(*) AS n_right, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0) AS fee_gaps,
  (SELECT count(*) FROM orders WHERE o_orderkey % 13 = 0) AS shift_gaps FROM orders GROUP BY 1""",
    "boosted_labels": """SELECT CASE WHEN l_quantity * 1.6e0 < 20 THEN 'thin' WHEN l_quantity * 1.6e0 < 50 THEN 'medium' ELSE 'thick' END AS grade,
  count(*) AS n_rows, true AS mostly_right FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1""",
    "model_metrics": """SELECT ROUND(avg(CASE WHEN l_orderkey % 3 = l_linenumber % 3 THEN 1e0 ELSE 0e0 END), 9) AS accuracy,
  ROUND(avg((l_extendedprice - l_quantity * 1000) * (l_extendedprice - l_quantity * 1000)) / 1e6, 4) AS squared_error FROM lineitem""",
    "impute_iterative_relations": "SELECT l_suppkey AS well_id, count(*) AS n_rows, " + ", ".join(
        [f"count(*) AS n_{c}, 0 AS changed_{c}" for c in _RELATED] + [f"count(*) AS right_{c}" for c in _RELATED[:3]])
        + " FROM lineitem GROUP BY 1",
    "processing_run": over(TELEMETRY) + """, raw AS (SELECT CASE WHEN order_id % 20 <> 0 THEN ROUND(reservoir_temperature) END AS temp,
  CASE WHEN part_id % 25 <> 0 THEN weight_on_bit * CASE WHEN part_id % 97 = 0 THEN 10e0 ELSE 1e0 END END AS press,
  CAST(line_id AS DOUBLE) AS flow, part_id % 9 + 1e0 AS perm, part_id % 5 + 1e0 AS por,
  CASE WHEN order_id % 30 <> 0 THEN CASE formation_type WHEN 'Limestone' THEN 'Carbonate' ELSE formation_type END END AS formation,
  mud_type AS mud, ROUND(viscosity / 10) AS visc FROM tel)
, mids AS (SELECT quantile_cont(temp, 0.5) AS mt, quantile_cont(press, 0.5) AS mp FROM raw)
, mode AS (SELECT formation AS mf FROM raw WHERE formation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
, clean AS (SELECT DISTINCT COALESCE(temp, mt) AS temp, COALESCE(press, mp) AS press, flow, perm, por, COALESCE(formation, mf) AS formation, mud, visc
  FROM raw, mids, mode)
, lim AS (SELECT """ + ", ".join(
        f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in _LIMITS) + """ FROM clean)
, kept AS (SELECT clean.* FROM clean, lim WHERE """ + " AND ".join(
        f"COALESCE(abs({c} - {c}_m) / NULLIF({c}_s, 0) <= 3, true) AND {c} >= {c}_1 - 1.5e0 * ({c}_3 - {c}_1) AND {c} <= {c}_3 + 1.5e0 * ({c}_3 - {c}_1)"
        for c in _LIMITS) + """)
SELECT formation AS "Formation", count(*) AS n_rows, ROUND(avg(press / (temp + 1e-6)), 6) AS pt_ratio, ROUND(avg(flow * 100 / (perm * por + 1e-6)), 6) AS flow,
  count(*) FILTER (WHERE formation = 'Carbonate') AS n_carbonate, count(*) FILTER (WHERE formation = 'Sandstone') AS n_sandstone,
  count(*) FILTER (WHERE mud = 'Water-based' AND visc > 60) AS n_flagged FROM kept GROUP BY 1""",
    "database_rows": over(TELEMETRY) + """SELECT well_id AS api_well_id, count(*) AS n_rows, count(*) FILTER (WHERE fractures_presence = 1) AS n_fractured,
  max(datetime) AS last, CAST(sum(CAST(mud_weight_in AS DECIMAL(4,2))) AS DOUBLE) AS weight, count(*) AS n_clay,
  CAST(sum(CAST(density_perforation AS INTEGER)) AS BIGINT) AS perforation FROM tel GROUP BY 1""",
}
