"""Outliers, combination rules, damage classes and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators.combination_rules import fired_rules, flag_combinations, rule_counts
from wellspring.operators.damage import (
    all_damage_types, damage_probability, damage_score, damage_type, depth_band, drilling_direction, is_controllable,
    phase_by_age, phase_by_depth, with_main_candidate,
)
from wellspring.operators.isolation import isolation_flags, isolation_scores
from wellspring.operators.layers import formation_attribute
from wellspring.operators.mud import fill_chloride, missing_fields
from wellspring.operators.outliers import flag_outliers, outlier_counts, outlier_statistics, split_by_flag
from wellspring.operators.profile import anomaly_summary
from wellspring.operators.quantiles import column_percentiles
from wellspring.operators.validation import range_violations, suspicious_summary
from wellspring.functions import physics
from wellspring.plans.quality import quality_report
from wellspring.session import scratch_path
from wellspring.sources.writers import write_split
from workloads.inputs import pick, table, telemetry
from workloads.states import TELEMETRY, over

CHECKED = ["pressure", "flow_rate", "depth"]


def readings(spark, folder):
    """Three skewed readings per line item."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (p * q / 1000.0).alias("pressure"), (p / q).alias("flow_rate"), p.alias("depth"))


def _columns_by_well(flagged, ending):
    return flagged.groupBy("l_suppkey").agg(
        *[F.count_if(F.col(f"{c}_{ending}")).alias(f"n_{c}") for c in CHECKED], F.count_if("is_outlier").alias("n_rows_flagged"))


def zscore_flags(spark, folder):
    return _columns_by_well(flag_outliers(readings(spark, folder), CHECKED, ["l_suppkey"], methods=["zscore"], details=True), "zscore")


def iqr_flags(spark, folder):
    return _columns_by_well(flag_outliers(readings(spark, folder), CHECKED, ["l_suppkey"], methods=["iqr"], details=True), "iqr")


def outlier_split(spark, folder):
    """Clean and outlier rows per well by z-score and IQR, with limits of the well itself."""
    return outlier_counts(flag_outliers(readings(spark, folder), CHECKED, ["l_suppkey"]), ["l_suppkey"])


def outlier_rows(spark, folder):
    """The outlier rows themselves."""
    return split_by_flag(flag_outliers(readings(spark, folder), CHECKED, ["l_suppkey"]))[1].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def table_outliers(spark, folder):
    """Limits of the whole table instead of the well."""
    flagged = flag_outliers(table(spark, folder, "events"), ["value"])
    return flagged.groupBy("event_type", "is_outlier").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


def outlier_summary(spark, folder):
    flagged = flag_outliers(table(spark, folder, "events"), ["value"], ["event_type"])
    return anomaly_summary(flagged, ["event_type"], "is_outlier")


def well_statistics(spark, folder):
    stats = outlier_statistics(readings(spark, folder), ["l_suppkey"], CHECKED)
    digits = lambda c: 7 if c.endswith(("_q1", "_q3")) else 4
    return stats.select("l_suppkey", "n_rows", *[
        F.round(c, digits(c)).alias(c) for c in stats.columns if c not in ("l_suppkey", "n_rows")])


def quantile_table(spark, folder):
    """Percentiles of whole columns, found by narrowing."""
    rows = readings(spark, folder)
    found = column_percentiles(rows, CHECKED, [0.05, 0.5, 0.95], exact_limit=20_000)
    return spark.createDataFrame(
        [(c, *[round(x, 7) for x in v]) for c, v in found.items()], "column string, p05 double, p50 double, p95 double")


def long_group_quartiles(spark, folder):
    """Quartiles of long groups, read off running counts over their values."""
    from wellspring.operators.quantiles import grouped_percentiles
    rows = table(spark, folder, "lineitem")
    found = grouped_percentiles(rows, ["l_returnflag"], ["l_quantity", "l_extendedprice"], [0.25, 0.75], exact_limit=5_000)
    return found.select("l_returnflag", *[
        F.round(F.col(f"{c}_p")[i], 7).alias(f"{c}_{n}") for c in ("l_quantity", "l_extendedprice") for i, n in enumerate(("q1", "q3"))])


def split_sink_counts(spark, folder):
    """Write clean and outlier rows to two tables and count what was written."""
    flagged = flag_outliers(readings(spark, folder), CHECKED, ["l_suppkey"])
    path = scratch_path(spark, "split")
    write_split(flagged, "is_outlier", f"{path}/clean", f"{path}/outliers")
    parts = [spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("part"), "depth") for n in ("clean", "outliers")]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("depth"), 2).alias("depth"))


def isolation_forest(spark, folder):
    flagged = isolation_flags(readings(spark, folder), CHECKED)
    return flagged.groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("flow_rate"), 2).alias("flow_rate"))


def isolation_score_by_well(spark, folder):
    scored = isolation_scores(readings(spark, folder), CHECKED)
    return scored.groupBy("l_suppkey").agg(F.round(F.avg("anomaly_score"), 4).alias("score"))


def _package_names(spark, folder):
    tel = telemetry(spark, folder)
    return tel.withColumns({
        "Temperature_C": F.col("reservoir_temperature") * 6 - 330, "Pressure_psi": F.col("pressure_reservoir") * 6, "pH": F.col("mud_ph") * 3 - 16})


def range_counts(spark, folder):
    return range_violations(_package_names(spark, folder))


def suspicious_combination(spark, folder):
    return suspicious_summary(telemetry(spark, folder), "fluid_type", "formation_type", "completion_type").drop("recommendation")


def rule_fire_counts(spark, folder):
    return rule_counts(telemetry(spark, folder))


def rule_fired_array(spark, folder):
    return fired_rules(telemetry(spark, folder)).groupBy(F.array_join("fired_rules", ",").alias("fired")).agg(
        F.count(F.lit(1)).alias("n_rows"))


def combination_anomaly(spark, folder):
    return flag_combinations(telemetry(spark, folder)).select("order_id", "part_id", "line_id", "well_id", "Combination_Anomaly")


def anomaly_by_well(spark, folder):
    return anomaly_summary(flag_combinations(telemetry(spark, folder)), ["well_id"], "Combination_Anomaly")


def damage_types(spark, folder):
    typed = telemetry(spark, folder).withColumn("damage", damage_type())
    return typed.groupBy("damage").agg(F.count(F.lit(1)).alias("n_rows"))


def damage_all_matches(spark, folder):
    return telemetry(spark, folder).select(F.explode(all_damage_types()).alias("damage")).groupBy("damage").agg(F.count(F.lit(1)).alias("n_rows"))


def controllable_share(spark, folder):
    typed = telemetry(spark, folder).withColumn("controllable", is_controllable(damage_type()))
    return typed.groupBy("well_id").agg(F.round(F.avg(F.col("controllable").cast("int")), 6).alias("controllable_share"))


def damage_scores(spark, folder):
    score = damage_score(F.col("rop") / 100, F.col("clay_content_percent"), F.col("fluid_loss_api"), F.col("fractures_presence"),
                         F.col("solid_content") / 20)
    return telemetry(spark, folder).withColumn("score", score).groupBy("well_id").agg(
        F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.max("score"), 6).alias("max_score"))


def damage_main_candidate(spark, folder):
    return with_main_candidate(telemetry(spark, folder)).groupBy(
        "formation_type", "main_damage", "main_severity", "main_controllable", "n_candidates").agg(F.count(F.lit(1)).alias("n_rows"))


def damage_probabilities(spark, folder):
    tel, f = telemetry(spark, folder), F.col("formation_type")
    p = damage_probability(f, F.col("weight_on_bit"), F.col("rop"), F.col("reservoir_temperature"),
                           formation_attribute(f, "wob_factor", 1.0) * 5000, formation_attribute(f, "base_rop", 15.0),
                           physics.formation_temperature(F.col("depth_measured"), formation_attribute(f, "temp_grad", 0.025)))
    return tel.withColumn("p", p).groupBy("formation_type", "well_id").agg(F.round(F.avg("p"), 6).alias("probability"))


def phases(spark, folder):
    tel = telemetry(spark, folder)
    return tel.groupBy(
        phase_by_age(F.col("days_age_well")).alias("by_age"),
        phase_by_depth(F.col("depth_measured"), F.col("total_depth")).alias("by_depth"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def drilling_directions(spark, folder):
    direction = drilling_direction(F.col("depth_measured"), F.col("total_depth"), F.col("well_id") % 2 == 0)
    return telemetry(spark, folder).groupBy("well_id", direction.alias("direction")).agg(F.count(F.lit(1)).alias("n_rows"))


def depth_bands(spark, folder):
    return telemetry(spark, folder).groupBy(depth_band(F.col("depth_measured") - 40).alias("band")).agg(F.count(F.lit(1)).alias("n_rows"))


def quality_rows(spark, folder):
    return quality_report(_package_names(spark, folder))[1]


def rule_contract(spark, folder):
    """Parts taken as mud programs, some of them incomplete."""
    p = F.col("p_partkey")
    programs = table(spark, folder, "part").select(
        p.alias("program"), pick(p % 3, "Water-based", "Oil-based", "Synthetic").alias("type"),
        F.when(p % 7 != 0, p % 10 + 8.0).alias("base_weight"), F.lit(0.02).alias("weight_grad"),
        F.when(p % 11 != 0, F.col("p_size").cast("double")).alias("viscosity"), F.lit(8.5).alias("ph"),
        F.when(p % 2 == 0, F.lit(400.0)).alias("chloride_base"), F.when(p % 5 == 0, F.lit(0.5)).alias("chloride_grad"))
    filled = fill_chloride(programs)
    bad = missing_fields(programs).select("program", F.array_join("missing_fields", ",").alias("missing"))
    return filled.join(bad, "program", "left").select(
        "program", "type", "chloride_base", "chloride_grad", F.coalesce("missing", F.lit("")).alias("missing"))


QUERIES = {f.__name__: f for f in (
    outlier_split, outlier_rows, zscore_flags, iqr_flags, table_outliers, outlier_summary, well_statistics, quantile_table,
    long_group_quartiles, split_sink_counts, isolation_forest, isolation_score_by_well, range_counts, suspicious_combination,
    rule_fire_counts, rule_fired_array, combination_anomaly, anomaly_by_well, damage_types, damage_all_matches,
    controllable_share, damage_scores, damage_main_candidate, damage_probabilities, phases, drilling_directions, depth_bands,
    quality_rows, rule_contract)}

READINGS = """
readings AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * l_quantity / 1000e0 AS pressure,
  l_extendedprice / l_quantity AS flow_rate, l_extendedprice AS depth FROM lineitem)"""
STATS = "stats AS (SELECT l_suppkey AS well" + "".join(
    f", avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s, quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3"
    for c in CHECKED) + " FROM readings GROUP BY 1)"


def _z(c: str) -> str:
    return f"COALESCE(abs({c} - {c}_m) / NULLIF({c}_s, 0) > 3, false)"


def _i(c: str) -> str:
    return f"COALESCE({c} < {c}_1 - 1.5e0 * ({c}_3 - {c}_1) OR {c} > {c}_3 + 1.5e0 * ({c}_3 - {c}_1), false)"


_MARKED = over(READINGS, STATS, "marked AS (SELECT readings.*, " + ", ".join(
    f"{_z(c)} AS {c}_z, {_i(c)} AS {c}_i" for c in CHECKED) + " FROM readings JOIN stats ON l_suppkey = well)")
_ANY_Z = " OR ".join(f"{c}_z" for c in CHECKED)
_ANY_I = " OR ".join(f"{c}_i" for c in CHECKED)


def _event_limits(group: str) -> str:
    return f"""SELECT e.*, (abs(value - m) / s > 3 OR value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)) AS is_outlier
FROM events e JOIN (SELECT {group} AS g, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) x ON {group.replace('event_type', 'e.event_type')} = g"""


# The rules once more, as SQL conditions.
RULE_SQL = {
    "R01": "formation_type = 'Shale' AND formation_permeability > 50",
    "R02": "formation_type = 'Limestone' AND reservoir_temperature < 60",
    "R03": "formation_type = 'Sandstone' AND clay_content_percent > 60",
    "R04": "mud_type = 'Water-based' AND viscosity > 60",
    "R05": "mud_type = 'Oil-based' AND mud_ph < 6",
    "R06": "mud_type = 'Synthetic' AND mud_weight_in < 7.5",
    "R07": "viscosity > 70 AND in_rate_flow_mud > 150",
    "R08": "reservoir_temperature > 130 AND formation_type = 'Shale'",
    "R09": "pressure_annulus > pressure_standpipe",
    "R10": "pressure_reservoir < 3000 AND depth_measured > 3000",
    "R11": "phase_operation = 'Production' AND rop > 1",
    "R12": "phase_operation = 'Completion' AND weight_on_bit > 5000",
    "R13": "depth_bit > depth_measured",
    "R14": "completion_type = 'Cased' AND density_perforation < 5",
    "R15": "completion_type = 'Open Hole' AND density_perforation > 20",
    "R16": "clay_mineralogy_type = 'Montmorillonite' AND mud_ph > 10",
    "R17": "formation_type = 'Shale' AND fractures_presence = 1 AND formation_permeability > 100",
    "R18": "phase_operation = 'Production' AND weight_on_bit > 1000",
    "R19": "fluid_loss_api > 3 AND mud_type = 'Oil-based'",
    "R20": "reservoir_temperature > 120 AND clay_content_percent > 50",
}
_ANY_RULE = " OR ".join(f"({c})" for c in RULE_SQL.values())
DAMAGE_SQL = [
    ("Clay & Iron Control", "clay_content_percent > 35 AND clay_mineralogy_type = 'Montmorillonite'"),
    ("Fluid Loss", "fluid_loss_api > 1 AND mud_type = 'Water-based'"),
    ("Scale/Sludge Incompatibility", "chloride_content > 500 AND solid_content > 10"),
    ("Near-Wellbore Emulsions", "completion_type = 'Open Hole' AND mud_ph < 7"),
    ("Completion Damage", "completion_type = 'Cased' AND overbalance > 100"),
    ("Surface Filtration", "viscosity > 18 AND mud_type = 'Oil-based'"),
    ("Ultra-Clean Fluids Control", "viscosity < 12 AND mud_type = 'Synthetic'"),
    ("Drilling-Induced Damage", "formation_type = 'Shale' AND fluid_loss_api > 0.8e0"),
    ("Rock/Fluid Interaction", "formation_permeability < 30 AND reservoir_temperature > 85"),
    ("Stress/Corrosion Cracking", "reservoir_temperature > 95 AND mud_weight_in > 9.5e0"),
]
DAMAGE_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in DAMAGE_SQL) + " ELSE 'Generic Damage' END"
_CANDIDATE_SQL = [
    ("Shale", "Clay Swelling", 0.50, "Yes", "clay_content_percent > 35 AND contains(clay_mineralogy_type, 'Montmorillonite')"),
    ("Shale", "Shale Instability", 0.45, "Yes", "clay_content_percent > 30"),
    ("Shale", "Borehole Collapse", 0.40, "No", "overbalance > 500"),
    ("Sandstone", "Fines Migration", 0.55, "Yes", "formation_permeability < 50"),
    ("Sandstone", "Sand Production", 0.45, "No", "rop > 25"),
    ("Limestone", "Acid Solubility", 0.60, "Yes", "mud_ph < 7"),
    ("Limestone", "Fracture Plugging", 0.50, "No", "fluid_loss_api > 1"),
    ("Salt", "Salt Creep", 0.70, "No", "reservoir_temperature > 90"),
    ("Salt", "Brine Influx", 0.60, "No", "chloride_content > 1000"),
]
_COUNT = " + ".join(f"CASE WHEN formation_type = '{f}' AND {c} THEN 1 ELSE 0 END" for f, _, _, _, c in _CANDIDATE_SQL)


def _main(what: int) -> str:
    ranked = sorted(_CANDIDATE_SQL, key=lambda x: -x[2])
    value = lambda x: f"{x[2]}e0" if what == 2 else f"'{x[what]}'"
    return "CASE " + " ".join(f"WHEN formation_type = '{x[0]}' AND {x[4]} THEN {value(x)}" for x in ranked) + (
        " ELSE 'Formation Damage' END" if what == 1 else " END")


_PACKAGE = over(TELEMETRY) + """, pkg AS (SELECT *, reservoir_temperature * 6 - 330 AS temp_c, pressure_reservoir * 6 AS press_psi,
  mud_ph * 3 - 16 AS ph_value FROM tel)"""
_RANGES = [("Temperature_C", "temp_c", 0, 400), ("Pressure_psi", "press_psi", 0, 30000), ("pH", "ph_value", 0, 14)]
_TRIPLE = "lower(fluid_type) = 'acidic' AND lower(formation_type) = 'shale' AND lower(completion_type) = 'open hole'"
_QUALITY_COLUMNS = [
    "order_id", "part_id", "line_id", "well_id", "datetime", "days_age_well", "phase_operation", "formation_type",
    "clay_mineralogy_type", "mud_type", "completion_type", "fluid_type", "fractures_presence", "reservoir_temperature",
    "formation_permeability", "clay_content_percent", "density_perforation", "depth_measured", "depth_bit", "weight_on_bit",
    "rop", "viscosity", "mud_ph", "mud_weight_in", "in_rate_flow_mud", "pressure_standpipe", "pressure_annulus",
    "pressure_reservoir", "overbalance", "fluid_loss_api", "chloride_content", "solid_content", "porosity_formation",
    "is_horizontal", "is_seal", "is_reservoir", "total_depth", "Temperature_C", "Pressure_psi", "pH",
]
_NO_COLUMN = "CAST(NULL AS VARCHAR)"
_TRIGGERS = "CASE formation_type WHEN 'Shale' THEN {0} WHEN 'Limestone' THEN {1} WHEN 'Sandstone' THEN {2} ELSE {3} END"

SQL = {
    "outlier_split": _MARKED + f"""SELECT l_suppkey, count(*) FILTER (WHERE NOT ({_ANY_Z} OR {_ANY_I})) AS n_clean,
  count(*) FILTER (WHERE {_ANY_Z} OR {_ANY_I}) AS n_outliers FROM marked GROUP BY 1""",
    "outlier_rows": _MARKED + f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM marked WHERE {_ANY_Z} OR {_ANY_I}",
    "zscore_flags": _MARKED + "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (WHERE {c}_z) AS n_{c}" for c in CHECKED)
        + f", count(*) FILTER (WHERE {_ANY_Z}) AS n_rows_flagged FROM marked GROUP BY 1",
    "iqr_flags": _MARKED + "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (WHERE {c}_i) AS n_{c}" for c in CHECKED)
        + f", count(*) FILTER (WHERE {_ANY_I}) AS n_rows_flagged FROM marked GROUP BY 1",
    "table_outliers": f"""SELECT event_type, is_outlier, count(*) AS n_rows, ROUND(sum(value), 4) AS total
FROM ({_event_limits("'all'")}) GROUP BY 1, 2""",
    "outlier_summary": f"""SELECT event_type, count(*) AS total_records, count(*) FILTER (WHERE is_outlier) AS anomalies,
  round_even(count(*) FILTER (WHERE is_outlier) / count(*) * 100, 4) AS percentage FROM ({_event_limits("event_type")}) GROUP BY 1""",
    "well_statistics": over(READINGS) + "SELECT l_suppkey, count(*) AS n_rows" + "".join(
        f", ROUND(avg({c}), 4) AS {c}_mean, ROUND(stddev_pop({c}), 4) AS {c}_std, ROUND(quantile_cont({c}, 0.25), 7) AS {c}_q1, "
        f"ROUND(quantile_cont({c}, 0.75), 7) AS {c}_q3" for c in CHECKED) + " FROM readings GROUP BY 1",
    "quantile_table": over(READINGS) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", ROUND(quantile_cont({c}, 0.05), 7) AS p05, ROUND(quantile_cont({c}, 0.5), 7) AS p50, "
        f"ROUND(quantile_cont({c}, 0.95), 7) AS p95 FROM readings" for c in CHECKED),
    "long_group_quartiles": "SELECT l_returnflag" + "".join(
        f", ROUND(quantile_cont({c}, {q}), 7) AS {c}_{n}" for c in ("l_quantity", "l_extendedprice")
        for n, q in (("q1", 0.25), ("q3", 0.75))) + " FROM lineitem GROUP BY 1",
    "split_sink_counts": _MARKED + f"""SELECT CASE WHEN {_ANY_Z} OR {_ANY_I} THEN 'outliers' ELSE 'clean' END AS part, count(*) AS n_rows,
  ROUND(sum(depth), 2) AS depth FROM marked GROUP BY 1""",
    "range_counts": _PACKAGE + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) FILTER (WHERE {c} < {a}) AS below_min, count(*) FILTER (WHERE {c} > {b}) AS above_max FROM pkg"
        for n, c, a, b in _RANGES),
    "suspicious_combination": over(TELEMETRY) + f"""SELECT count(*) FILTER (WHERE {_TRIPLE}) AS suspicious_combinations_count,
  round_even(count(*) FILTER (WHERE {_TRIPLE}) / count(*) * 100, 2) AS suspicious_percentage FROM tel""",
    "rule_fire_counts": over(TELEMETRY) + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n_fired FROM tel" for n, c in RULE_SQL.items()),
    "rule_fired_array": over(TELEMETRY) + "SELECT concat_ws(',', " + ", ".join(
        f"CASE WHEN {c} THEN '{n}' END" for n, c in RULE_SQL.items()) + ") AS fired, count(*) AS n_rows FROM tel GROUP BY 1",
    "combination_anomaly": over(TELEMETRY) + f"""SELECT order_id, part_id, line_id, well_id, ({_ANY_RULE}) AS "Combination_Anomaly" FROM tel""",
    "anomaly_by_well": over(TELEMETRY) + f"""SELECT well_id, count(*) AS total_records, count(*) FILTER (WHERE {_ANY_RULE}) AS anomalies,
  round_even(count(*) FILTER (WHERE {_ANY_RULE}) / count(*) * 100, 4) AS percentage FROM tel GROUP BY 1""",
    "damage_types": over(TELEMETRY) + f"SELECT {DAMAGE_CASE} AS damage, count(*) AS n_rows FROM tel GROUP BY 1",
    "damage_all_matches": over(TELEMETRY) + " UNION ALL ".join(
        f"SELECT '{n}' AS damage, count(*) AS n_rows FROM tel WHERE {c} HAVING count(*) > 0" for n, c in DAMAGE_SQL),
    "controllable_share": over(TELEMETRY) + f"""SELECT well_id, ROUND(avg(CASE WHEN {DAMAGE_CASE} IN ({", ".join(
        f"'{n}'" for n, _ in DAMAGE_SQL[:7])}) THEN 1e0 ELSE 0e0 END), 6) AS controllable_share FROM tel GROUP BY 1""",
    "damage_scores": over(TELEMETRY) + """, scored AS (SELECT well_id, least(0.95e0, rop / 100
  + CASE WHEN clay_content_percent > 30 THEN 0.2e0 ELSE 0e0 END + CASE WHEN fluid_loss_api > 1 THEN 0.3e0 ELSE 0e0 END
  + CASE WHEN fractures_presence = 1 THEN 0.1e0 ELSE 0e0 END + CASE WHEN solid_content / 20 > 0.6e0 THEN 0.2e0 ELSE 0e0 END) AS score FROM tel)
SELECT well_id, ROUND(avg(score), 6) AS avg_score, ROUND(max(score), 6) AS max_score FROM scored GROUP BY 1""",
    "damage_main_candidate": over(TELEMETRY) + f"""SELECT formation_type, {_main(1)} AS main_damage, {_main(2)} AS main_severity,
  {_main(3)} AS main_controllable, CAST({_COUNT} AS INTEGER) AS n_candidates, count(*) AS n_rows FROM tel GROUP BY 1, 2, 3, 4, 5""",
    "damage_probabilities": over(TELEMETRY) + f""", p AS (SELECT formation_type, well_id, least(0.3e0,
  {_TRIGGERS.format("0.25e0", "0.17e0", "0.20e0", "0.15e0")}
  * least(1.5e0, weight_on_bit / ({_TRIGGERS.format("1.2e0", "1.5e0", "1.0e0", "1.5e0")} * 5000))
  * least(2.0e0, rop / {_TRIGGERS.format("12e0", "15e0", "20e0", "8e0")})
  * least(1.8e0, reservoir_temperature / (20 + depth_measured * {_TRIGGERS.format("0.025e0", "0.028e0", "0.026e0", "0.02e0")}))) AS p FROM tel)
SELECT formation_type, well_id, ROUND(avg(p), 6) AS probability FROM p GROUP BY 1, 2""",
    "phases": over(TELEMETRY) + """SELECT CASE WHEN days_age_well < 100 THEN 'Drilling' WHEN days_age_well < 200 THEN 'Completion'
  ELSE 'Production' END AS by_age, CASE WHEN depth_measured < total_depth THEN 'Drilling' ELSE 'Completed' END AS by_depth,
  count(*) AS n_rows FROM tel GROUP BY 1, 2""",
    "drilling_directions": over(TELEMETRY) + """SELECT well_id, CASE WHEN well_id % 2 <> 0 OR depth_measured < total_depth * 0.75e0 THEN 'Vertical'
  WHEN depth_measured < total_depth * 0.75e0 + total_depth * 0.15e0 THEN 'Tangent' ELSE 'Horizontal' END AS direction,
  count(*) AS n_rows FROM tel GROUP BY 1, 2""",
    "depth_bands": over(TELEMETRY) + """SELECT CASE WHEN d < 2 THEN 'surface' WHEN d < 50 THEN 'near surface' WHEN d < 300 THEN 'shallow'
  WHEN d < 1500 THEN 'intermediate' WHEN d < 3000 THEN 'deep' ELSE 'very deep' END AS band, count(*) AS n_rows
FROM (SELECT depth_measured - 40 AS d FROM tel) GROUP BY 1""",
    "quality_rows": _PACKAGE + f"""SELECT 'missing_values' AS "check", {_NO_COLUMN} AS "column", 'total' AS metric, 0e0 AS value
UNION ALL """ + " UNION ALL ".join(f"SELECT 'missing_values', '{c}', 'missing', 0e0" for c in _QUALITY_COLUMNS)
        + "".join(
            f" UNION ALL SELECT 'value_range_violations', '{n}', '{m}', CAST(count(*) FILTER (WHERE {t}) AS DOUBLE) FROM pkg"
            for n, c, a, b in _RANGES for m, t in (("below_min", f"{c} < {a}"), ("above_max", f"{c} > {b}")))
        + f""" UNION ALL SELECT 'logical_inconsistencies', {_NO_COLUMN}, 'suspicious_combinations_count', CAST(count(*) FILTER (WHERE {_TRIPLE}) AS DOUBLE) FROM pkg
UNION ALL SELECT 'logical_inconsistencies', {_NO_COLUMN}, 'suspicious_percentage', round_even(count(*) FILTER (WHERE {_TRIPLE}) / count(*) * 100, 2) FROM pkg
UNION ALL SELECT 'feature_inconsistencies', {_NO_COLUMN}, 'total', CAST(count(*) FILTER (WHERE {_ANY_RULE}) AS DOUBLE) FROM pkg
UNION ALL SELECT 'feature_inconsistencies', {_NO_COLUMN}, 'percentage', round_even(count(*) FILTER (WHERE {_ANY_RULE}) / count(*) * 100, 2) FROM pkg
UNION ALL SELECT 'feature_inconsistencies', {_NO_COLUMN}, 'skipped_rules', 0e0""",
    "rule_contract": """SELECT p_partkey AS program, type, COALESCE(b, CASE WHEN type = 'Water-based' THEN 300e0 ELSE 50e0 END) AS chloride_base,
  COALESCE(g, CASE WHEN type = 'Water-based' THEN 0.3e0 ELSE 0.1e0 END) AS chloride_grad, missing FROM (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Water-based' WHEN 1 THEN 'Oil-based' ELSE 'Synthetic' END AS type,
    CASE WHEN p_partkey % 2 = 0 THEN 400e0 END AS b, CASE WHEN p_partkey % 5 = 0 THEN 0.5e0 END AS g,
    concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'base_weight' END, CASE WHEN p_partkey % 11 = 0 THEN 'viscosity' END) AS missing FROM part)""",
}
