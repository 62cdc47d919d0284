"""Feature columns, physics, lookups and sequence operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wellspring.functions import physics
from wellspring.functions.nulls import lookup
from wellspring.functions.text import day_stamp, iso_time, joined_list, plus_seconds, record_card, whole_days_between
from wellspring.operators import ordered
from wellspring.operators.features import (
    add_features, decode_label, encode_label, flow_efficiency, label_index, pt_ratio, standard_scale,
)
from wellspring.operators.layers import completion_by_well, formation_additives, formation_attribute, layer_lookup
from wellspring.operators.mud import PROGRAMS, mud_program, rule_table, with_mud_program
from wellspring.operators.rule_table import match_rules
from workloads.inputs import event_steps, pick, table, telemetry, well_layers
from workloads.states import LAYERS, STEPS, TELEMETRY, over

RUN = 5_000
KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def _averages(df, keys, **columns):
    return df.groupBy(*keys).agg(*[F.round(F.avg(c), 5).alias(n) for n, c in columns.items()])


def ratio_features(spark, folder):
    tel = telemetry(spark, folder)
    named = tel.select(
        "well_id", F.col("pressure_reservoir").alias("Pressure_psi"), F.col("reservoir_temperature").alias("Temperature_C"),
        F.col("in_rate_flow_mud").alias("Flow_Rate_bbl_day"), F.col("formation_permeability").alias("Permeability_mD"),
        F.col("porosity_formation").alias("Porosity_pct"),
        F.when(F.col("part_id") % 5 != 0, F.when(F.col("formation_type") == "Limestone", "Carbonate").otherwise(F.col("formation_type"))).alias("Formation"))
    made, _ = add_features(named)
    return made.groupBy("well_id").agg(
        F.round(F.avg("PT_Ratio"), 5).alias("pt_ratio"), F.round(F.sum(F.log(F.col("Flow_Efficiency"))), 4).alias("log_flow_efficiency"),
        F.sum("Carbonate_Flag").alias("n_carbonate"), F.sum("Sandstone_Flag").alias("n_sandstone"))


def ratio_rows(spark, folder):
    """The two ratios of each row."""
    tel = telemetry(spark, folder)
    return tel.select(
        "order_id", "part_id", "line_id", "well_id", F.round(pt_ratio("pressure_reservoir", "reservoir_temperature"), 6).alias("pt_ratio"),
        F.round(flow_efficiency("in_rate_flow_mud", "clay_content_percent", "porosity_formation"), 6).alias("flow_efficiency"))


def pressures(spark, folder):
    d, w, f = F.col("depth_measured"), F.col("mud_weight_in"), F.col("formation_type")
    grad, frac = formation_attribute(f, "pressure_grad"), formation_attribute(f, "fracture_grad")
    return _averages(
        telemetry(spark, folder), ["well_id", "formation_type"], hydrostatic=physics.hydrostatic_pressure(d, w),
        formation=physics.formation_pressure(d, grad), annulus=physics.annulus_pressure(d, w),
        standpipe=physics.standpipe_pressure(d, w), overbalance=physics.overbalance(d, w, grad),
        fracture=physics.fracture_pressure(d, frac))


def temperatures(spark, folder):
    f, flat = F.col("formation_type"), F.col("is_horizontal")
    vertical = physics.vertical_depth(F.col("depth_measured"), F.col("total_depth") * 0.75, flat)
    rock = physics.formation_temperature(vertical, formation_attribute(f, "temp_grad"))
    out = physics.mud_temperature_out(rock - 2, F.col("rop") - 10, rock)
    return _averages(telemetry(spark, folder), ["well_id", "formation_type"], vertical=vertical, rock=rock, mud_out=out)


def mud_weight_window(spark, folder):
    f, d = F.col("formation_type"), F.col("depth_measured")
    low, high = formation_attribute(f, "min_mud_weight"), formation_attribute(f, "max_mud_weight")
    needed = physics.required_mud_weight(d - 50, formation_attribute(f, "pressure_grad"), low, high)
    safe = physics.safe_mud_weight(F.col("mud_weight_in") * 1.4, formation_attribute(f, "fracture_grad"), low, high)
    return _averages(telemetry(spark, folder), ["well_id", "formation_type"], needed=needed, safe=safe)


def _expected_weight():
    f = F.col("formation_type")
    return physics.expected_weight_on_bit(
        f, F.col("depth_measured"), formation_attribute(f, "wob_factor"), F.col("is_seal"), F.col("is_reservoir"), F.col("is_horizontal"),
        F.when(F.col("order_id") % 3 == 0, "Tricone").otherwise("PDC"))


def drilling_rates(spark, folder):
    f, d = F.col("formation_type"), F.col("depth_measured")
    tel = telemetry(spark, folder).withColumn("wob", _expected_weight())
    rop = physics.expected_rop(F.col("wob"), d, formation_attribute(f, "density"), formation_attribute(f, "base_rop"), F.col("is_seal"),
                               F.col("is_reservoir"), F.col("is_horizontal"), F.when(F.col("order_id") % 3 == 0, "Tricone").otherwise("PDC"))
    direction = F.when(F.col("is_horizontal"), "Horizontal").when(F.col("line_id") == 6, "Tangent").otherwise("Vertical")
    tel = tel.withColumns({"rop_expected": rop, "direction": direction})
    effective = physics.effective_rop(F.col("rop_expected"), F.col("direction"), F.col("wob"), F.col("mud_weight_in"),
                                      formation_attribute(f, "min_mud_weight"), F.lit(0.97))
    return _averages(tel, ["well_id", "formation_type"], weight_on_bit="wob", rop="rop_expected", effective=effective,
                     torque=physics.torque(F.col("wob"), f, F.lit(0.97)),
                     inclination=physics.inclination(F.col("direction"), 45.0),
                     inflow=physics.expected_inflow(F.col("mud_type"), f, F.col("is_horizontal")))


def fluid_condition(spark, folder):
    f, d = F.col("formation_type"), F.col("depth_measured")
    chloride = physics.chloride_content(d, f, F.when(F.col("line_id") > 2, F.lit(400.0)), F.when(F.col("line_id") > 4, F.lit(0.5)))
    efficiency = physics.equipment_efficiency(F.col("fluid_loss_api") / 5, F.col("solid_content") / 20, F.col("days_age_well"))
    return _averages(telemetry(spark, folder), ["well_id", "formation_type"], chloride=chloride, efficiency=efficiency)


def mud_programs(spark, folder):
    choice = mud_program(F.col("depth_measured"), F.col("formation_type"), F.col("is_seal"), F.col("is_reservoir"), F.col("is_horizontal"))
    return _mud_groups(telemetry(spark, folder).withColumn("mud", choice))


def mud_rule_table(spark, folder):
    """The same programs from a table of rules."""
    return _mud_groups(with_mud_program(telemetry(spark, folder), rule_table(spark, PROGRAMS)))


def mud_rules_of_parts(spark, folder):
    """A rule for every part: ranges of depth and pressure, some of them open, and formations; equal priorities occur."""
    p = F.col("p_partkey")
    low = p * 37 % 3600
    rules = table(spark, folder, "part").where(p % 143 != 0).select(
        (p % 500 + F.when((p % 11 == 0) | (p % 13 == 0), 500).otherwise(0)).alias("priority"), p.alias("rule_id"), F.when(p % 11 != 0, low.cast("double")).alias("min_depth"),
        F.when(p % 13 != 0, (low + p % 40 + 5).cast("double")).alias("max_depth"),
        F.when(p % 3 != 0, F.array(pick(p % 4, "Shale", "Limestone", "Sandstone", "Salt"), F.lit("Salt"))).alias("formations"),
        F.when(p % 5 != 0, (p % 17 * 300).cast("double")).alias("min_pressure"), F.when(p % 7 != 0, (p % 17 * 300 + 2500).cast("double")).alias("max_pressure"))
    rows = telemetry(spark, folder).select("formation_type", "depth_measured", "pressure_reservoir")
    found = match_rules(rows, rules, {"depth_measured": ("min_depth", "max_depth"), "pressure_reservoir": ("min_pressure", "max_pressure")},
                        {"formation_type": "formations"})
    return found.groupBy("formation_type", F.col("rule.rule_id").alias("rule_id"), F.col("rule.priority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("depth_measured"), 3).alias("depth"))


def _mud_groups(chosen):
    return chosen.groupBy("formation_type", F.col("mud.type").alias("mud"), F.col("mud.viscosity").alias("viscosity"),
                          F.col("mud.ph").alias("ph"), joined_list("mud.additives").alias("additives"),
                          F.col("mud.chloride_base").alias("chloride_base"), F.col("mud.chloride_grad").alias("chloride_grad")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("mud.weight"), 5).alias("weight"))


def factor_lookup(spark, folder):
    f = F.col("formation_type")
    return telemetry(spark, folder).groupBy(
        f, lookup(f, physics.TORQUE_FACTOR, 1.0).alias("torque_factor"), lookup(f, physics.FLOW_FACTOR, 1.0).alias("flow_factor"),
        formation_attribute(f, "pressure_grad", 0.465).alias("pressure_grad"), joined_list(formation_additives(f)).alias("additives"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def _layered(spark, folder, horizontal):
    found = layer_lookup(telemetry(spark, folder), well_layers(spark, folder), "well_id", "depth_measured", horizontal)
    return found.groupBy("well_id", "layer_id", "formation").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("depth_measured"), 3).alias("depth"))


def layer_by_depth(spark, folder):
    return _layered(spark, folder, None)


def layer_with_horizontal(spark, folder):
    return _layered(spark, folder, "is_horizontal")


def completion_types(spark, folder):
    return completion_by_well(well_layers(spark, folder), "well_id")


def label_encoding(spark, folder):
    coded = encode_label(table(spark, folder, "part"), "p_brand", "brand_index")
    return coded.groupBy("p_brand", "brand_index").agg(F.count(F.lit(1)).alias("n_rows"))


def label_decoding(spark, folder):
    labels = label_index(table(spark, folder, "part"), "p_brand", "brand_index")
    coded = table(spark, folder, "part").withColumn("guess", (F.col("p_partkey") % 7).cast("double"))
    return decode_label(coded, "guess", labels, "guessed_brand").groupBy("guess", "guessed_brand").agg(F.count(F.lit(1)).alias("n_rows"))


def scaled_features(spark, folder):
    li = table(spark, folder, "lineitem").withColumn("constant", F.lit(3.0))
    scaled = standard_scale(li, ["l_quantity", "l_extendedprice", "constant"])
    return scaled.groupBy("l_suppkey").agg(
        *[F.round(F.avg(f"{c}_scaled"), 6).alias(c) for c in ("l_quantity", "l_extendedprice", "constant")])


def time_text(spark, folder):
    ts = F.col("ts")
    start = F.to_timestamp_ntz(F.lit("2023-12-30 12:00:00"))
    return table(spark, folder, "events").select(
        "event_id", iso_time(ts).alias("iso"), day_stamp(ts).alias("day"), whole_days_between(start, ts).alias("days"),
        iso_time(plus_seconds(start, F.col("event_id") * 90)).alias("later"))


def running_depths(spark, folder):
    rows = ordered.running_depth(event_steps(spark, folder), KEYS, ORDER, "value", "depth", RUN)
    return rows.select("event_id", F.round("depth", 6).alias("depth"))


def capped_contamination(spark, folder):
    step = ordered.contamination_step(F.col("formation"), formation_additives(F.when(F.col("event_id") % 2 == 0, F.col("formation")))) * 20
    rows = ordered.capped_running_sum(event_steps(spark, folder), KEYS, ORDER, step, 1.0, "contamination", RUN)
    return rows.select("event_id", F.round("contamination", 6).alias("contamination"))


def efficiency_floor(spark, folder):
    rows = ordered.floored_running_loss(event_steps(spark, folder), KEYS, ORDER, F.lit(1.0), F.lit(ordered.EFFICIENCY_STEP * 400), 0.5, "efficiency", RUN)
    return rows.select("event_id", F.round("efficiency", 6).alias("efficiency"))


def layer_changes(spark, folder):
    rows = ordered.with_changes(event_steps(spark, folder), KEYS, ORDER, "event_type", "changed", RUN)
    return rows.select("event_id", "changed")


def bit_wear_walk(spark, folder):
    rows = ordered.bit_wear(event_steps(spark, folder), KEYS, ORDER, "event_type", "formation", wear_scale=math.sqrt(237443), rows_per_run=RUN, fan_out=32)
    return rows.select("event_id", F.round("bit_wear", 6).alias("bit_wear"))


def row_numbers(spark, folder):
    return ordered.numbered(event_steps(spark, folder), KEYS, ORDER, "place", RUN).select("event_id", "place")


def sequence_window(spark, folder):
    rows = ordered.sequence_windows(event_steps(spark, folder), KEYS, ORDER, "value", "event_type", 10, RUN)
    return rows.select("event_id", F.array_join(F.transform("window", lambda v: F.round(v * 100).cast("long")), ",").alias("steps"), "next_label")


def series_per_interval(spark, folder):
    rows = ordered.series_by_interval(table(spark, folder, "events"), ["event_type"], "ts", ["value"], "15 minutes")
    return rows.withColumn("avg_value", F.round("avg_value", 6))


def record_cards(spark, folder):
    named = telemetry(spark, folder).withColumns({
        "record_id": F.col("order_id"), "datetime": iso_time(F.col("datetime")), "lat": F.col("well_id") / 8.0,
        "long": F.when(F.col("line_id") != 2, F.col("line_id") / 4.0)})
    return named.select("order_id", "part_id", "line_id", "well_id", record_card().alias("card"))


QUERIES = {f.__name__: f for f in (
    ratio_features, ratio_rows, pressures, temperatures, mud_weight_window, drilling_rates, fluid_condition, mud_programs, mud_rule_table,
    mud_rules_of_parts,
    factor_lookup, layer_by_depth, layer_with_horizontal, completion_types, label_encoding, label_decoding, scaled_features,
    time_text, running_depths, capped_contamination, efficiency_floor, layer_changes, bit_wear_walk, row_numbers,
    sequence_window, series_per_interval, record_cards)}


def by_formation(limestone, sandstone, shale, salt) -> str:
    return (f"CASE formation_type WHEN 'Limestone' THEN {limestone} WHEN 'Sandstone' THEN {sandstone} "
            f"WHEN 'Shale' THEN {shale} ELSE {salt} END")


_PGRAD = by_formation("0.445e0", "0.433e0", "0.465e0", "0.465e0")
_FGRAD = by_formation("0.8e0", "0.7e0", "0.75e0", "0.85e0")
_TGRAD = by_formation("0.028e0", "0.026e0", "0.025e0", "0.02e0")
_MINW = by_formation("9e0", "8.5e0", "9.5e0", "8.5e0")
_MAXW = by_formation("13e0", "12.5e0", "14e0", "18e0")
_HYDRO = "mud_weight_in * depth_measured * 0.052e0 * 3.281e0"


def _means(**columns: str) -> str:
    return ("SELECT well_id, formation_type, " + ", ".join(f"ROUND(avg({c}), 5) AS {n}" for n, c in columns.items())
            + " FROM tel GROUP BY 1, 2")


_VERTICAL = "CASE WHEN is_horizontal THEN total_depth * 0.75e0 ELSE depth_measured END"
_ROCKTEMP = f"(20 + {_VERTICAL} * {_TGRAD})"
_LOW = f"(CASE WHEN is_seal THEN 10000e0 WHEN is_reservoir THEN 6000e0 ELSE {by_formation('5000e0', '2000e0', '3000e0', '2000e0')} END * CASE WHEN is_horizontal THEN 0.7e0 ELSE 1e0 END)"
_HIGH = f"(CASE WHEN is_seal THEN 22000e0 WHEN is_reservoir THEN 15000e0 ELSE {by_formation('18000e0', '8000e0', '12000e0', '10000e0')} END * CASE WHEN is_horizontal THEN 0.8e0 ELSE 1e0 END)"
_WOB = (f"least(25000e0, ({_LOW} + ({_HIGH} - {_LOW}) * least(1e0, depth_measured / 3000)) * {by_formation('1.5e0', '1e0', '1.2e0', '1.5e0')} "
        "* CASE WHEN order_id % 3 = 0 THEN 0.8e0 ELSE 1e0 END)")
_ROP = (f"greatest(2e0, least(100e0, 2.5e0 / {by_formation('2.7e0', '2.3e0', '2.4e0', '2.2e0')} * {by_formation('15e0', '20e0', '12e0', '8e0')} "
        "* greatest(0.3e0, 1 - depth_measured / 6000) * power(wob / 10000, 0.7e0) * CASE WHEN order_id % 3 = 0 THEN 0.9e0 ELSE 1.3e0 END "
        "* CASE WHEN is_horizontal AND is_seal THEN 0.48e0 WHEN is_horizontal THEN 0.6e0 ELSE 1e0 END * CASE WHEN is_reservoir THEN 1.2e0 ELSE 1e0 END))")

_MUD = f"""
, inputs AS (SELECT *, depth_measured * {_PGRAD} * 3.281e0 AS pressure,
  CASE WHEN depth_measured > 0 THEN greatest({_MINW}, least({_PGRAD} / 0.052e0, {_MAXW})) END AS needed,
  {by_formation("''", "'Lubricants'", "'KCl, PHPA'", "''")} AS own FROM tel)
, chosen AS (SELECT *, CASE WHEN is_seal THEN 'seal' WHEN is_reservoir AND depth_measured > 1500 THEN 'deep'
  WHEN depth_measured >= 600 AND pressure >= 3000 THEN 'high' WHEN formation_type = 'Shale' AND pressure >= 1500 THEN 'shale'
  WHEN depth_measured >= 50 AND depth_measured < 300 THEN 'middle' WHEN depth_measured < 50 THEN 'top' ELSE 'other' END AS p FROM inputs)
, mud AS (SELECT formation_type,
  CASE p WHEN 'seal' THEN 'Synthetic Oil-based' WHEN 'deep' THEN 'Synthetic Oil-based' WHEN 'high' THEN 'Synthetic Oil-based'
    WHEN 'shale' THEN 'Inhibitive Water-based' ELSE 'Water-based' END AS mud,
  CASE p WHEN 'seal' THEN 45e0 WHEN 'deep' THEN 40e0 ELSE (CASE p WHEN 'high' THEN 45e0 WHEN 'shale' THEN 35e0 WHEN 'middle' THEN 25e0
    WHEN 'top' THEN 15e0 ELSE 30e0 END) * CASE WHEN is_horizontal THEN 1.3e0 ELSE 1e0 END END AS viscosity,
  CASE p WHEN 'seal' THEN 7.5e0 WHEN 'deep' THEN 7e0 WHEN 'high' THEN 7e0 WHEN 'shale' THEN 9e0 WHEN 'middle' THEN 8.5e0
    WHEN 'top' THEN 8e0 ELSE 8.5e0 END AS ph,
  CASE p WHEN 'seal' THEN 'Bridging agents, Lost circulation materials' WHEN 'deep' THEN 'Lubricants, Filter cake reducers'
    ELSE CASE WHEN NOT is_horizontal THEN own WHEN own = '' THEN 'Lubricants' ELSE own || ', Lubricants' END END AS additives,
  CASE p WHEN 'high' THEN 50e0 WHEN 'shale' THEN 50e0 WHEN 'middle' THEN 400e0 WHEN 'top' THEN 300e0 WHEN 'other' THEN 300e0 END AS chloride_base,
  CASE p WHEN 'high' THEN 0.1e0 WHEN 'shale' THEN 0.1e0 WHEN 'middle' THEN 0.5e0 WHEN 'top' THEN 0.3e0 WHEN 'other' THEN 0.3e0 END AS chloride_grad,
  CASE p WHEN 'seal' THEN greatest(14e0, {by_formation("9e0", "8.5e0", "9.5e0", "14e0")}) WHEN 'deep' THEN 11.5e0 + depth_measured / 1000 * 0.5e0
    WHEN 'high' THEN greatest(12e0 + depth_measured * 0.003e0, needed) WHEN 'shale' THEN greatest(10.5e0 + depth_measured * 0.0025e0, needed)
    WHEN 'middle' THEN greatest(9.5e0 + depth_measured * 0.02e0, needed) WHEN 'top' THEN greatest(8.5e0 + depth_measured * 0.015e0, needed)
    ELSE greatest(9.5e0 + depth_measured * 0.02e0, needed) END AS weight FROM chosen)
SELECT formation_type, mud, viscosity, ph, additives, chloride_base, chloride_grad, count(*) AS n_rows, ROUND(avg(weight), 5) AS weight
FROM mud GROUP BY 1, 2, 3, 4, 5, 6, 7"""


def _layer_sql(searched: str) -> str:
    return over(TELEMETRY, LAYERS) + f"""
, wells AS (SELECT well_id AS w, max(bottom) AS last_bottom, max(top) AS last_top, min(top) FILTER (WHERE reservoir) AS reservoir_top FROM layers GROUP BY 1)
, placed AS (SELECT tel.*, {searched} AS searched FROM tel JOIN wells ON well_id = w)
SELECT p.well_id, layer_id, formation, count(*) AS n_rows, ROUND(sum(depth_measured), 3) AS depth
FROM placed p LEFT JOIN layers l ON p.well_id = l.well_id AND searched >= top AND searched < bottom GROUP BY 1, 2, 3"""


_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_BEFORE = _OVER + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_WEAR = "CASE formation WHEN 'Shale' THEN {0} WHEN 'Sandstone' THEN {1} WHEN 'Limestone' THEN {2} WHEN 'Topsoil' THEN {3} ELSE {4} END"

SQL = {
    "ratio_features": over(TELEMETRY) + """SELECT well_id, ROUND(avg(pressure_reservoir / (reservoir_temperature + 1e-6)), 5) AS pt_ratio,
  ROUND(sum(ln(in_rate_flow_mud * 100 / (formation_permeability * porosity_formation + 1e-6))), 4) AS log_flow_efficiency,
  count(*) FILTER (WHERE formation_type = 'Limestone' AND part_id % 5 <> 0) AS n_carbonate,
  count(*) FILTER (WHERE formation_type = 'Sandstone' AND part_id % 5 <> 0) AS n_sandstone FROM tel GROUP BY 1""",
    "ratio_rows": over(TELEMETRY) + """SELECT order_id, part_id, line_id, well_id, ROUND(pressure_reservoir / (reservoir_temperature + 1e-6), 6) AS pt_ratio,
  ROUND(in_rate_flow_mud * 100 / (clay_content_percent * porosity_formation + 1e-6), 6) AS flow_efficiency FROM tel""",
    "pressures": over(TELEMETRY) + _means(
        hydrostatic=_HYDRO, formation=f"depth_measured * {_PGRAD} * 3.281e0", annulus=f"{_HYDRO} * 0.97e0", standpipe=f"{_HYDRO} * 1.05e0",
        overbalance=f"{_HYDRO} - depth_measured * {_PGRAD} * 3.281e0", fracture=f"depth_measured * {_FGRAD} * 3.281e0"),
    "temperatures": over(TELEMETRY) + _means(
        vertical=_VERTICAL, rock=_ROCKTEMP,
        mud_out=f"least(greatest({_ROCKTEMP} - 2 + rop - 10, {_ROCKTEMP} - 1.5e0), {_ROCKTEMP} + 15)"),
    "mud_weight_window": over(TELEMETRY) + _means(
        needed=f"greatest({_MINW}, least(CASE WHEN depth_measured > 50 THEN {_PGRAD} / 0.052e0 ELSE 8.5e0 END, {_MAXW}))",
        safe=f"greatest({_MINW}, least(mud_weight_in * 1.4e0, least({_MAXW}, {_FGRAD} / 0.052e0 * 0.9e0)))"),
    "drilling_rates": over(TELEMETRY) + f""", weighed AS (SELECT *, {_WOB} AS wob, CASE WHEN is_horizontal THEN 'Horizontal' WHEN line_id = 6 THEN 'Tangent'
  ELSE 'Vertical' END AS direction FROM tel), rated AS (SELECT *, {_ROP} AS r FROM weighed)
SELECT well_id, formation_type, ROUND(avg(wob), 5) AS weight_on_bit, ROUND(avg(r), 5) AS rop,
  ROUND(avg(greatest(0.1e0, r * CASE direction WHEN 'Vertical' THEN 1e0 WHEN 'Tangent' THEN 0.8e0 ELSE 0.6e0 END * power(wob / 10000, 0.7e0)
    * least(1.5e0, 1 + (mud_weight_in - {_MINW}) / 2) * 0.97e0)), 5) AS effective,
  ROUND(avg(wob / 10 * {by_formation("1.3e0", "1.1e0", "0.9e0", "1e0")} * 0.97e0), 5) AS torque,
  ROUND(avg(CASE direction WHEN 'Vertical' THEN 0e0 WHEN 'Tangent' THEN 45e0 ELSE 90e0 END), 5) AS inclination,
  ROUND(avg(CASE WHEN mud_type = 'Water-based' THEN 100e0 ELSE 80e0 END * CASE WHEN is_horizontal THEN 0.9e0 ELSE 1e0 END
    * {by_formation("0.9e0", "1e0", "1.1e0", "1e0")}), 5) AS inflow FROM rated GROUP BY 1, 2""",
    "fluid_condition": over(TELEMETRY) + _means(
        chloride="CASE WHEN line_id > 2 THEN 400e0 ELSE 300e0 END * CASE WHEN formation_type = 'Shale' THEN 1.5e0 ELSE 1e0 END "
                 "+ depth_measured * CASE WHEN line_id > 4 THEN 0.5e0 ELSE 0.3e0 END",
        efficiency="(1 - fluid_loss_api / 5 * 0.7e0) * (1 - solid_content / 20 * 0.3e0) * greatest(0.6e0, 1 - days_age_well / 500e0)"),
    "mud_programs": over(TELEMETRY) + _MUD,
    "mud_rule_table": over(TELEMETRY) + _MUD,
    "mud_rules_of_parts": over(TELEMETRY) + """, r AS (SELECT p_partkey % 500 + CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 500 ELSE 0 END AS priority, p_partkey AS rule_id,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey * 37 % 3600 AS DOUBLE) END AS min_depth,
  CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey * 37 % 3600 + p_partkey % 40 + 5 AS DOUBLE) END AS max_depth,
  CASE WHEN p_partkey % 3 <> 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'Shale' WHEN 1 THEN 'Limestone' WHEN 2 THEN 'Sandstone' ELSE 'Salt' END END AS formation,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 17 * 300 AS DOUBLE) END AS min_pressure,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 17 * 300 + 2500 AS DOUBLE) END AS max_pressure FROM part WHERE p_partkey % 143 <> 0)
, t AS (SELECT row_number() OVER () AS id, formation_type, depth_measured, pressure_reservoir FROM tel)
, m AS (SELECT id, min((r.priority, r.rule_id)) AS best FROM t JOIN r ON (min_depth IS NULL OR depth_measured >= min_depth)
  AND (max_depth IS NULL OR depth_measured < max_depth) AND (min_pressure IS NULL OR pressure_reservoir >= min_pressure)
  AND (max_pressure IS NULL OR pressure_reservoir < max_pressure) AND (formation IS NULL OR formation_type IN (formation, 'Salt')) GROUP BY 1)
SELECT formation_type, best[2] AS rule_id, best[1] AS priority, count(*) AS n_rows, ROUND(sum(depth_measured), 3) AS depth
FROM t LEFT JOIN m USING (id) GROUP BY 1, 2, 3""",
    "factor_lookup": over(TELEMETRY) + f"""SELECT formation_type, {by_formation("1.3e0", "1.1e0", "0.9e0", "1e0")} AS torque_factor,
  {by_formation("0.9e0", "1e0", "1.1e0", "1e0")} AS flow_factor, {_PGRAD} AS pressure_grad,
  {by_formation("''", "'Lubricants'", "'KCl, PHPA'", "''")} AS additives, count(*) AS n_rows FROM tel GROUP BY 1, 2, 3, 4, 5""",
    "layer_by_depth": _layer_sql("CASE WHEN depth_measured >= last_bottom THEN last_top ELSE depth_measured END"),
    "layer_with_horizontal": _layer_sql("""CASE WHEN is_horizontal AND reservoir_top IS NOT NULL THEN reservoir_top
  WHEN depth_measured >= last_bottom THEN last_top ELSE depth_measured END"""),
    "completion_types": over(LAYERS) + """, w AS (SELECT well_id, min(top) FILTER (WHERE reservoir) AS reservoir_top, bool_or(formation = 'Shale') AS has_shale
  FROM layers GROUP BY 1), c AS (SELECT *, CASE WHEN reservoir_top IS NULL THEN 'Open Hole' WHEN has_shale AND reservoir_top > 500 THEN 'Liner'
  WHEN has_shale THEN 'Cased' WHEN reservoir_top > 800 THEN 'Liner' ELSE 'Open Hole' END AS completion_type FROM w)
SELECT *, CASE completion_type WHEN 'Liner' THEN 20 WHEN 'Cased' THEN 30 ELSE 10 END AS density_perforation FROM c""",
    "label_encoding": """SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_index, n_rows
FROM (SELECT p_brand, count(*) AS n_rows FROM part GROUP BY 1)""",
    "label_decoding": """WITH l AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part))
SELECT CAST(p_partkey % 7 AS DOUBLE) AS guess, l.p_brand AS guessed_brand, count(*) AS n_rows FROM part JOIN l ON p_partkey % 7 = i GROUP BY 1, 2""",
    "scaled_features": """SELECT l_suppkey, ROUND(avg((l_quantity - qm) / qs), 6) AS l_quantity, ROUND(avg((l_extendedprice - pm) / ps), 6) AS l_extendedprice,
  0e0 AS constant FROM lineitem, (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm,
  stddev_pop(l_extendedprice) AS ps FROM lineitem) GROUP BY 1""",
    "time_text": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d') AS day,
  CAST(floor(epoch(ts - TIMESTAMP '2023-12-30 12:00:00') / 86400) AS BIGINT) AS days,
  strftime(TIMESTAMP '2023-12-30 12:00:00' + to_seconds(event_id * 90), '%Y-%m-%dT%H:%M:%S') AS later FROM events""",
    "running_depths": f"SELECT event_id, ROUND(sum(value / 3600) {_OVER}), 6) AS depth FROM events",
    "capped_contamination": over(STEPS) + f"""SELECT event_id, ROUND(least(1e0, COALESCE(sum(step) {_BEFORE}, 0e0)), 6) AS contamination FROM (SELECT *,
  {_WEAR.format("CASE WHEN event_id % 2 = 0 THEN 0.0005e0 ELSE 0.0015e0 END", "0.0008e0", "0.0006e0", "0.002e0", "0.001e0")} * 20 AS step FROM steps)""",
    "efficiency_floor": f"SELECT event_id, ROUND(greatest(0.5e0, 1e0 - COALESCE(sum(0.008e0) {_BEFORE}, 0e0)), 6) AS efficiency FROM events",
    "layer_changes": f"SELECT event_id, COALESCE(event_type <> lag(event_type) {_OVER}), false) AS changed FROM events",
    "bit_wear_walk": "WITH RECURSIVE " + STEPS.strip() + f""", n AS (SELECT *, row_number() {_OVER}) AS rn,
  {_WEAR.format("0.0003e0", "0.0005e0", "0.0008e0", "0.0001e0", "0.0004e0")} * sqrt(237443e0) AS step,
  {_WEAR.format("0.6e0", "0.7e0", "0.5e0", "0.9e0", "0.7e0")} AS kept FROM steps)
, walk AS (SELECT user_id, rn, event_id, event_type, step, 0e0 AS wear FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.rn, n.event_id, n.event_type, n.step,
    least(1e0, walk.wear + walk.step) * CASE WHEN n.event_type <> walk.event_type THEN n.kept ELSE 1e0 END
  FROM walk JOIN n ON n.user_id = walk.user_id AND n.rn = walk.rn + 1)
SELECT event_id, ROUND(wear, 6) AS bit_wear FROM walk""",
    "row_numbers": f"SELECT event_id, row_number() {_OVER}) AS place FROM events",
    "sequence_window": f"""SELECT event_id, array_to_string(list_transform(w, lambda v: CAST(ROUND(v * 100) AS BIGINT)), ',') AS steps, next_label FROM (
  SELECT event_id, list(value) {_OVER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS w, lead(event_type) {_OVER}) AS next_label FROM events)
WHERE len(w) = 10 AND next_label IS NOT NULL""",
    "series_per_interval": """SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS interval_start, count(*) AS n_rows, ROUND(avg(value), 6) AS avg_value
FROM events GROUP BY 1, 2""",
    "record_cards": over(TELEMETRY) + """SELECT order_id, part_id, line_id, well_id,
  printf('Record ID: %d | Phase: %s', order_id, phase_operation) || chr(10) || 'DateTime: ' || strftime(datetime, '%Y-%m-%dT%H:%M:%S') || chr(10)
  || 'Location: (' || printf('%.4f', well_id / 8e0) || ', ' || CASE WHEN line_id = 2 THEN 'null' ELSE printf('%.4f', line_id / 4e0) END
  || ') | Formation: ' || formation_type || chr(10)
  || printf('Temp: %.2f | Pressure: %.2f psi', reservoir_temperature, pressure_reservoir) || chr(10)
  || printf('Mud Type: %s | pH: %.2f | Viscosity: %.2f', mud_type, mud_ph, viscosity) || chr(10)
  || printf('Clay: %s | Content: %.2f %%', clay_mineralogy_type, clay_content_percent) AS card FROM tel""",
}
