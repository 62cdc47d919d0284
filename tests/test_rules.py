import pytest
from pyspark.sql import functions as F

from wellspring.functions import physics
from wellspring.operators.combination_rules import (
    MUD_SYNONYMS, RULES, applicable_rules, fired_rules, flag_combinations, fold_synonyms, rule_counts, skipped_rules,
)
from wellspring.operators.damage import damage_score, damage_type, depth_band, drilling_direction, is_controllable, phase_by_age
from wellspring.operators.features import add_features, standard_scale
from wellspring.operators.layers import LAYERS_PER_BUCKET, _bucket, completion_by_well, layer_lookup
from wellspring.operators.mud import fill_chloride, missing_fields, mud_program, program_table
from wellspring.operators.validation import (
    InvalidData, range_violations, require_rows, required_columns_report, suspicious_summary, validate_structure,
)
from wellspring.vocabulary import (
    CONTRACT_COLUMNS, canonical_name, contract_schema, enforce_schema, for_database, record_schema, to_canonical, yes_no,
)
from workloads.flows import stored_file
from workloads.inputs import telemetry

DAMAGE = ("clay_content_percent double, clay_mineralogy_type string, formation_type string, fluid_loss_api double, mud_type string, "
          "chloride_content double, solid_content double, completion_type string, mud_ph double, formation_permeability double, "
          "reservoir_temperature double, overbalance double, viscosity double, mud_weight_in double")


def test_damage_fixtures(spark):
    rows = [(40.0, "Montmorillonite", "Shale", 0.5, "Oil-based", 100.0, 5.0, "Cased", 7.0, 100.0, 75.0, 80.0, 10.0, 9.0),
            (20.0, "Illite", "Sandstone", 0.4, "Water-based", 200.0, 5.0, "Open Hole", 6.8, 100.0, 75.0, 80.0, 10.0, 9.0),
            (10.0, "Kaolinite", "Sandstone", 0.4, "Oil-based", 100.0, 5.0, "Cased", 7.0, 100.0, 75.0, 50.0, 10.0, 9.0)]
    df = spark.createDataFrame(rows, DAMAGE).withColumn("d", damage_type()).withColumn("c", is_controllable(F.col("d")))
    assert [(r["d"], r["c"]) for r in df.collect()] == [
        ("Clay & Iron Control", True), ("Near-Wellbore Emulsions", True), ("Generic Damage", False)]


def test_damage_score_fixtures(spark):
    df = spark.createDataFrame([(0.1, 10.0, 0.5, 0, 0.4), (0.1, 35.0, 1.5, 1, 0.8), (0.8, 50.0, 2.0, 1, 1.0)],
                               "p double, c double, f double, x int, a double")
    got = [r[0] for r in df.select(damage_score(*[F.col(c) for c in "pcfxa"])).collect()]
    assert got == pytest.approx([0.1, 0.9, 0.95])


def test_phases_bands_directions(spark):
    df = spark.createDataFrame([(50,), (150,), (250,)], "d int")
    assert [r[0] for r in df.select(phase_by_age(F.col("d"))).collect()] == ["Drilling", "Completion", "Production"]
    depths = spark.createDataFrame([(float(d),) for d in (1, 2, 50, 299, 1500, 2999, 3000)], "d double")
    assert [r[0] for r in depths.select(depth_band(F.col("d"))).collect()] == [
        "surface", "near surface", "shallow", "shallow", "deep", "deep", "very deep"]
    ends = spark.createDataFrame([(74.9,), (75.0,), (89.9,), (90.0,)], "d double")
    turned = ends.select(drilling_direction(F.col("d"), F.lit(100.0), F.lit(True)), drilling_direction(F.col("d"), F.lit(100.0), F.lit(None).cast("boolean")))
    assert [tuple(r) for r in turned.collect()] == [("Vertical", "Vertical"), ("Tangent", "Vertical"), ("Tangent", "Vertical"), ("Horizontal", "Vertical")]


def test_every_rule_fires_and_not_always(spark):
    tel = telemetry(spark, "/root/testdata/sf0.01")
    total = tel.count()
    counts = {r["rule"]: r["n_fired"] for r in rule_counts(tel).collect()}
    assert len(counts) == 20 and all(0 < n < total for n in counts.values())
    both = fired_rules(flag_combinations(tel))
    assert both.where(F.col("Combination_Anomaly") != (F.size("fired_rules") > 0)).isEmpty()


def test_rules_with_gaps_other_names_and_missing_columns(spark):
    df = spark.createDataFrame([("Shale", 60.0, None), (None, 60.0, 3.0), ("Shale", None, 200.0), ("Shale", 50.0, 1.0)],
                               "Formation_Type string, Formation_Permeability_mD double, Viscosity_cP double")
    assert [r.name for r in applicable_rules(df)] == ["R01"]
    assert len(skipped_rules(df)) == len(RULES) - 1
    flags = [r["Combination_Anomaly"] for r in flag_combinations(df).collect()]
    assert flags == [True, False, False, False]
    muds = spark.createDataFrame([("Synthetic Oil-based",), ("Oil-based",), (None,)], "mud_type string")
    assert [r[0] for r in fold_synonyms(muds, "mud_type", MUD_SYNONYMS).collect()] == ["Synthetic", "Oil-based", None]


def test_structure_and_ranges(spark, three_wells):
    assert validate_structure(three_wells) == (True, "structure is valid")
    ok, message = validate_structure(three_wells.drop("Formation"))
    assert not ok and "Formation" in message
    ok, message = validate_structure(three_wells.withColumn("Formation", F.lit(1)).withColumn("Pressure_psi", F.lit("x")))
    assert not ok and message.count("expected") == 2
    report = {r["column"]: (r["present"], r["fits"]) for r in required_columns_report(three_wells.drop("Formation")).collect()}
    assert report == {"Temperature_C": (True, True), "Pressure_psi": (True, True), "Formation": (False, False)}
    with pytest.raises(InvalidData):
        require_rows(three_wells.limit(0))
    odd = spark.createDataFrame([(-1.0, 20.0), (401.0, None), (400.0, 14.0)], "Temperature_C double, pH double")
    assert {r["column"]: (r["below_min"], r["above_max"]) for r in range_violations(odd).collect()} == {"Temperature_C": (1, 1), "pH": (0, 1)}
    acid = spark.createDataFrame([("ACIDIC", "shale", "Open Hole"), ("acidic", None, "open hole"), ("basic", "Shale", "Open hole")],
                                 "Fluid_Type string, Formation_Type string, Completion_Type string")
    assert tuple(suspicious_summary(acid).first())[:2] == (1, 33.33)


def test_vocabulary(spark, sf):
    names = {"Clay_Content_Percent_%": "clay_content_percent", "clay_content_percent_p": "clay_content_percent",
             "Density_Perforation_shots_m": "density_perforation", "In_Rate_Flow_Mud_l_min": "in_rate_flow_mud", "pH": "mud_ph",
             "Fluid_Loss_API_ml_30min": "fluid_loss_api", "ROP_m_hr": "rop", "LONG_deg": "long", "Mud_Temperature_In_C": "mud_temperature_in",
             "Pressure_psi": "pressure", "Flow_Rate_bbl_day": "flow_rate", " Days_Age_Well_days": "days_age_well", "Well_ID": "well_id"}
    assert {n: canonical_name(n) for n in names} == names
    with pytest.raises(ValueError):
        to_canonical(spark.createDataFrame([(1, 2)], "pH int, Mud_pH int"))
    assert len(record_schema()) == 38 and len(contract_schema()) == 45
    stored = for_database(stored_file(spark, sf))
    assert stored.columns == CONTRACT_COLUMNS
    assert stored.schema["mud_ph"].dataType.simpleString() == "decimal(3,1)"
    texts = spark.createDataFrame([("Yes",), ("No",), ("maybe",), (None,)], "a string")
    assert [r[0] for r in texts.select(yes_no("a")).collect()] == [True, False, None, None]
    wide = spark.createDataFrame([(123.45, "x")], "Mud_Weight_In_ppg double, extra string")
    from pyspark.sql import types as T
    one = enforce_schema(wide, T.StructType([T.StructField("mud_weight_in_ppg", T.DecimalType(4, 2))]))
    assert one.columns == ["mud_weight_in_ppg"] and one.first()[0] is None
    with pytest.raises(ValueError):
        enforce_schema(wide, T.StructType([T.StructField("absent", T.LongType())]))


def test_features_are_skipped_without_their_columns(three_wells, spark):
    made, names = add_features(three_wells)
    assert names == ["PT_Ratio", "Carbonate_Flag", "Sandstone_Flag"]
    assert [r["Carbonate_Flag"] for r in made.orderBy("Well_ID").collect()] == [0, 1, 0]
    assert add_features(three_wells, False)[1] == ["PT_Ratio"]
    zero = spark.createDataFrame([(5.0, -1e-6)], "Pressure_psi double, Temperature_C double")
    assert add_features(zero)[0].first()["PT_Ratio"] is None
    flat = standard_scale(spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double"), ["a", "b"])
    assert [(r["a_scaled"], r["b_scaled"]) for r in flat.collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_layer_lookup_edges(spark):
    layers = spark.createDataFrame(
        [(1, 0.0, 10.0, "Topsoil", False), (1, 10.0, 500.0, "Shale", True), (1, 500.0, 900.0, "Sandstone", True), (2, 0.0, 50.0, "Shale", False)],
        "well_id long, top double, bottom double, formation string, reservoir boolean")
    rows = spark.createDataFrame(
        [(1, 0.0, False), (1, 10.0, False), (1, 499.9, None), (1, 5000.0, False), (1, 700.0, True), (2, 20.0, True), (3, 5.0, False), (1, -1.0, False), (1, None, False)],
        "well_id long, depth double, flat boolean")
    want = {(1, 0.0): "Topsoil", (1, 10.0): "Shale", (1, 499.9): "Shale", (1, 5000.0): "Sandstone", (1, 700.0): "Shale",
                   (2, 20.0): "Shale", (3, 5.0): None, (1, -1.0): None, (1, None): None}
    for few in (64, 0):
        found = layer_lookup(rows, layers, horizontal="flat", few_layers=few).collect()
        assert {(r["well_id"], r["depth"]): r["formation"] for r in found} == want and len(found) == 9
    kinds = {r["well_id"]: (r["completion_type"], r["density_perforation"]) for r in completion_by_well(layers).collect()}
    assert kinds == {1: ("Cased", 30), 2: ("Open Hole", 10)}


def test_layers_of_a_finely_layered_well(spark):
    """One shallow well of 6000 layers among deep wells of two: its buckets stay small and every row finds its layer."""
    fine = spark.range(6000).selectExpr("0L AS well_id", "id / 10 AS top", "(id + 1) / 10 AS bottom", "concat('f', id) AS formation")
    coarse = spark.range(1, 40).selectExpr("id AS well_id", "explode(array(0, 9000)) AS low").selectExpr(
        "well_id", "CAST(low AS DOUBLE) AS top", "low + 9000.0D AS bottom", "concat('c', low) AS formation")
    layers = fine.unionByName(coarse)
    rows = spark.range(8000).selectExpr("IF(id % 2 = 0, 0L, id % 40) AS well_id", "id * 0.074D AS depth", "id")
    found = {r["id"]: r for r in layer_lookup(rows, layers).collect()}
    assert len(found) == 8000
    for r in found.values():
        assert r["top"] <= r["depth"] < r["bottom"] and r["formation"][0] == "cf"[r["well_id"] == 0]
    facts = layers.groupBy("well_id").agg(F.min("top").alias("_first_top"), F.max("bottom").alias("_last_bottom"), F.count(F.lit(1)).alias("_layers"))
    sizes = layers.join(facts, "well_id").groupBy("well_id", _bucket("top")).count()
    assert sizes.agg(F.max("count")).first()[0] <= LAYERS_PER_BUCKET + 1


def test_mud_program_choices(spark):
    rows = [(20.0, "Sandstone", False, False, False), (100.0, "Sandstone", False, False, True), (1200.0, "Shale", False, False, False),
            (400.0, "Limestone", False, False, False), (2500.0, "Limestone", False, False, False), (2000.0, "Sandstone", False, True, True),
            (900.0, "Shale_Seal", True, False, False), (0.0, "Granite", False, False, None)]
    df = spark.createDataFrame(rows, "d double, f string, s boolean, r boolean, h boolean")
    chosen = df.select(mud_program(F.col("d"), F.col("f"), F.col("s"), F.col("r"), F.col("h")).alias("m")).select("m.*").collect()
    assert [c["type"] for c in chosen] == ["Water-based", "Water-based", "Inhibitive Water-based", "Water-based", "Synthetic Oil-based",
                                           "Synthetic Oil-based", "Inhibitive Water-based", "Water-based"]
    assert chosen[1]["viscosity"] == pytest.approx(32.5) and chosen[1]["additives"] == ["Lubricants", "Lubricants"]
    assert chosen[2]["weight"] == pytest.approx(13.5) and chosen[5]["weight"] == pytest.approx(12.5)
    assert chosen[6]["weight"] == 14.0 and chosen[7]["weight"] == 8.5
    table = program_table(spark)
    assert missing_fields(table).isEmpty()
    filled = {r["priority"]: (r["chloride_base"], r["chloride_grad"]) for r in fill_chloride(table).collect()}
    assert filled[0] == (50.0, 0.1) and filled[2] == (400.0, 0.5) and filled[4] == (300.0, 0.3)


def test_physics_limits(spark):
    row = spark.range(1).select(
        physics.required_mud_weight(F.lit(0.0)), physics.required_mud_weight(F.lit(1000.0), F.lit(0.9)),
        physics.safe_mud_weight(F.lit(17.0), F.lit(0.6)), physics.effective_rop(F.lit(0.0), F.lit("Vertical"), F.lit(1.0), F.lit(9.0), None, F.lit(1.0)),
        physics.mud_temperature_out(F.lit(10.0), F.lit(-5.0), F.lit(50.0)), physics.mud_temperature_out(F.lit(60.0), F.lit(9.0), F.lit(50.0)),
        physics.inclination(F.lit("Tangent")), physics.equipment_efficiency(F.lit(1.0), F.lit(1.0), F.lit(1000.0))).first()
    assert list(row)[:2] == pytest.approx([8.5, 0.9 / 0.052])
    assert row[2] == pytest.approx(0.6 / 0.052 * 0.9) and row[3] == 0.1
    assert row[4] == 10.5 and row[5] == 65.0 and row[6] is None and row[7] == pytest.approx(0.3 * 0.7 * 0.6)


def test_nan_fires_no_rule_and_breaks_no_range(spark):
    from wellspring.operators.combination_rules import flag_combinations
    from wellspring.operators.damage import damage_type
    from wellspring.operators.features import standard_scale
    from wellspring.operators.validation import range_violations

    nan = float("nan")
    rows = spark.createDataFrame([("Shale", nan, nan), ("Shale", 60.0, 20.0), ("Shale", 10.0, None)], "Formation_Type string, Formation_Permeability double, x double")
    assert [r["Combination_Anomaly"] for r in flag_combinations(rows).collect()] == [False, True, False]
    assert [tuple(r) for r in range_violations(rows, {"x": (0.0, 10.0)}).collect()] == [("x", 0, 1)]
    assert [r["x_scaled"] for r in standard_scale(rows, ["x"]).collect()] == [None, 0.0, None]
    needs = "clay_content_percent fluid_loss_api chloride_content solid_content mud_ph overbalance viscosity formation_permeability reservoir_temperature mud_weight_in".split()
    broken = rows.limit(1).select(*[F.lit(nan).alias(c) for c in needs], *[F.lit(t).alias(c) for c, t in (
        ("clay_mineralogy_type", "Montmorillonite"), ("mud_type", "Water-based"), ("completion_type", "Cased"), ("formation_type", "Shale"))])
    assert broken.select(damage_type().alias("d")).first()["d"] == "Generic Damage"
