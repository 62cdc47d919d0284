"""Choice of the mud program for a depth, formation and pressure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions import physics
from wellspring.functions.nulls import holds, lookup
from wellspring.operators.rule_table import FEW_RULES, match_rules
from wellspring.operators.layers import PREFERRED_MUD, formation_additives, formation_attribute


@dataclass(frozen=True)
class MudProgram:
    type: str
    base_weight: float
    weight_grad: float
    viscosity: float
    ph: float
    chloride_base: float | None = None
    chloride_grad: float | None = None
    min_depth: float | None = None
    max_depth: float | None = None
    formations: tuple[str, ...] | None = None
    min_pressure: float | None = None
    max_pressure: float | None = None


# The programs, the most specific first and the one without conditions last.
PROGRAMS = [
    MudProgram("Synthetic Oil-based", 12.0, 0.003, 45.0, 7.0, min_depth=600.0, min_pressure=3000.0),
    MudProgram("Inhibitive Water-based", 10.5, 0.0025, 35.0, 9.0, formations=("Shale",), min_pressure=1500.0),
    MudProgram("Water-based", 9.5, 0.02, 25.0, 8.5, 400.0, 0.5, min_depth=50.0, max_depth=300.0),
    MudProgram("Water-based", 8.5, 0.015, 15.0, 8.0, 300.0, 0.3, max_depth=50.0),
    MudProgram("Water-based", 9.5, 0.02, 30.0, 8.5),
]
REQUIRED_FIELDS = ["type", "base_weight", "weight_grad", "viscosity", "ph"]
SEAL_ADDITIVES = ["Bridging agents", "Lost circulation materials"]
RESERVOIR_ADDITIVES = ["Lubricants", "Filter cake reducers"]


def program_table(spark: SparkSession, programs: Sequence[MudProgram] = PROGRAMS) -> DataFrame:
    rows = [(i, p.type, p.base_weight, p.weight_grad, p.viscosity, p.ph, p.chloride_base, p.chloride_grad)
            for i, p in enumerate(programs)]
    return spark.createDataFrame(
        rows, "priority int, type string, base_weight double, weight_grad double, viscosity double, ph double, "
              "chloride_base double, chloride_grad double")


def rule_table(spark: SparkSession, programs: Sequence[MudProgram] = PROGRAMS) -> DataFrame:
    """Programs with their conditions as a table of rules; a null condition asks nothing."""
    rows = [(i, p.type, p.base_weight, p.weight_grad, p.viscosity, p.ph, p.chloride_base, p.chloride_grad, p.min_depth, p.max_depth,
             list(p.formations) if p.formations else None, p.min_pressure, p.max_pressure) for i, p in enumerate(programs)]
    return spark.createDataFrame(
        rows, "priority int, type string, base_weight double, weight_grad double, viscosity double, ph double, chloride_base double, "
              "chloride_grad double, min_depth double, max_depth double, formations array<string>, min_pressure double, max_pressure double")


def missing_fields(programs: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Programs that lack a required field, with the names of the fields."""
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return programs.withColumn("missing_fields", gone).where(F.size("missing_fields") > 0)


def fill_chloride(programs: DataFrame) -> DataFrame:
    water = holds(F.col("type") == "Water-based")
    return programs.withColumns({
        "chloride_base": F.coalesce("chloride_base", F.when(water, 300.0).otherwise(50.0)),
        "chloride_grad": F.coalesce("chloride_grad", F.when(water, 0.3).otherwise(0.1)),
    })


def _matches(p: MudProgram, depth: Column, formation: Column, pressure: Column) -> Column:
    tests = [F.lit(True)]
    if p.min_depth is not None:
        tests.append(depth >= p.min_depth)
    if p.max_depth is not None:
        tests.append(depth < p.max_depth)
    if p.formations is not None:
        tests.append(formation.isin(*p.formations))
    if p.min_pressure is not None:
        tests.append(pressure >= p.min_pressure)
    if p.max_pressure is not None:
        tests.append(pressure < p.max_pressure)
    result = tests[0]
    for t in tests[1:]:
        result = result & t
    return holds(result)


def _choice(mud_type: Column, weight: Column, viscosity: Column, ph: Column, additives: Column,
            chloride_base: Column, chloride_grad: Column) -> Column:
    return F.struct(
        mud_type.alias("type"), weight.cast("double").alias("weight"), viscosity.cast("double").alias("viscosity"),
        ph.cast("double").alias("ph"), additives.alias("additives"),
        chloride_base.cast("double").alias("chloride_base"), chloride_grad.cast("double").alias("chloride_grad"),
    )


def mud_program(depth: Column, formation: Column, is_seal: Column, is_reservoir: Column, is_horizontal: Column,
                pressure_grad: Column | None = None, programs: Sequence[MudProgram] = PROGRAMS) -> Column:
    """Struct of type, weight, viscosity, ph, additives and chloride terms for a row.

    Seals and deep reservoirs have fluids of their own. Otherwise the first program whose conditions
    hold is taken, its weight raised to what the formation pressure needs; horizontal sections get a
    thicker fluid and lubricants.
    """
    gradient = formation_attribute(formation, "pressure_grad") if pressure_grad is None else pressure_grad
    pressure = physics.formation_pressure(depth, gradient)
    needed, thicker, additives = _conditions(depth, formation, is_horizontal, gradient)
    chain = _special_cases(depth, formation, is_seal, is_reservoir)
    for p in programs:
        water = p.type == "Water-based"
        chain = chain.when(_matches(p, depth, formation, pressure), _choice(
            F.lit(p.type), F.greatest(p.base_weight + depth * p.weight_grad, needed),
            p.viscosity * thicker, F.lit(p.ph), additives,
            F.lit(p.chloride_base if p.chloride_base is not None else 300.0 if water else 50.0),
            F.lit(p.chloride_grad if p.chloride_grad is not None else 0.3 if water else 0.1)))
    return chain.otherwise(_without_program(depth, formation, needed, thicker, additives))


def with_mud_program(df: DataFrame, rules: DataFrame, name: str = "mud", depth: str = "depth_measured", formation: str = "formation_type",
                     is_seal: str = "is_seal", is_reservoir: str = "is_reservoir", is_horizontal: str = "is_horizontal",
                     pressure_grad: Column | None = None, few_rules: int = FEW_RULES) -> DataFrame:
    """Add the struct of ``mud_program`` with the programs taken from a table of rules, as ``rule_table`` makes one.

    ``rules`` has ``priority``, the fields of a program and its conditions; any number of rules will do. The rule of
    the lowest priority whose conditions hold is taken, and where none holds the fluid that the formation prefers.
    """
    gradient = formation_attribute(F.col(formation), "pressure_grad") if pressure_grad is None else pressure_grad
    matched = match_rules(
        df.withColumn("_mud_pressure", physics.formation_pressure(F.col(depth), gradient)), fill_chloride(rules),
        {depth: ("min_depth", "max_depth"), "_mud_pressure": ("min_pressure", "max_pressure")}, {formation: "formations"}, name="_program", few_rules=few_rules)
    d, f, p = F.col(depth), F.col(formation), F.col("_program")
    needed, thicker, additives = _conditions(d, f, F.col(is_horizontal), gradient)
    programmed = _choice(
        p["type"], F.greatest(p["base_weight"] + d * p["weight_grad"], needed), p["viscosity"] * thicker, p["ph"], additives, p["chloride_base"], p["chloride_grad"])
    chosen = _special_cases(d, f, F.col(is_seal), F.col(is_reservoir)).when(p.isNotNull(), programmed).otherwise(
        _without_program(d, f, needed, thicker, additives))
    return matched.withColumn(name, chosen).drop("_program", "_mud_pressure")


def _conditions(depth: Column, formation: Column, is_horizontal: Column, gradient: Column) -> tuple[Column, Column, Column]:
    """The weight that the pressure needs, the factor on viscosity and the additives of a row."""
    needed = physics.required_mud_weight(
        depth, gradient, formation_attribute(formation, "min_mud_weight"), formation_attribute(formation, "max_mud_weight"))
    flat, own = holds(is_horizontal), formation_additives(formation)
    return needed, F.when(flat, 1.3).otherwise(1.0), F.when(flat, F.array_append(own, F.lit("Lubricants"))).otherwise(own)


def _special_cases(depth: Column, formation: Column, is_seal: Column, is_reservoir: Column) -> Column:
    """Fluids of seals and deep reservoirs, as the beginning of a chain of cases."""
    shale_name, minimum, none = holds(formation.contains("Shale")), formation_attribute(formation, "min_mud_weight"), F.lit(None)
    texts = lambda items: F.array(*[F.lit(i) for i in items])
    seal = _choice(
        F.when(shale_name, "Inhibitive Water-based").otherwise("Synthetic Oil-based"),
        F.greatest(F.lit(14.0), F.coalesce(minimum, F.lit(14.0))), F.lit(45.0),
        F.when(shale_name, 9.0).otherwise(7.5), texts(SEAL_ADDITIVES), none, none)
    deep = _choice(F.lit("Synthetic Oil-based"), 11.5 + depth / 1000 * 0.5, F.lit(40.0), F.lit(7.0),
                   texts(RESERVOIR_ADDITIVES), none, none)
    return F.when(holds(is_seal), seal).when(holds(is_reservoir) & holds(depth > 1500), deep)


def _without_program(depth: Column, formation: Column, needed: Column, thicker: Column, additives: Column) -> Column:
    none = F.lit(None)
    return _choice(
        lookup(formation, PREFERRED_MUD, "Water-based"), needed * 1.05,
        F.when(depth > 1000, 37.5).otherwise(22.5) * thicker,
        F.when(holds(formation == "Shale"), 9.0).otherwise(8.5), additives, none, none)
