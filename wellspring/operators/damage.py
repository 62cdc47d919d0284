"""Formation-damage types, scores and probabilities, and other classifications of a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import holds, lookup, number


@dataclass(frozen=True)
class DamageType:
    name: str
    controllable: bool
    test: Callable[[Callable[[str], Column]], Column]


# Damage types in the order in which they are tried, with their limits.
DAMAGE_TYPES = [
    DamageType("Clay & Iron Control", True,
               lambda c: (c("clay_content_percent") > 35) & (c("clay_mineralogy_type") == "Montmorillonite")),
    DamageType("Fluid Loss", True, lambda c: (c("fluid_loss_api") > 1.0) & (c("mud_type") == "Water-based")),
    DamageType("Scale/Sludge Incompatibility", True,
               lambda c: (c("chloride_content") > 500) & (c("solid_content") > 10)),
    DamageType("Near-Wellbore Emulsions", True, lambda c: (c("completion_type") == "Open Hole") & (c("mud_ph") < 7.0)),
    DamageType("Completion Damage", True, lambda c: (c("completion_type") == "Cased") & (c("overbalance") > 100)),
    DamageType("Surface Filtration", True, lambda c: (c("viscosity") > 18) & (c("mud_type") == "Oil-based")),
    DamageType("Ultra-Clean Fluids Control", True, lambda c: (c("viscosity") < 12) & (c("mud_type") == "Synthetic")),
    DamageType("Drilling-Induced Damage", False,
               lambda c: (c("formation_type") == "Shale") & (c("fluid_loss_api") > 0.8)),
    DamageType("Rock/Fluid Interaction", False,
               lambda c: (c("formation_permeability") < 30) & (c("reservoir_temperature") > 85)),
    DamageType("Stress/Corrosion Cracking", False,
               lambda c: (c("reservoir_temperature") > 95) & (c("mud_weight_in") > 9.5)),
]
DEFAULT_DAMAGE = "Generic Damage"


def _reading(name: str) -> Column:
    return F.col(name) if name.endswith("_type") else number(F.col(name))


def damage_type(types: list[DamageType] = DAMAGE_TYPES, default: str = DEFAULT_DAMAGE) -> Column:
    """The first damage type, in list order, whose condition holds."""
    chain = F
    for t in types:
        chain = chain.when(holds(t.test(_reading)), F.lit(t.name))
    return chain.otherwise(F.lit(default))


def all_damage_types(types: list[DamageType] = DAMAGE_TYPES) -> Column:
    """Every damage type whose condition holds."""
    return F.array_compact(F.array(*[F.when(holds(t.test(_reading)), F.lit(t.name)) for t in types]))


def is_controllable(kind: Column, types: list[DamageType] = DAMAGE_TYPES) -> Column:
    return kind.isin([t.name for t in types if t.controllable])


def damage_score(prob_base: Column, clay: Column, fluid_loss: Column, fractures: Column, api_loss: Column,
                 clay_limit: float = 30.0, fluid_limit: float = 1.0, api_limit: float = 0.6,
                 cap: float = 0.95) -> Column:
    """Base probability plus 0.2 for clay, 0.3 for fluid loss, 0.1 for fractures and 0.2 for API loss, capped."""
    extra = lambda test, amount: F.when(holds(test), F.lit(amount)).otherwise(0.0)
    return F.least(
        F.lit(cap),
        prob_base + extra(clay > clay_limit, 0.2) + extra(fluid_loss > fluid_limit, 0.3)
        + extra(fractures == 1, 0.1) + extra(api_loss > api_limit, 0.2),
    )


# Per formation the damages it is prone to: name, base severity, controllable, condition.
CANDIDATES = [
    ("Shale", "Clay Swelling", 0.50, "Yes",
     lambda c: (c("clay_content_percent") > 35) & c("clay_mineralogy_type").contains("Montmorillonite")),
    ("Shale", "Shale Instability", 0.45, "Yes", lambda c: c("clay_content_percent") > 30),
    ("Shale", "Borehole Collapse", 0.40, "No", lambda c: c("overbalance") > 500),
    ("Sandstone", "Fines Migration", 0.55, "Yes", lambda c: c("formation_permeability") < 50),
    ("Sandstone", "Sand Production", 0.45, "No", lambda c: c("rop") > 25),
    ("Limestone", "Acid Solubility", 0.60, "Yes", lambda c: c("mud_ph") < 7.0),
    ("Limestone", "Fracture Plugging", 0.50, "No", lambda c: c("fluid_loss_api") > 1.0),
    ("Salt", "Salt Creep", 0.70, "No", lambda c: c("reservoir_temperature") > 90),
    ("Salt", "Brine Influx", 0.60, "No", lambda c: c("chloride_content") > 1000),
]
NO_CANDIDATE = "Formation Damage"

# Base damage probability per formation.
BASE_PROBABILITY = {
    "Shale": 0.25, "Shale_Seal": 0.27, "Sandstone": 0.20, "Limestone": 0.17, "Topsoil": 0.05, "Weathered_Rock": 0.08,
    "Salt": 0.15, "Tight_Carbonate": 0.16,
}
BASE_PROBABILITY_DEFAULT = 0.10


def damage_candidates() -> Column:
    """Array of (severity, damage, controllable) for all candidates of the row's formation that apply."""
    found = [
        F.when(
            holds((F.col("formation_type") == formation) & test(F.col)),
            F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("damage"), F.lit(control).alias("controllable")),
        )
        for formation, name, severity, control, test in CANDIDATES
    ]
    return F.array_compact(F.array(*found))


def with_main_candidate(df: DataFrame) -> DataFrame:
    """Add the candidate of the highest base severity; 'Formation Damage' where none applies."""
    top = F.array_max("_candidates")
    return df.withColumn("_candidates", damage_candidates()).withColumns({
        "n_candidates": F.size("_candidates"),
        "main_damage": F.coalesce(top["damage"], F.lit(NO_CANDIDATE)),
        "main_severity": top["severity"],
        "main_controllable": top["controllable"],
    }).drop("_candidates")


def damage_probability(formation: Column, weight_on_bit: Column, rop: Column, temperature: Column,
                       trigger_weight: Column, trigger_rop: Column, trigger_temperature: Column) -> Column:
    """Base probability of the formation scaled by how far each reading exceeds its trigger, at most 0.3.

    An unknown reading or trigger, NaN included, leaves the probability as it is.
    """
    def factor(value: Column, trigger: Column, cap: float) -> Column:
        share = F.when(number(trigger) > 0, number(value) / number(trigger))
        return F.when(share.isNotNull(), F.least(F.lit(cap), share)).otherwise(1.0)

    return F.least(
        F.lit(0.3),
        lookup(formation, BASE_PROBABILITY, BASE_PROBABILITY_DEFAULT)
        * factor(weight_on_bit, trigger_weight, 1.5) * factor(rop, trigger_rop, 2.0)
        * factor(temperature, trigger_temperature, 1.8),
    )


def phase_by_age(days: Column) -> Column:
    return F.when(days < 100, "Drilling").when(days < 200, "Completion").otherwise("Production")


def phase_by_depth(depth: Column, total_depth: Column) -> Column:
    return F.when(depth < total_depth, "Drilling").otherwise("Completed")


def drilling_direction(depth: Column, total_depth: Column, has_horizontal: Column,
                       vertical_share: float = 0.75, tangent_share: float = 0.15) -> Column:
    """Vertical down to the vertical share of the total depth, tangent for the next share, then horizontal."""
    vertical_end = total_depth * vertical_share
    return (
        F.when(~holds(has_horizontal), "Vertical")
        .when(depth < vertical_end, "Vertical")
        .when(depth < vertical_end + total_depth * tangent_share, "Tangent")
        .otherwise("Horizontal")
    )


# Lower ends of the depth bands in metres.
DEPTH_BANDS = [(2, "surface"), (50, "near surface"), (300, "shallow"), (1500, "intermediate"), (3000, "deep")]


def depth_band(depth: Column) -> Column:
    chain = F
    for end, name in DEPTH_BANDS:
        chain = chain.when(depth < end, name)
    return F.when(depth.isNull(), F.lit(None)).otherwise(chain.otherwise("very deep"))
