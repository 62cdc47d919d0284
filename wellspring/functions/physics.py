"""Physical quantities of a drilled row as column expressions; depths in metres, pressures in psi.

The deterministic parts only: random scatter of a simulator has no place in an analysis.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.functions.nulls import holds, lookup

# Unit factors and limits.
PSI_PER_PPG_FOOT = 0.052
FEET_PER_METRE = 3.281
PRESSURE_GRADIENT = 0.465
FRACTURE_GRADIENT = 0.8
MIN_MUD_WEIGHT = 8.5
MAX_MUD_WEIGHT = 18.0
MAX_WEIGHT_ON_BIT = 25000.0

# Factors per formation, direction and bit.
DIRECTION_ROP = {"Vertical": 1.0, "Tangent": 0.8, "Horizontal": 0.6}
FLOW_FACTOR = {"Shale": 1.1, "Sandstone": 1.0, "Limestone": 0.9, "Topsoil": 1.0, "Weathered_Rock": 1.05}
TORQUE_FACTOR = {"Shale": 0.9, "Sandstone": 1.1, "Limestone": 1.3, "Topsoil": 0.7, "Weathered_Rock": 0.8}
BIT_WEIGHT_EFFECT = {"PDC": 1.0, "Tricone": 0.8}
BIT_ROP_EFFECT = {"PDC": 1.3, "Tricone": 0.9}

# Weight-on-bit ranges in kg.
SEAL_WEIGHT = {"Shale_Seal": (8000.0, 20000.0), "Salt": (10000.0, 22000.0), "Tight_Carbonate": (12000.0, 25000.0)}
SEAL_WEIGHT_DEFAULT = (10000.0, 20000.0)
RESERVOIR_WEIGHT = (6000.0, 15000.0)
ROCK_WEIGHT = {
    "Topsoil": (500.0, 2000.0), "Weathered_Rock": (1000.0, 4000.0), "Sandstone": (2000.0, 8000.0),
    "Shale": (3000.0, 12000.0), "Limestone": (5000.0, 18000.0),
}
ROCK_WEIGHT_DEFAULT = (2000.0, 10000.0)


def _or(value: Column | None, default: float) -> Column:
    return F.lit(default) if value is None else F.coalesce(value, F.lit(default))


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def hydrostatic_pressure(depth: Column, mud_weight: Column) -> Column:
    return mud_weight * depth * PSI_PER_PPG_FOOT * FEET_PER_METRE


def formation_pressure(depth: Column, gradient: Column | None = None) -> Column:
    return depth * _or(gradient, PRESSURE_GRADIENT) * FEET_PER_METRE


def annulus_pressure(depth: Column, mud_weight: Column) -> Column:
    return hydrostatic_pressure(depth, mud_weight) * 0.97


def standpipe_pressure(depth: Column, mud_weight: Column, friction: float = 0.0) -> Column:
    return hydrostatic_pressure(depth, mud_weight) * 1.05 + friction


def overbalance(depth: Column, mud_weight: Column, gradient: Column | None = None) -> Column:
    return hydrostatic_pressure(depth, mud_weight) - formation_pressure(depth, gradient)


def fracture_pressure(depth: Column, gradient: Column | None = None) -> Column:
    return depth * _or(gradient, FRACTURE_GRADIENT) * FEET_PER_METRE


def formation_temperature(vertical_depth: Column, gradient: Column) -> Column:
    return 20 + vertical_depth * gradient


def vertical_depth(depth: Column, vertical_section: Column, is_horizontal: Column) -> Column:
    return F.when(holds(is_horizontal), vertical_section).otherwise(depth)


def required_mud_weight(depth: Column, gradient: Column | None = None, minimum: Column | None = None,
                        maximum: Column | None = None) -> Column:
    """The weight that balances the formation pressure, inside the limits; 8.5 at the surface before limiting."""
    balance = F.when(
        depth > 0, formation_pressure(depth, gradient) / (depth * PSI_PER_PPG_FOOT * FEET_PER_METRE)
    ).otherwise(8.5)
    return clamp(balance, _or(minimum, MIN_MUD_WEIGHT), _or(maximum, MAX_MUD_WEIGHT))


def safe_mud_weight(mud_weight: Column, fracture_gradient: Column | None = None, minimum: Column | None = None,
                    maximum: Column | None = None) -> Column:
    """The weight kept below 90 percent of what would fracture the rock."""
    ceiling = F.least(_or(maximum, MAX_MUD_WEIGHT), _or(fracture_gradient, FRACTURE_GRADIENT) / PSI_PER_PPG_FOOT * 0.9)
    return clamp(mud_weight, _or(minimum, MIN_MUD_WEIGHT), ceiling)


def _weight_end(rock: Column, is_seal: Column, is_reservoir: Column, end: int) -> Column:
    seal = lookup(rock, {k: v[end] for k, v in SEAL_WEIGHT.items()}, SEAL_WEIGHT_DEFAULT[end])
    other = lookup(rock, {k: v[end] for k, v in ROCK_WEIGHT.items()}, ROCK_WEIGHT_DEFAULT[end])
    return F.when(holds(is_seal), seal).when(holds(is_reservoir), F.lit(RESERVOIR_WEIGHT[end])).otherwise(other)


def expected_weight_on_bit(rock: Column, depth: Column, wob_factor: Column, is_seal: Column, is_reservoir: Column,
                           is_horizontal: Column, bit: Column | None = None) -> Column:
    flat = holds(is_horizontal)
    low = _weight_end(rock, is_seal, is_reservoir, 0) * F.when(flat, 0.7).otherwise(1.0)
    high = _weight_end(rock, is_seal, is_reservoir, 1) * F.when(flat, 0.8).otherwise(1.0)
    reached = low + (high - low) * F.least(F.lit(1.0), depth / 3000)
    effect = lookup(F.lit("PDC") if bit is None else bit, BIT_WEIGHT_EFFECT, 1.0)
    return F.least(reached * wob_factor * effect, F.lit(MAX_WEIGHT_ON_BIT))


def expected_rop(weight_on_bit: Column, depth: Column, density: Column, base_rop: Column, is_seal: Column,
                 is_reservoir: Column, is_horizontal: Column, bit: Column | None = None) -> Column:
    """Rate of penetration in metres per hour between 2 and 100."""
    rock = 2.5 / density * base_rop
    deep = F.greatest(F.lit(0.3), 1 - depth / 6000)
    push = F.pow(F.least(weight_on_bit, F.lit(MAX_WEIGHT_ON_BIT)) / 10000, F.lit(0.7))
    turn = F.when(holds(is_horizontal), F.when(holds(is_seal), 0.6 * 0.8).otherwise(0.6)).otherwise(1.0)
    rich = F.when(holds(is_reservoir), 1.2).otherwise(1.0)
    effect = lookup(F.lit("PDC") if bit is None else bit, BIT_ROP_EFFECT, 1.3)
    return clamp(rock * deep * push * effect * turn * rich, F.lit(2.0), F.lit(100.0))


def effective_rop(base_rop: Column, direction: Column, weight_on_bit: Column, mud_weight: Column,
                  min_mud_weight: Column | None, efficiency: Column) -> Column:
    push = F.pow(weight_on_bit / 10000, F.lit(0.7))
    press = F.least(F.lit(1.5), 1 + (mud_weight - _or(min_mud_weight, MIN_MUD_WEIGHT)) / 2)
    return F.greatest(F.lit(0.1), base_rop * lookup(direction, DIRECTION_ROP, 1.0) * push * press * efficiency)


def torque(weight_on_bit: Column, formation: Column, efficiency: Column) -> Column:
    return weight_on_bit / 10 * lookup(formation, TORQUE_FACTOR, 1.0) * efficiency


def chloride_content(depth: Column, formation: Column, base: Column | None = None, gradient: Column | None = None) -> Column:
    start = _or(base, 300.0) * F.when(holds(formation == "Shale"), 1.5).otherwise(1.0)
    return start + depth * _or(gradient, 0.3)


def equipment_efficiency(bit_wear: Column, mud_contamination: Column, hours: Column) -> Column:
    return (1 - bit_wear * 0.7) * (1 - mud_contamination * 0.3) * F.greatest(F.lit(0.6), 1 - hours / 500)


def mud_temperature_out(temperature_in: Column, difference: Column, formation_temp: Column) -> Column:
    """At least half a degree above the inflow, at most 15 degrees above the formation."""
    return F.least(F.greatest(temperature_in + difference, temperature_in + 0.5), formation_temp + 15)


def inclination(direction: Column, tangent_angle: float | None = None) -> Column:
    """Degrees from the vertical; on a tangent the given angle, else unknown."""
    return F.when(direction == "Vertical", 0.0).when(direction == "Horizontal", 90.0).when(
        direction == "Tangent", F.lit(tangent_angle).cast("double"))


def expected_inflow(mud_type: Column, formation: Column, is_horizontal: Column) -> Column:
    base = F.when(holds(mud_type == "Water-based"), 100.0).otherwise(80.0)
    return base * F.when(holds(is_horizontal), 0.9).otherwise(1.0) * lookup(formation, FLOW_FACTOR, 1.0)
