"""Column names: one canonical vocabulary, the spellings that map to it, and the table contract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a telemetry record with the type of each.
RECORD_FIELDS = [
    ("record_id", "bigint"), ("api_well_id", "bigint"), ("long", "double"), ("lat", "double"), ("datetime", "string"),
    ("days_age_well", "bigint"), ("phase_operation", "string"), ("formation_type", "string"),
    ("clay_mineralogy_type", "string"), ("fractures_presence", "int"), ("reservoir_temperature", "double"),
    ("formation_permeability", "double"), ("clay_content_percent", "double"), ("completion_type", "string"),
    ("density_perforation", "double"), ("depth_measured", "double"), ("depth_bit", "double"),
    ("weight_on_bit", "double"), ("rpm", "double"), ("rop", "double"), ("torque", "double"),
    ("pressure_standpipe", "double"), ("pressure_annulus", "double"), ("overbalance", "double"),
    ("pressure_reservoir", "double"), ("mud_type", "string"), ("in_rate_flow_mud", "double"),
    ("mud_weight_in", "double"), ("mud_temperature_in", "double"), ("chloride_content", "double"),
    ("solid_content", "double"), ("mud_ph", "double"), ("out_rate_flow_mud", "double"), ("volume_pit", "double"),
    ("mud_temperature_out", "double"), ("viscosity", "double"), ("fluid_loss_api", "double"),
    ("mud_weight_out", "double"),
]

# Further canonical names found in stored files and in cleaner input.
FURTHER_NAMES = [
    "drilling_direction", "layer_id", "layer_type", "porosity_formation", "active_damage", "type_damage",
    "damage_severity", "controllable", "temperature", "pressure", "permeability", "flow_rate", "depth", "porosity",
    "salinity", "mud_weight", "formation", "fluid_type",
]

# Unit endings that stored files add to a name.
UNIT_ENDINGS = [
    "ml_30min", "shots_m", "rev_min", "bbl_day", "l_min", "mg_l", "m_hr", "days", "deg", "ppg", "psi", "bbl", "pct",
    "ppm", "md", "kg", "nm", "cp", "m", "c", "p", "%",
]

# Names that differ in more than the unit.
SYNONYMS = {"ph": "mud_ph"}

# Columns whose percent sign a database does not take.
PERCENT_RENAMES = {
    "Clay_Content_Percent_%": "Clay_Content_Percent_P",
    "Porosity_Formation_%": "Porosity_Formation_P",
    "Solid_Content_%": "Solid_Content_P",
}

# The target table, without the key the database makes; every column must be filled.
CONTRACT = [
    ("api_well_id", "bigint"), ("long_deg", "double"), ("lat_deg", "double"), ("datetime", "timestamp_ntz"),
    ("days_age_well_days", "int"), ("drilling_direction", "string"), ("depth_measured_m", "double"),
    ("depth_bit_m", "double"), ("layer_id", "int"), ("formation_type", "string"), ("layer_type", "string"),
    ("clay_mineralogy_type", "string"), ("clay_content_percent_p", "decimal(6,4)"),
    ("formation_permeability_md", "double"), ("porosity_formation_p", "decimal(5,2)"),
    ("fractures_presence", "boolean"), ("phase_operation", "string"), ("weight_on_bit_kg", "double"),
    ("rop_m_hr", "double"), ("rpm_rev_min", "double"), ("torque_nm", "double"), ("mud_type", "string"),
    ("mud_weight_in_ppg", "decimal(4,2)"), ("mud_weight_out_ppg", "decimal(6,4)"), ("mud_temperature_in_c", "double"),
    ("mud_temperature_out_c", "double"), ("in_rate_flow_mud_l_min", "double"), ("out_rate_flow_mud_l_min", "double"),
    ("viscosity_cp", "double"), ("mud_ph", "decimal(3,1)"), ("fluid_loss_api_ml_30min", "double"),
    ("solid_content_p", "decimal(5,3)"), ("chloride_content_mg_l", "double"), ("volume_pit_bbl", "double"),
    ("pressure_standpipe_psi", "double"), ("pressure_annulus_psi", "double"), ("pressure_reservoir_psi", "double"),
    ("overbalance_psi", "double"), ("reservoir_temperature_c", "double"), ("completion_type", "string"),
    ("density_perforation_shots_m", "int"), ("active_damage", "string"), ("type_damage", "string"),
    ("damage_severity", "decimal(4,2)"), ("controllable", "string"),
]

CANONICAL = [name for name, _ in RECORD_FIELDS] + FURTHER_NAMES
CONTRACT_COLUMNS = [name for name, _ in CONTRACT]


def record_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in RECORD_FIELDS))


def contract_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {t} NOT NULL" for n, t in CONTRACT))


def canonical_name(name: str) -> str:
    """The canonical form of a column name; a name of no known vocabulary is only lower-cased."""
    plain = name.strip().lower()
    if plain in SYNONYMS:
        return SYNONYMS[plain]
    if plain in CANONICAL:
        return plain
    for ending in UNIT_ENDINGS:
        if plain.endswith("_" + ending) and plain[: -len(ending) - 1] in CANONICAL:
            return plain[: -len(ending) - 1]
    return plain


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename all columns to the canonical vocabulary."""
    names = [canonical_name(c) for c in df.columns]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"several columns mean the same: {sorted(twice)}")
    return df.toDF(*names)


def resolve(df: DataFrame) -> dict[str, str]:
    """Canonical name to the column of ``df`` that holds it."""
    return {canonical_name(c): c for c in reversed(df.columns)}


def rename_columns(df: DataFrame, names: Mapping[str, str] = PERCENT_RENAMES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def yes_no(column: str | Column) -> Column:
    """'Yes' and 'No' as booleans; any other text is unknown."""
    text = F.col(column) if isinstance(column, str) else column
    return F.when(text == "Yes", True).when(text == "No", False)


def nonzero(column: str | Column) -> Column:
    number = F.col(column) if isinstance(column, str) else column
    return number != 0


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order and type; others are left out, a value that does not fit is null."""
    present = {c.lower(): c for c in df.columns}
    chosen = []
    for field in schema:
        if field.name.lower() not in present:
            raise ValueError(f"missing column {field.name}")
        value = F.col(f"`{present[field.name.lower()]}`")
        chosen.append(value.try_cast(field.dataType).alias(field.name))
    return df.select(*chosen)


def for_database(df: DataFrame) -> DataFrame:
    """A stored well file in the shape of the target table."""
    named = normalise_names(rename_columns(df))
    typed = named.drop("record_id")
    if "fractures_presence" in typed.columns and not isinstance(typed.schema["fractures_presence"].dataType, T.BooleanType):
        typed = typed.withColumn("fractures_presence", nonzero("fractures_presence"))
    return enforce_schema(typed, contract_schema())
