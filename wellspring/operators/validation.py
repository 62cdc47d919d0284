"""Structure and range checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.nulls import has_column, holds, number
from wellspring.functions.text import same_text

# Columns a processing run needs, with the kind of value in each.
REQUIRED = {"Temperature_C": "number", "Pressure_psi": "number", "Formation": "text"}
KINDS = {"number": T.NumericType, "text": T.StringType}

# Plausible ranges.
RANGES = {"Temperature_C": (0.0, 400.0), "Pressure_psi": (0.0, 30000.0), "pH": (0.0, 14.0)}

# Features whose absence makes a row useless for modelling.
IMPORTANT_FEATURES = [
    "Clay_Content_Percent_%", "Formation_Permeability_mD", "Porosity_Formation_%", "Weight_on_Bit_kg", "ROP_m_hr",
    "RPM_rev_min", "Torque_Nm", "Mud_Weight_In_ppg", "Mud_Temperature_In_C", "Pressure_Standpipe_psi",
    "Pressure_Annulus_psi",
]
SUSPICIOUS_ADVICE = "Acid in an open hole through shale: check whether this fluid is meant."


class InvalidData(ValueError):
    pass


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if not has_column(df, c)]


def _type_of(df: DataFrame, column: str) -> T.DataType:
    return df.select(column).schema[0].dataType


def validate_structure(df: DataFrame, required: Mapping[str, str] = REQUIRED) -> tuple[bool, str]:
    """(ok, message): first the columns that are missing, else all columns of the wrong kind."""
    gone = missing_columns(df, list(required))
    if gone:
        return False, f"columns not found: {', '.join(gone)}"
    wrong = [
        f"{c}: {kind} expected, {_type_of(df, c).simpleString()} given"
        for c, kind in required.items() if not isinstance(_type_of(df, c), KINDS[kind])
    ]
    return (False, "columns of another kind\n" + "\n".join(wrong)) if wrong else (True, "structure is valid")


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise InvalidData(f"the {what} has no rows")
    return df


def required_columns_report(df: DataFrame, required: Mapping[str, str] = REQUIRED) -> DataFrame:
    """One row per required column: whether it is there, its type and whether the kind fits."""
    rows = []
    for c, kind in required.items():
        found = _type_of(df, c) if has_column(df, c) else None
        rows.append((c, kind, found is not None, found.simpleString() if found is not None else None,
                     found is not None and isinstance(found, KINDS[kind])))
    return df.sparkSession.createDataFrame(
        rows, "column string, expected string, present boolean, found string, fits boolean")


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Per column: values below and above the range, NaN is neither; absent columns are left out."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.count_if(number(F.col(c)) < low).alias("below_min"),
                 F.count_if(number(F.col(c)) > high).alias("above_max"))
        for c, (low, high) in ranges.items() if has_column(df, c)
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, below_min bigint, above_max bigint")
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def suspicious_triple(fluid: str = "Fluid_Type", formation: str = "Formation_Type",
                      completion: str = "Completion_Type") -> Column:
    """Acid in an open hole in shale, whatever the case of the letters."""
    return holds(same_text(fluid, "acidic") & same_text(formation, "shale") & same_text(completion, "open hole"))


def suspicious_summary(df: DataFrame, fluid: str = "Fluid_Type", formation: str = "Formation_Type",
                       completion: str = "Completion_Type") -> DataFrame:
    n = F.count_if(suspicious_triple(fluid, formation, completion))
    return df.agg(
        n.alias("suspicious_combinations_count"),
        F.bround(F.try_divide(n, F.count(F.lit(1))) * 100, 2).alias("suspicious_percentage"),
        F.lit(SUSPICIOUS_ADVICE).alias("recommendation"),
    )


def drop_incomplete(df: DataFrame, subset: Sequence[str] = IMPORTANT_FEATURES) -> DataFrame:
    """Rows with a value in each of the given columns."""
    for c in subset:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df


def split_known(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(f"`{target}`").isNotNull()), df.where(F.col(f"`{target}`").isNull())


def label_feature_split(df: DataFrame, label: str, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, label)."""
    return df.drop(label, *drop), df.select(label)
