"""Text, time and JSON expressions for telemetry records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_text(column: str, value: str) -> Column:
    return F.lower(F.trim(F.col(column))) == value.lower()


def joined_list(column: str | Column) -> Column:
    return F.array_join(column, ", ")


def whole_days_between(start: Column, end: Column) -> Column:
    """Complete days from ``start`` to ``end``, rounded towards minus infinity."""
    return F.floor((epoch_seconds(end) - epoch_seconds(start)) / 86400).cast("long")


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return moment + F.make_interval(secs=seconds)


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 by wall clock; the same for both timestamp types, never decreasing in the clock."""
    day = F.unix_date(F.to_date(moment)).cast("double") * 86400
    return day + F.hour(moment) * 3600 + F.minute(moment) * 60 + F.extract(F.lit("SECOND"), moment).cast("double")


def iso_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def day_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd")


# The printed record, one line per entry.
CARD_LINES = [
    ("Record ID: %s | Phase: %s", ["record_id", "phase_operation"]),
    ("DateTime: %s", ["datetime"]),
    ("Location: (%.4f, %.4f) | Formation: %s", ["lat", "long", "formation_type"]),
    ("Temp: %.2f | Pressure: %.2f psi", ["reservoir_temperature", "pressure_reservoir"]),
    ("Mud Type: %s | pH: %.2f | Viscosity: %.2f", ["mud_type", "mud_ph", "viscosity"]),
    ("Clay: %s | Content: %.2f %%", ["clay_mineralogy_type", "clay_content_percent"]),
]


def record_card() -> Column:
    """The essential fields of a record as six lines of text; a missing field prints ``null``."""
    lines = [F.format_string(layout, *[F.col(c) for c in fields]) for layout, fields in CARD_LINES]
    return F.concat_ws("\n", *lines)
