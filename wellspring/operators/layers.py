"""Formation attributes, layer lookup by depth and the completion of a well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import holds, lookup
from wellspring.operators.keyed import attach_by_key, fits_broadcast, null_safe_join
from wellspring.session import settle

LAYERS_PER_BUCKET = 16
FEW_LAYERS = 64

# Attributes of the known formations; a missing entry has no value of its own.
FORMATIONS = {
    "Topsoil": {"density": 1.5, "base_rop": 65.0, "wob_factor": 0.5, "porosity": 40.0, "fracture_grad": 0.6,
                "temp_grad": 0.01, "min_mud_weight": 8.5, "max_mud_weight": 10.0, "pressure_grad": 0.433},
    "Sandstone": {"density": 2.3, "base_rop": 20.0, "wob_factor": 1.0, "porosity": 22.0, "fracture_grad": 0.7,
                  "temp_grad": 0.026, "min_mud_weight": 8.5, "max_mud_weight": 12.5, "pressure_grad": 0.433},
    "Shale": {"density": 2.4, "base_rop": 12.0, "wob_factor": 1.2, "porosity": 10.0, "fracture_grad": 0.75,
              "temp_grad": 0.025, "min_mud_weight": 9.5, "max_mud_weight": 14.0, "pressure_grad": 0.465},
    "Weathered_Rock": {"density": 1.8, "base_rop": 45.0, "wob_factor": 0.85, "porosity": 30.0, "fracture_grad": 0.65,
                       "temp_grad": 0.015, "min_mud_weight": 8.5, "max_mud_weight": 11.0, "pressure_grad": 0.433},
    "Limestone": {"density": 2.7, "base_rop": 15.0, "wob_factor": 1.5, "porosity": 15.0, "fracture_grad": 0.8,
                  "temp_grad": 0.028, "min_mud_weight": 9.0, "max_mud_weight": 13.0, "pressure_grad": 0.445},
    "Shale_Seal": {"density": 2.4, "base_rop": 8.0, "wob_factor": 1.5, "porosity": 5.0, "fracture_grad": 0.78,
                   "temp_grad": 0.025, "min_mud_weight": 10.0, "max_mud_weight": 14.0, "pressure_grad": 0.470},
    "Salt": {"density": 2.2, "base_rop": 8.0, "wob_factor": 1.5, "porosity": 3.0, "fracture_grad": 0.85,
             "temp_grad": 0.02},
    "Tight_Carbonate": {"density": 2.6, "base_rop": 10.0, "wob_factor": 1.3, "porosity": 5.0, "fracture_grad": 0.8,
                        "temp_grad": 0.028, "min_mud_weight": 9.0, "max_mud_weight": 13.0, "pressure_grad": 0.445},
}
SEALS = ["Shale_Seal", "Salt", "Tight_Carbonate"]
FORMATION_ADDITIVES = {"Sandstone": ["Lubricants"], "Shale": ["KCl", "PHPA"]}
PREFERRED_MUD = {"Sandstone": "Water-based", "Shale": "Inhibitive Water-based"}


def formation_attribute(formation: Column, attribute: str, default: float | None = None) -> Column:
    values = {name: row[attribute] for name, row in FORMATIONS.items() if attribute in row}
    return lookup(formation, values, default)


def formation_additives(formation: Column) -> Column:
    chain = F
    for name, items in FORMATION_ADDITIVES.items():
        chain = chain.when(formation == name, F.array(*[F.lit(i) for i in items]))
    return chain.otherwise(F.array().cast("array<string>"))


def layer_lookup(rows: DataFrame, layers: DataFrame, well: str = "well_id", depth: str = "depth",
                 horizontal: str | None = None, few_layers: int = FEW_LAYERS) -> DataFrame:
    """Add the columns of the layer with top <= depth < bottom in the row's well.

    Below the last bottom the last layer counts. A row marked ``horizontal`` takes the topmost layer
    marked ``reservoir``, if the well has one. ``layers`` has ``well``, ``top``, ``bottom`` and any
    further columns; a row above all layers keeps nulls.

    A small layer table with few layers per well is broadcast. Otherwise the depths of each well are cut
    into buckets of its own, as many as its layers ask for, so the join has (well, bucket) as equal keys and
    looks at the few layers of one bucket, however deep or finely layered another well is.
    """
    layers = settle(layers)
    reservoir_top = F.min(F.when(holds(F.col("reservoir")), F.col("top"))) if "reservoir" in layers.columns else F.lit(None)
    wells = settle(layers.groupBy(well).agg(
        F.max_by("top", F.struct("bottom", "top")).alias("_last_top"),
        F.max("bottom").alias("_last_bottom"), F.min("top").alias("_first_top"),
        reservoir_top.cast("double").alias("_reservoir_top"), F.count(F.lit(1)).alias("_layers"),
    ))
    most = wells.agg(F.max("_layers")).first()[0]
    known = attach_by_key(rows, wells, [well], salt_by=[depth])
    searched = F.when(F.col(depth) >= F.col("_last_bottom"), F.col("_last_top")).otherwise(F.col(depth))
    if horizontal is not None:
        searched = F.when(holds(F.col(horizontal)) & F.col("_reservoir_top").isNotNull(), F.col("_reservoir_top")).otherwise(searched)
    known = known.withColumn("_searched", searched)
    inside = (F.col("_searched") >= F.col("top")) & (F.col("_searched") < F.col("bottom"))
    if (most or 0) <= few_layers and fits_broadcast(layers):
        found = null_safe_join(known, F.broadcast(layers), [well], "left", inside)
    else:
        thick = layers.where(F.col("bottom") > F.col("top"))
        placed = attach_by_key(thick, wells.select(well, "_first_top", "_last_bottom", "_layers"), [well], weight="_layers", salt_by=["top"])
        bucketed = placed.withColumn("_bucket", F.explode(F.sequence(_bucket("top"), _bucket("bottom")))).drop("_first_top", "_last_bottom", "_layers")
        found = attach_by_key(known.withColumn("_bucket", _bucket("_searched")), settle(bucketed), [well, "_bucket"], also=inside, salt_by=[depth])
    return found.drop("_last_top", "_last_bottom", "_first_top", "_layers", "_reservoir_top", "_searched", "_bucket")


def _bucket(depth: str) -> Column:
    """The bucket of a depth among those of its well, between its first top and last bottom."""
    parts = F.ceil(F.col("_layers") / LAYERS_PER_BUCKET)
    share = (F.col(depth) - F.col("_first_top")) / F.nullif(F.col("_last_bottom") - F.col("_first_top"), F.lit(0.0))
    return F.floor(share * parts).cast("long")


def completion_by_well(layers: DataFrame, well: str = "well_id") -> DataFrame:
    """Completion type and perforation density per well from its reservoir depth and whether it has shale."""
    top, shale = F.col("reservoir_top"), F.col("has_shale")
    return (
        layers.groupBy(well)
        .agg(
            F.min(F.when(holds(F.col("reservoir")), F.col("top"))).alias("reservoir_top"),
            F.bool_or(holds(F.col("formation") == "Shale")).alias("has_shale"),
        )
        .withColumn(
            "completion_type",
            F.when(top.isNull(), "Open Hole").when(shale & (top > 500), "Liner").when(shale, "Cased")
            .when(top > 800, "Liner").otherwise("Open Hole"),
        )
        .withColumn("density_perforation", lookup(F.col("completion_type"), {"Liner": 20, "Cased": 30, "Open Hole": 10}))
    )
