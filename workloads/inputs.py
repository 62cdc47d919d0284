"""Drilling tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.sources.readers import read_file_stream


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(number: Column, *texts: str) -> Column:
    """The text at position ``number``."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (number + 1).cast("int"))


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """One telemetry row per line item; all readings follow from its numbers."""
    return telemetry_of(table(spark, folder, "lineitem"))


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files. The pattern covers a single file as well as a folder of parts."""
    return read_file_stream(spark, f"{folder}/{name}.parquet*", table(spark, folder, name).schema)


def telemetry_of(li: DataFrame) -> DataFrame:
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    q, price, discount, tax = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    formation = pick(p % 4, "Shale", "Limestone", "Sandstone", "Salt")
    number = lambda c: c.cast("double")
    return li.select(
        o.alias("order_id"), p.alias("part_id"), n.alias("line_id"), s.alias("well_id"),
        F.col("l_shipdate").alias("datetime"),
        (o % 300).alias("days_age_well"),
        pick(F.floor(o % 300 / 100), "Drilling", "Completion", "Production").alias("phase_operation"),
        formation.alias("formation_type"),
        pick(o % 3, "Kaolinite", "Illite", "Montmorillonite").alias("clay_mineralogy_type"),
        pick((o + n) % 3, "Water-based", "Oil-based", "Synthetic").alias("mud_type"),
        pick(p % 3, "Cased", "Open Hole", "Liner").alias("completion_type"),
        pick(n % 3, "Acidic", "BASIC", "acidic").alias("fluid_type"),
        (o % 2).cast("int").alias("fractures_presence"),
        (F.lit(50.0) + q * 1.8).alias("reservoir_temperature"),
        number(p % 150).alias("formation_permeability"),
        number(p % 63 + 5).alias("clay_content_percent"),
        number(o % 30).alias("density_perforation"),
        (price / 25.0).alias("depth_measured"),
        (price / 25.0 + 2.0 - discount * 50.0).alias("depth_bit"),
        number(p % 70 * 100).alias("weight_on_bit"),
        (discount * 400.0).alias("rop"),
        (q * 1.6).alias("viscosity"),
        number(n + 4).alias("mud_ph"),
        (F.lit(7.0) + tax * 50.0).alias("mud_weight_in"),
        number(p % 100 + 80).alias("in_rate_flow_mud"),
        number(o % 1000 + 2500).alias("pressure_standpipe"),
        number(p % 800 + 2300).alias("pressure_annulus"),
        number(o % 4000 + 2000).alias("pressure_reservoir"),
        number(o % 700).alias("overbalance"),
        (number(o % 45) / 10.0).alias("fluid_loss_api"),
        number(p % 1500).alias("chloride_content"),
        (number(n) * 2.5).alias("solid_content"),
        number(p % 30 + 5).alias("porosity_formation"),
        (n == 7).alias("is_horizontal"),
        ((p % 4 == 3) & (o % 2 == 0)).alias("is_seal"),
        ((p % 4).isin(1, 2) & (o % 5 == 0)).alias("is_reservoir"),
        number(s % 20 * 100 + 3000).alias("total_depth"),
    )


def with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with missing cells; the price has NaN in some of them."""
    li = table(spark, folder, "lineitem")
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    price = F.when((o + p * 3) % 25 == 0, F.lit(float("nan"))).when((o + p * 3) % 25 != 1, F.col("l_extendedprice"))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when((o * 7 + p) % 20 != 0, F.col("l_quantity")).alias("l_quantity"),
        price.alias("l_extendedprice"),
        F.when((o * 5 + n) % 30 != 0, F.col("l_discount")).alias("l_discount"),
        F.when((o + n) % 40 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        F.col("l_linestatus"),
    )


def well_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Eight layers for each supplier, taken as a well."""
    s, i = F.col("s_suppkey"), F.col("layer_id")
    shift = s % 7 * 10
    return (
        table(spark, folder, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("layer_id"))
        .select(
            s.alias("well_id"), i,
            (F.when(i == 0, 0).otherwise(i * 450 + shift)).cast("double").alias("top"),
            ((i + 1) * 450 + shift).cast("double").alias("bottom"),
            pick((i + s % 3) % 8, "Topsoil", "Weathered_Rock", "Sandstone", "Shale", "Limestone", "Shale", "Salt",
                 "Sandstone").alias("formation"),
            (((i == 7) & (s % 4 != 0)) | ((i == 4) & (s % 5 == 0))).alias("reservoir"),
        )
    )


def event_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rows of a well (the user) in time order, each in a formation given by its type."""
    return event_steps_of(table(spark, folder, "events"))


def event_steps_of(events: DataFrame) -> DataFrame:
    formation = F.create_map(*[F.lit(x) for pair in (
        ("view", "Shale"), ("click", "Sandstone"), ("error", "Limestone"), ("signup", "Topsoil"), ("purchase", "Salt"),
    ) for x in pair])
    return events.withColumn("formation", formation[F.col("event_type")])
