"""Encoding, decoding, alerts and rates on a stream of records; all but the rates keep no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wellspring.functions.text import record_card
from wellspring.operators.combination_rules import combination_flag, fired_rules
from wellspring.operators.damage import damage_type
from wellspring.session import scratch_path
from wellspring.vocabulary import record_schema


def encode_records(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Message key as text and all columns as one JSON text."""
    body = F.struct(*[F.col(c) for c in (columns or df.columns)])
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def decode_records(messages: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Message key, the fields of the JSON value, and whether the value could be read.

    ``schema`` must spell the fields as the messages do.
    """
    schema = schema or record_schema()
    readable = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    text = F.col("value").cast("string")
    parsed = F.from_json(text, readable, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # Through the explode a later filter on is_readable stays above it; else it would parse the text again.
    return (
        messages.select(F.col("key").cast("string").alias("key"), text.alias("raw_value"), F.explode(F.array(parsed)).alias("_r"))
        .select("key", "raw_value", *[F.col(f"_r.{f.name}").alias(f.name) for f in schema],
                (F.col("_r").isNotNull() & F.col("_r._broken").isNull()).alias("is_readable"))
    )


def readable_records(decoded: DataFrame) -> DataFrame:
    return decoded.where("is_readable").drop("raw_value", "is_readable")


def broken_records(decoded: DataFrame) -> DataFrame:
    return decoded.where("NOT is_readable").select("key", "raw_value")


def with_alerts(records: DataFrame, critical: Sequence[str] = ()) -> DataFrame:
    """Add the rules that fire, the damage type and ``is_alert``: any rule fires or the damage is a critical one."""
    flagged = fired_rules(records).withColumns({"combination_anomaly": combination_flag(records), "damage_type": damage_type()})
    severe = F.col("damage_type").isin(*critical) if critical else F.lit(False)
    return flagged.withColumn("is_alert", F.col("combination_anomaly") | severe)


def alerts(records: DataFrame, critical: Sequence[str] = ()) -> DataFrame:
    return with_alerts(records, critical).where("is_alert")


def alert_rate(flagged: DataFrame, well: str, moment: str, width: str = "10 minutes", lateness: str = "5 minutes",
               flag: str = "is_alert") -> DataFrame:
    """Records and alerts per well and time window; a stream does not wait for rows later than ``lateness``.

    Event time must be a TIMESTAMP in a stream, so a time without zone is read in the session's zone.
    """
    kind = flagged.schema[moment].dataType
    timed = flagged
    if flagged.isStreaming:
        timed = flagged.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, lateness)
    return (
        timed.groupBy(F.col(well), F.window(moment, width).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col(flag)).alias("n_alerts"))
        .select(well, F.col("_w.start").cast(kind).alias("window_start"), F.col("_w.end").cast(kind).alias("window_end"),
                "n_records", "n_alerts")
    )


def cards(records: DataFrame) -> DataFrame:
    return records.select("key", record_card().alias("card"))


def start_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; with the same checkpoint a later start goes on behind it."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def start_to_console(stream: DataFrame, checkpoint: str, rows: int = 2**31 - 1) -> StreamingQuery:
    """Print every record; ``rows`` limits those of a batch."""
    return (
        stream.writeStream.format("console").option("truncate", "false").option("numRows", rows)
        .option("checkpointLocation", checkpoint).start()
    )


def start_with_broken_branch(messages: DataFrame, schema: T.StructType, good_path: str, broken_path: str,
                             checkpoint: str) -> StreamingQuery:
    """Readable records to one folder, unreadable ones to another, in one pass over the source."""
    def write(batch: DataFrame, number: int) -> None:
        decoded = decode_records(batch, schema).persist()
        readable_records(decoded).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        broken_records(decoded).write.mode("overwrite").parquet(f"{broken_path}/batch={number}")
        decoded.unpersist()

    return (
        messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch changes of an aggregation, open groups included, into a folder of its own.

    Unlike append mode this does not wait until nothing earlier can come, so the groups that are open when the source
    ends are there as well. A batch that runs again after a failure replaces its folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last state of each group that ``start_latest`` has written: one row for each of the keys."""
    kept = [f.name for f in schema if f.name not in keys]
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    last = F.max_by(F.struct(*kept), F.col("batch"))
    return written.groupBy(*keys).agg(last.alias("_last")).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in schema.names])


def run_available(stream: DataFrame, label: str = "stream", mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, into a fresh scratch folder, and read the result."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = start_to_folder(stream, f"{path}/rows", f"{path}/checkpoint", mode)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
