"""Table and stream sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wellspring.functions.nulls import holds
from wellspring.session import settle

TARGET_TABLE = "well_records"
CSV_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def write_split(df: DataFrame, flag: str, clean_path: str, flagged_path: str, partition_by: Sequence[str] = (),
                mode: str = "errorifexists", settled: bool = False) -> None:
    """Rows without and with the flag into two folders; the flag is computed once, or not again if ``settled``."""
    fixed = df if settled else settle(df)
    mask = holds(F.col(flag))
    write_parquet(fixed.where(~mask).drop(flag), clean_path, partition_by, mode)
    write_parquet(fixed.where(mask).drop(flag), flagged_path, partition_by, mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV parts with a header; times keep their microseconds, which Spark's own format cuts to milliseconds."""
    df.write.mode(mode).options(**CSV_TIMES).csv(path, header=True)


def write_summary_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A summary of one row per well as a single CSV part with a header; the work before it keeps its tasks."""
    write_csv(df.repartition(1), path, mode)


def write_report_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def jdbc_options(url: str, user: str, password: str, table: str = TARGET_TABLE, batch_size: int = 100) -> dict[str, str]:
    return {
        "url": url, "dbtable": table, "user": user, "password": password, "batchsize": str(batch_size),
        "reWriteBatchedInserts": "true",
    }


def append_jdbc(df: DataFrame, url: str, user: str, password: str, table: str = TARGET_TABLE, batch_size: int = 100,
                connections: int = 16) -> None:
    """Append to a database table in batches, over at most ``connections`` connections."""
    df.repartition(connections).write.format("jdbc").options(
        **jdbc_options(url, user, password, table, batch_size)).mode("append").save()


def kafka_sink(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """A writer for key and value columns; needs the Kafka package of Spark on the class path."""
    return (
        stream.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
