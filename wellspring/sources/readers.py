"""Table and stream sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.session import settle

SOURCE_FILE = "source_file"
FOOTER_TASKS_PER_CORE = 4


def read_parquet(spark: SparkSession, *paths: str, merge_schema: bool = False, with_file: bool = False,
                 skip_corrupt: bool = False) -> DataFrame:
    """One table over files and folders; ``with_file`` adds the name of the file each row is from."""
    reader = spark.read.option("mergeSchema", str(merge_schema).lower()).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    df = reader.parquet(*paths)
    return with_source_file(df) if with_file else df


def with_source_file(df: DataFrame, root: str | None = None) -> DataFrame:
    """Add the name of each row's file, or with ``root`` its path below that folder, which tells equal names apart."""
    name = F.col("_metadata.file_name")
    if root is not None:
        prefix = F.lit(df.sparkSession._jvm.org.apache.hadoop.fs.Path(root).toUri().getRawPath().rstrip("/") + "/")
        path = F.col("_metadata.file_path")
        start = F.instr(path, prefix)
        name = F.when(start > 0, F.substring(path, start + F.length(prefix), F.length(path))).otherwise(name)
    return df.withColumn(SOURCE_FILE, name)


def nanoseconds_to_timestamp(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns read as whole nanoseconds (``spark.sql.legacy.parquet.nanosAsLong``) as timestamps."""
    return df.withColumns({
        c: F.timestamp_micros(F.floor(F.col(c) / 1000).cast("long")).cast("timestamp_ntz")
        for c in columns if isinstance(df.schema[c].dataType, T.LongType)
    })


def read_nano_parquet(spark: SparkSession, *paths: str, moments: Sequence[str] = ("DateTime",)) -> DataFrame:
    """Parquet files whose timestamps have nanoseconds, which Spark does not read as they are."""
    setting = "spark.sql.legacy.parquet.nanosAsLong"
    earlier = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        raw = spark.read.parquet(*paths)
    finally:
        spark.conf.set(setting, earlier)
    return nanoseconds_to_timestamp(raw, [c for c in moments if c in raw.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def file_manifest(spark: SparkSession, folder: str, required: Sequence[str] = (), pattern: str = "*.parquet") -> DataFrame:
    """One row per file of a folder and the folders in it: path, number of rows and why it cannot be used, else null.

    The footers are read inside tasks. A footer that cannot be read or lacks one of the ``required`` columns is a
    reason; files without rows are usable. Only files whose names match ``pattern`` are listed.
    """
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
        .select("path")
    )
    needed = list(required)

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *_footer(path, needed)) for path in batch["path"]]
            found = pd.DataFrame(rows, columns=["file", "n_rows", "reason"])
            yield found.astype({"n_rows": "Int64"})

    parts = spark.sparkContext.defaultParallelism * FOOTER_TASKS_PER_CORE
    return listed.repartition(parts, "path").mapInPandas(footers, "file string, n_rows bigint, reason string")


def _footer(path: str, required: Sequence[str]) -> tuple[int | None, str | None]:
    try:
        if path.startswith("file:"):
            system, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            system, place = fs.FileSystem.from_uri(path)
        with system.open_input_file(place) as file:
            footer = pq.read_metadata(file)
    except Exception as problem:  # an unreadable file must not stop the others
        return None, f"unreadable: {type(problem).__name__}"
    names = {n.lower() for n in footer.schema.to_arrow_schema().names}
    gone = [c for c in required if c.lower() not in names]
    return footer.num_rows, f"missing columns: {', '.join(gone)}" if gone else None


def check_files(spark: SparkSession, folder: str, required: Sequence[str] = (),
                pattern: str = "*.parquet") -> tuple[list[str], DataFrame]:
    """Paths of the files that can be used, and a table of the others with the reason.

    The paths come to the driver, as a read of chosen files needs them there.
    """
    manifest = settle(file_manifest(spark, folder, required, pattern))
    usable = sorted(r["file"] for r in manifest.where("reason IS NULL").select("file").collect())
    return usable, manifest.where("reason IS NOT NULL").select("file", "reason")


def read_usable(spark: SparkSession, folder: str, required: Sequence[str] = (),
                pattern: str = "*.parquet") -> tuple[DataFrame | None, DataFrame]:
    """The rows of all files that can be used, each with its file below the folder, and the skipped files with the reason.

    The rows are None where no file can be used. Files may have different columns.
    """
    usable, skipped = check_files(spark, folder, required, pattern)
    if not usable:
        return None, skipped
    return with_source_file(read_parquet(spark, *usable, merge_schema=True), folder), skipped


def kafka_options(servers: str, topic: str, group: str | None = None, starting: str = "earliest") -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    return options


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, group: str | None = None,
                      starting: str = "earliest") -> DataFrame:
    """Key and value of each message; needs the Kafka package of Spark on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, group, starting)).load()


def read_file_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet",
                     files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)
