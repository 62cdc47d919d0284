"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above 8000 bytes, and the wide rule and physics expressions make such
# methods. Below this limit Spark generates a method per expression instead, which is several times faster.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
METHOD_LIMIT_BYTES = "8000"
METHOD_LIMIT_DEFAULT = "65535"


def build_session(app_name: str = "wellspring", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators expect.

    Adaptive execution coalesces shuffle partitions, splits skewed join partitions and switches to a
    broadcast join when a side turns out small at run time. Without it the operators still work.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT: METHOD_LIMIT_BYTES,
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def tune_session(spark: SparkSession) -> None:
    """Lower the method limit of a session made elsewhere, unless its owner has changed it."""
    if spark.conf.get(METHOD_LIMIT) == METHOD_LIMIT_DEFAULT:
        spark.conf.set(METHOD_LIMIT, METHOD_LIMIT_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    On a cluster it must come from ``spark.checkpoint.dir``, since every executor has to see
    it. A machine-local folder is made only for a local master where none is set.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wellspring-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/wellspring/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it from there.

    The lineage ends at files that outlive any executor. Later passes read only the columns they need,
    and the optimizer knows the size of the table.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input comes in fewer files than there are cores; else unchanged.

    For steps whose work per row outweighs moving the row. The number of input files stands for that of
    the partitions, as it is known without running anything; tables of many files stay put.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # the names stay in the JVM, only their number is wanted
    return df.repartition(cores) if 0 < files < cores else df
