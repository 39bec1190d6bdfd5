"""Session settings used by the bench and the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # no Python call site per column expression: large plans build much faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "tickloom", **extra: str) -> SparkSession:
    """Return a session with the engine's settings; a cluster supplies its own master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach: ``spark.checkpoint.dir``.

    Where that is unset a folder below the warehouse serves a local master (a test, a laptop); a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate").rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Intermediate tables of this application; ``clear_stored`` removes them."""
    return f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"


def store(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """``materialise``, and the folder that holds the table."""
    path = f"{run_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Store an intermediate table that several passes read, as Parquet in the shared folder.

    Later passes read only the columns and row groups they need, and a lost executor
    loses nothing.  ``partition_by`` splits the folder by those columns.
    """
    return store(df, *partition_by)[0]


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder on whatever file system it lies; whether there was one."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def clear_stored(spark: SparkSession) -> bool:
    """Remove all intermediate tables of this application; results that still read them must be stored before."""
    return remove_folder(spark, run_folder(spark))
