"""Incremental bar ingest as a stream: each micro-batch is merged into the stored bars.

The batch merge (``append_bars``) keeps the last write per (series, time) and
rewrites only the touched months, so a replayed batch leaves the table unchanged.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.bars import BAR_COLUMNS, append_bars, merge_latest, write_bars

BAR_SCHEMA = "series_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def landing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of bars as they arrive in a folder."""
    return spark.readStream.schema(BAR_SCHEMA).parquet(path).select(*BAR_COLUMNS)


def has_bars(spark: SparkSession, path: str) -> bool:
    """Whether the store holds any row yet; a missing or an empty folder does not."""
    try:
        return not spark.read.schema(BAR_SCHEMA).parquet(path).select("ts").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def merge_batch(spark: SparkSession, batch: DataFrame, path: str) -> None:
    if has_bars(spark, path):
        append_bars(spark, batch, path)
    else:
        write_bars(merge_latest([batch]), path)


def start_merge(stream: DataFrame, path: str, progress: str, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Run the merge; ``progress`` is the stream's checkpoint folder on shared storage."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: merge_batch(batch.sparkSession, batch, path))
    writer = writer.option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
