"""Bars from a stream of events: an event-time roll-up with a watermark that feeds the bar store.

Spark keeps the open bars as state and emits a bar again whenever late events change it; the store keeps the last
write of every bar.  A bar leaves the state once the watermark (the latest event time less ``delay``) has passed it, so the state
holds the bars of one delay, however long the stream runs.  Events that are later than the delay are dropped by the
watermark.  Replayed batches write the same bars again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.bars import BAR_COLUMNS
from tickloom.streaming.landing import start_merge

_WIDTH = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def rolled_bars(events: DataFrame, series: str | Column, ts: str, value: str, tie: str, unit: str = "hour", delay: str = "1 day") -> DataFrame:
    """Streaming counterpart of ``bars_from_events``: one row per bar and batch that changed it; use output mode "update"."""
    key = F.col(series) if isinstance(series, str) else series
    at, v = F.struct(F.col(ts), F.col(tie)), F.col(value).cast("double")
    # a watermark is kept on a zoned time, whose clock is the session's
    timed = events.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", delay)
    rolled = timed.groupBy(key.cast("string").alias("series_id"), F.window("_event", _WIDTH[unit]).alias("_bar")).agg(
        F.min_by(v, at).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, at).alias("close"),
        F.count(v).cast("double").alias("volume"))
    return rolled.withColumn("ts", F.col("_bar.start").cast("timestamp_ntz")).select(*BAR_COLUMNS)


def start_rollup(bars: DataFrame, path: str, progress: str, available_now: bool = True) -> StreamingQuery:
    """Merge every batch of changed bars into the store at ``path``."""
    return start_merge(bars, path, progress, available_now, mode="update")
