"""Registered queries: bar building, merging and plain bar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import hour_between
from tickloom.functions.indicators import with_basics, with_forward_returns
from tickloom.operators.blocks import index_bars, own_rows, to_blocks
from tickloom.operators.splits import quantile_cut, position_cut
from tickloom.plans.common import (
    DAILY, HOURLY, bars_sql, hourly_bars, lag, r6, rnd, rolled_daily, rolled_hourly, table,
    work_folder,
)
from tickloom.sources.bars import (
    BAR_COLUMNS, append_bars, high_water_marks, merge_latest, narrow, read_bars, unseen, write_bars,
)
from tickloom.streaming.landing import landing_stream, start_merge
from tickloom.streaming.rollup import rolled_bars, start_rollup


def event_bars(spark, sf):
    return rolled_hourly(spark, sf)


def order_bars(spark, sf):
    return rolled_daily(spark, sf)


def bar_basics(spark, sf):
    b = own_rows(with_basics(to_blocks(index_bars(hourly_bars(spark, sf)), back=1)))
    cols = ["ret", "true_range", "bar_range", "range_pct", "body", "upper_wick", "lower_wick", "body_pct", "tp"]
    return b.select("series_id", "ts", "bar_idx", *[r6(c).alias(c) for c in cols])


def forward_returns(spark, sf):
    b = own_rows(with_forward_returns(to_blocks(index_bars(hourly_bars(spark, sf)), ahead=24)))
    return b.filter(hour_between("ts", 12, 20)).select(
        "series_id", "ts", "bar_idx", *[r6(f"fwd{h}").alias(f"fwd{h}") for h in (4, 8, 24)]
    )


def sample_splits(spark, sf):
    b = position_cut(quantile_cut(index_bars(hourly_bars(spark, sf)), 0.6), 0.6, "is_pos")
    return b.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_sample").cast("int")).alias("n_quantile_cut"),
        F.sum(F.col("is_pos").cast("int")).alias("n_position_cut"),
        F.max(F.when(F.col("is_sample"), F.col("ts"))).alias("last_in_sample"),
    )


def _halves(spark, sf):
    """Two overlapping batches of the same bars: the later one is scaled and starts on day 10."""
    bars = rolled_hourly(spark, sf)
    stored = bars.filter(F.dayofmonth("ts") <= 20)
    landing = bars.filter(F.dayofmonth("ts") >= 10).withColumn("close", F.col("close") * 2)
    return stored, landing


def incremental_merge(spark, sf):
    return merge_latest(list(_halves(spark, sf)))


def landing_after_mark(spark, sf):
    stored, landing = _halves(spark, sf)
    return unseen(landing, stored)


def stored_marks(spark, sf):
    return high_water_marks(_halves(spark, sf)[0])


def _six_places(b):
    return b.select("series_id", "ts", *[
        F.round(F.col(c).cast("double"), 6).alias(c) for c in ("open", "high", "low", "close", "volume")
    ])


def narrow_bars(spark, sf):
    return _six_places(narrow(rolled_hourly(spark, sf)))


def bar_store(spark, sf):
    """Bars written by month, a later batch merged into the stored files, and the store read back."""
    first, later = _halves(spark, sf)
    path = work_folder(spark)
    write_bars(first, path)
    append_bars(spark, later, path)
    return _six_places(read_bars(spark, path))


def landing_merge(spark, sf):
    """The same two batches through the stream of landing files."""
    path = work_folder(spark)
    for batch in _halves(spark, sf):
        batch.select(*BAR_COLUMNS).write.mode("append").parquet(f"{path}/landing")
        start_merge(landing_stream(spark, f"{path}/landing"), f"{path}/bars", f"{path}/progress").awaitTermination()
    return _six_places(read_bars(spark, f"{path}/bars"))



def streamed_bars(spark, sf):
    """Bars rolled up from a stream of three event files, of which the later ones bring late events for all bars."""
    path = work_folder(spark)
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{path}/events")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
    bars = rolled_bars(arriving, "event_type", "ts", "value", "event_id", delay="60 days")
    start_rollup(bars, f"{path}/bars", f"{path}/progress").awaitTermination()
    return _six_places(read_bars(spark, f"{path}/bars"))


_COLS = "series_id, ts, open, high, low, close, volume"
_BASIC = f"""WITH {bars_sql()}, pre AS (SELECT *, {lag('close')} AS pc FROM idx)
SELECT series_id, ts, bar_idx, {rnd('close / nullif(pc, 0) - 1')} AS ret,
  {rnd('greatest(high - low, abs(high - pc), abs(low - pc))')} AS true_range,
  {rnd('high - low')} AS bar_range, {rnd('(high - low) / nullif(close, 0) * 100')} AS range_pct,
  {rnd('abs(close - open)')} AS body, {rnd('high - greatest(open, close)')} AS upper_wick,
  {rnd('least(open, close) - low')} AS lower_wick,
  {rnd('abs(close - open) / (high - low + 1e-10) * 100')} AS body_pct,
  {rnd('(high + low + close) / 3')} AS tp
FROM pre"""
_FWD = ", ".join(
    f"{rnd(f'lead(close, {h}) OVER (PARTITION BY series_id ORDER BY bar_idx) / nullif(close, 0) - 1')} AS fwd{h}"
    for h in (4, 8, 24)
)
_MERGED = f"""WITH {HOURLY}, u AS (
  SELECT *, 0 AS batch FROM bars WHERE day(ts) <= 20
  UNION ALL SELECT series_id, ts, open, high, low, close * 2, volume, 1 FROM bars WHERE day(ts) >= 10)"""

_STORE_SQL = f"""{_MERGED}
SELECT series_id, ts, {', '.join(f'round({c}::FLOAT::DOUBLE, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}
FROM u QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY batch DESC) = 1"""

QUERIES = {
    "event_bars": (event_bars, f"WITH {HOURLY} SELECT {_COLS} FROM bars"),
    "order_bars": (order_bars, f"WITH {DAILY} SELECT {_COLS} FROM bars"),
    "bar_basics": (bar_basics, _BASIC),
    "forward_returns": (forward_returns, f"""WITH {bars_sql()}
SELECT * EXCLUDE hr FROM (SELECT series_id, ts, bar_idx, hr, {_FWD} FROM idx) WHERE hr BETWEEN 12 AND 20"""),
    "sample_splits": (sample_splits, f"""WITH {bars_sql()},
q AS (SELECT series_id, quantile_cont(epoch_us(ts), 0.6) AS cut FROM idx GROUP BY 1)
SELECT series_id, count(*) AS n, sum((epoch_us(ts) <= cut)::INT) AS n_quantile_cut,
  sum((bar_idx <= floor(n_bars * 0.6))::INT) AS n_position_cut,
  max(ts) FILTER (WHERE epoch_us(ts) <= cut) AS last_in_sample
FROM idx JOIN q USING (series_id) GROUP BY 1"""),
    "incremental_merge": (incremental_merge, f"""{_MERGED}
SELECT {_COLS} FROM u QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY batch DESC) = 1"""),
    "landing_after_mark": (landing_after_mark, f"""{_MERGED}
SELECT {_COLS} FROM u WHERE batch = 1
  AND ts > (SELECT max(s.ts) FROM u s WHERE s.batch = 0 AND s.series_id = u.series_id)"""),
    "stored_marks": (stored_marks, f"""WITH {HOURLY}
SELECT series_id, max(ts) AS last_ts FROM bars WHERE day(ts) <= 20 GROUP BY 1"""),
    "bar_store": (bar_store, _STORE_SQL),
    "landing_stream": (landing_merge, _STORE_SQL),
    "streamed_bars": (streamed_bars, f"""WITH {HOURLY} SELECT series_id, ts, {', '.join(
        f'round({c}::FLOAT::DOUBLE, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars"""),
    "narrow_bars": (narrow_bars, f"""WITH {HOURLY} SELECT series_id, ts, {', '.join(
        f'round({c}::FLOAT::DOUBLE, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars"""),
}
