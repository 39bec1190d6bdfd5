"""Shared inputs of the registered queries and the matching oracle SQL fragments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.operators.blocks import index_bars, index_bars_with_vwap
from tickloom.session import materialise, shared_folder
from tickloom.sources.bars import bars_from_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def rolled_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type, straight from the events."""
    return bars_from_events(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


def rolled_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority, straight from the orders."""
    return bars_from_events(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice",
        "o_orderkey", unit="day",
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hourly bars with position and VWAP: several passes read them."""
    return materialise(index_bars_with_vwap(rolled_hourly(spark, sf_dir)))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored minute bars with position and VWAP, for the queries that cut series into small blocks."""
    events = table(spark, sf_dir, "events")
    return materialise(index_bars_with_vwap(bars_from_events(events, "event_type", "ts", "value", "event_id", unit="minute")))


def by_minute(sql: str) -> str:
    """An oracle over hourly bars, over minute bars instead."""
    return sql.replace("date_trunc('hour', ts) AS ts", "date_trunc('minute', ts) AS ts")


#: Blocks far smaller than a series, with a warm-up that alone would not reach the right state.
SMALL_BLOCKS = {"size": 150, "warmup": 60}


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored daily bars with their position."""
    return materialise(index_bars(rolled_daily(spark, sf_dir), "year"))


def r6(x: Column | str, places: int = 6) -> Column:
    """Round, and turn -0.0 into 0.0."""
    return F.round(F.col(x) if isinstance(x, str) else x, places) + F.lit(0.0)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        r6(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


HOURLY = """bars AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, count(value)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

DAILY = """bars AS (
  SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close,
         count(o_totalprice)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""

INDEXED = """idx AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx,
         count(*) OVER (PARTITION BY series_id) AS n_bars, hour(ts) AS hr, ts::DATE AS day
  FROM bars)"""


def bars_sql(kind: str = HOURLY) -> str:
    return f"{kind},\n{INDEXED}"


def roll(how: str, x: str, n: int) -> str:
    """Rolling aggregate that needs all ``n`` values; uses the named window ``w``."""
    frame = f"(PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {how}({x}) OVER {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY series_id ORDER BY bar_idx)"


def rnd(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


# same closed form as functions.columns.two_sided_p
def p_value_sql(t: str) -> str:
    from tickloom.functions.columns import ERFC_COEFFICIENTS as c

    z = f"(abs({t}) / sqrt(2.0))"
    u = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = repr(c[-1])
    for k in reversed(c[:-1]):
        poly = f"({k!r} + {u} * {poly})"
    return f"({u} * exp(-{z} * {z} + {poly}))"
