"""Registered queries: indicators and entry conditions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tickloom.functions.columns import no_zero, series_window, sma
from tickloom.functions.conditions import signal_rows
from tickloom.functions.indicators import LOOKBACK, with_basics, with_slope, with_window_indicators
from tickloom.functions.recursive import RECURSIVE, recursive_indicators
from tickloom.operators.blocks import index_bars, index_bars_with_vwap, own_rows, to_blocks
from tickloom.plans.common import (
    DAILY, SMALL_BLOCKS, bars_sql, by_minute, daily_bars, hourly_bars, lag, minute_bars, r6, rnd, roll, rounded,
)
from tickloom.plans.oracle_indicators import (
    CONDITION_SQL, PREPARED, RECURSIVE_WITH, WINDOWED, condition_input_sql,
)

WINDOW_COLUMNS = (
    "sma20", "std20", "bb_upper", "bb_lower", "bandwidth", "bandwidth_ma", "stoch_k", "stoch_d",
    "williams", "cci", "aroon_up", "aroon_down", "ulcer", "ulcer_ma", "volume_ma", "low20", "vwap",
)


def rolling_indicators(spark, sf):
    blocked = to_blocks(index_bars_with_vwap(hourly_bars(spark, sf)), back=LOOKBACK)
    return own_rows(with_window_indicators(blocked)).select(
        "series_id", "ts", "bar_idx", *[r6(c).alias(c) for c in WINDOW_COLUMNS]
    )


def recursive_columns(spark, sf):
    return rounded(recursive_indicators(index_bars(hourly_bars(spark, sf))))


def recursive_columns_blocks(spark, sf):
    """Recursive indicators of minute bars cut into small blocks."""
    return rounded(recursive_indicators(minute_bars(spark, sf), **SMALL_BLOCKS))


def entry_conditions(spark, sf):
    return signal_rows(hourly_bars(spark, sf))


def condition_counts(spark, sf):
    return signal_rows(hourly_bars(spark, sf)).groupBy("series_id", "family", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx")
    )


def rolling_slope(spark, sf):
    """Slope of the cumulative return over 100 daily bars."""
    blocked = to_blocks(index_bars(daily_bars(spark, sf), "year"), back=LOOKBACK)
    w = series_window()
    # a running sum local to the block differs by a constant, which a slope ignores
    cum = with_basics(blocked).withColumn(
        "cum", F.sum(F.coalesce("ret", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return own_rows(with_slope(cum, "cum", 100, "slope")).select(
        "series_id", "ts", "bar_idx", r6("slope").alias("slope")
    )


def atr_and_trend(spark, sf):
    """Last simple ATR, and the share of bars with the 20-bar mean under the 50-bar mean."""
    w = series_window()
    blocked = to_blocks(index_bars(hourly_bars(spark, sf)), back=LOOKBACK)
    cols = own_rows(blocked.withColumns({
        "atr_simple": sma(F.col("high") - F.col("low"), w, 14),
        "down": F.coalesce(sma("close", w, 20) < sma("close", w, 50), F.lit(False)),
    }))
    return cols.groupBy("series_id").agg(
        r6(F.max_by("atr_simple", "bar_idx")).alias("last_atr"),
        r6(F.when(F.count(F.lit(1)) >= 50, 100 * F.avg(F.col("down").cast("int")))).alias("downtrend_pct"),
    )


def vwap_slope(spark, sf):
    """Three-bar VWAP change in ATR(14) units."""
    from tickloom.functions.recursive import WARMUP, fold_columns

    w = series_window()
    blocked = to_blocks(index_bars_with_vwap(hourly_bars(spark, sf)), back=WARMUP)
    lagged = blocked.withColumn("vwap_lag3", F.lag("vwap", 3).over(w))
    folded = fold_columns(lagged, ["atr"], keep=["ts", "vwap", "vwap_lag3"])
    slope = (F.col("vwap") - F.col("vwap_lag3")) / no_zero("atr")
    return folded.select("series_id", "ts", r6("vwap").alias("vwap"), r6(slope).alias("vwap_slope"))


_FIRST = ", ".join(f"{rnd(c)} AS {c}" for c in WINDOW_COLUMNS)
_REC = ", ".join(f"{rnd(c)} AS {c}" for c in RECURSIVE)


def condition_rows_sql() -> str:
    from tickloom.functions.conditions import condition_names

    items = ", ".join(
        f"{{'family': '{f}', 'signal': '{s}', 'hit': coalesce({CONDITION_SQL[s]}, false)}}"
        for f, s in condition_names()
    )
    return f"""{condition_input_sql()},
sig AS (SELECT series_id, bar_idx, ts, hr, n_bars, close, s.family AS family, s.signal AS signal FROM (
  SELECT series_id, bar_idx, ts, hr, n_bars, close, unnest([{items}]) AS s FROM cin) WHERE s.hit)"""


_SIG = condition_rows_sql()

_RECURSIVE_SQL = f"""{RECURSIVE_WITH}
SELECT rin.series_id, rin.bar_idx, ts, {_REC} FROM rin
JOIN idx ON idx.series_id = rin.series_id AND idx.bar_idx = rin.bar_idx"""

QUERIES = {
    "rolling_indicators": (rolling_indicators, f"""WITH {bars_sql()},
{PREPARED},
{WINDOWED}
SELECT series_id, ts, bar_idx, {_FIRST} FROM win"""),
    "recursive_indicators": (recursive_columns, _RECURSIVE_SQL),
    "recursive_indicators_blocks": (recursive_columns_blocks, by_minute(_RECURSIVE_SQL)),
    "entry_conditions": (entry_conditions, f"{_SIG} SELECT series_id, bar_idx, ts, family, signal FROM sig"),
    "condition_counts": (condition_counts, f"""{_SIG}
SELECT series_id, family, signal, count(*) AS n, min(bar_idx) AS first_idx, max(bar_idx) AS last_idx
FROM sig GROUP BY ALL"""),
    "rolling_slope": (rolling_slope, f"""WITH {bars_sql(DAILY)},
ret AS (SELECT *, coalesce(close / nullif({lag('close')}, 0) - 1, 0) AS ret FROM idx),
cum AS (SELECT *, sum(ret) OVER (PARTITION BY series_id ORDER BY bar_idx) AS cum FROM ret)
SELECT series_id, ts, bar_idx, {rnd('''CASE WHEN bar_idx >= 99 THEN regr_slope(cum, bar_idx)
  OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) END''')} AS slope FROM cum"""),
    "atr_and_trend": (atr_and_trend, f"""WITH {bars_sql()},
m AS (SELECT *, {roll('avg', '(high - low)', 14)} AS atr,
  coalesce({roll('avg', 'close', 20)} < {roll('avg', 'close', 50)}, false) AS down FROM idx)
SELECT series_id, {rnd('arg_max(atr, bar_idx)')} AS last_atr,
  {rnd('CASE WHEN count(*) >= 50 THEN 100 * avg(down::INT) END')} AS downtrend_pct
FROM m GROUP BY series_id"""),
    "vwap_slope": (vwap_slope, f"""{RECURSIVE_WITH}
SELECT series_id, ts, {rnd('vwap')} AS vwap, {rnd('(vwap - v3) / nullif(atr, 0)')} AS vwap_slope
FROM (SELECT pre.series_id, pre.ts, vwap, atr,
        lag(vwap, 3) OVER (PARTITION BY pre.series_id ORDER BY pre.bar_idx) AS v3
      FROM pre JOIN rin ON pre.series_id = rin.series_id AND pre.bar_idx = rin.bar_idx)"""),
}
