"""Finite-memory indicators as window expressions over blocked bars.

All of them use the same partitioning and ordering, so Spark evaluates each
nesting level in one Window node after one shuffle.  ``LOOKBACK`` is the halo the
deepest nesting needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec, functions as F

from tickloom.functions.columns import no_zero, rolling_max, rolling_min, rolling_std, series_window, sma

LOOKBACK = 128


def with_basics(bars: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """Return, lags, true range, bar range, candle parts and typical price."""
    w = w or series_window()
    prev = F.lag("close").over(w)
    span_ = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    return bars.withColumns({
        "prev_close": prev,
        "ret": F.col("close") / no_zero(prev) - 1,
        "true_range": F.greatest(span_, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "bar_range": span_,
        "range_pct": span_ / no_zero("close") * 100,
        "body": body,
        "upper_wick": F.col("high") - F.greatest("open", "close"),
        "lower_wick": F.least("open", "close") - F.col("low"),
        "body_pct": body / (span_ + F.lit(1e-10)) * 100,
        "tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
    })


def with_window_indicators(bars: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """Bollinger, stochastic, Williams %R, CCI, Aroon, Ulcer, moving averages and band width.

    Expects ``bar_idx`` and OHLCV; adds warm-up NULLs like every rolling column.
    """
    w = w or series_window()
    at = w.rowsBetween(-14, 0)
    rows = F.count(F.lit(1)).over(at)
    top = F.max(F.struct("high", (-F.col("bar_idx")).alias("i"))).over(at)
    bottom = F.min(F.struct("low", F.col("bar_idx").alias("i"))).over(at)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    hh, ll = rolling_max("high", w, 14), rolling_min("low", w, 14)
    top_close = rolling_max("close", w, 14)
    first = bars.withColumns({
        "tp": tp,
        "sma20": sma("close", w, 20),
        "std20": rolling_std("close", w, 20),
        "tp_ma": sma(tp, w, 20),
        "stoch_raw": 100 * (F.col("close") - ll) / no_zero(hh - ll),
        "williams": -100 * (hh - F.col("close")) / no_zero(hh - ll),
        # first maximum (minimum) of the last 15 bars, counted from the oldest
        "aroon_up": F.when(rows == 15, 100 * (14 - (F.col("bar_idx") + top["i"])) / 14),
        "aroon_down": F.when(rows == 15, 100 * (14 - (F.col("bar_idx") - bottom["i"])) / 14),
        "dip_pct": 100 * (F.col("close") - top_close) / no_zero(top_close),
        "volume_ma": sma("volume", w, 20),
        "low20": rolling_min("low", w, 20),
    })
    second = first.withColumns({
        "bb_upper": F.col("sma20") + 2 * F.col("std20"),
        "bb_lower": F.col("sma20") - 2 * F.col("std20"),
        "bandwidth": 4 * F.col("std20") / no_zero("sma20"),
        "stoch_k": sma("stoch_raw", w, 3),
        "tp_dev": F.abs(F.col("tp") - F.col("tp_ma")),
        "ulcer": F.sqrt(sma(F.col("dip_pct") * F.col("dip_pct"), w, 14)),
    })
    return second.withColumns({
        "stoch_d": sma("stoch_k", w, 3),
        "cci": (F.col("tp") - F.col("tp_ma")) / (0.015 * no_zero(sma("tp_dev", w, 20))),
        "bandwidth_ma": sma("bandwidth", w, 100),
        "ulcer_ma": sma("ulcer", w, 100),
    }).drop("stoch_raw", "dip_pct", "tp_dev", "tp_ma")


def with_forward_returns(bars: DataFrame, horizons=(4, 8, 24), w: WindowSpec | None = None) -> DataFrame:
    """``fwd<h>`` = close[t+h]/close[t]-1; needs a halo of max(horizons) later rows."""
    w = w or series_window()
    return bars.withColumns({
        f"fwd{h}": F.lead("close", h).over(w) / no_zero("close") - 1 for h in horizons
    })


def with_slope(df: DataFrame, y: str, n: int, out: str, w: WindowSpec | None = None) -> DataFrame:
    """Rolling least-squares slope of ``y`` on the bar position over ``n`` bars."""
    w = w or series_window()
    frame = w.rowsBetween(-(n - 1), 0)
    x = F.col("bar_idx").cast("double")
    return df.withColumn(
        out, F.when(F.count(F.col(y)).over(frame) == n, F.regr_slope(F.col(y), x).over(frame))
    )
