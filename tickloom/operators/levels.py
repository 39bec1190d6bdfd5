"""Reference price levels, triggers and named setups.

Everything a level needs from other bars of the day, the previous day or the
previous week sits in one small per-day table, so bars are joined once, on
(series, day).  A level is NULL until it is known: session levels appear at their
formation hour and only between 13 and 19 h.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import is_true, no_zero, rolling_std, series_window
from tickloom.functions.indicators import with_window_indicators
from tickloom.functions.recursive import WARMUP, fold_columns
from tickloom.operators.blocks import BLOCK_ROWS, index_bars_with_vwap, to_blocks

# First hour (UTC) at which each level is known.
LEVEL_HOURS = {
    "orb_low": 14, "orb_high": 14, "session_open": 14, "ib_low": 15, "ib_high": 15,
    "overnight_low": 13, "overnight_high": 13, "vwap": 13, "vwap_minus_sd": 13, "vwap_plus_sd": 13,
    "prev_day_low": 0, "prev_day_high": 0, "prev_day_close": 0, "prev_week_low": 0, "prev_week_high": 0,
}
SESSION_LEVELS = ("orb_low", "orb_high", "session_open", "ib_low", "ib_high", "overnight_low", "overnight_high")
TRIGGERS = ("close_below", "cross_below", "retest_reject")


def day_context(bars: DataFrame) -> DataFrame:
    """One row per (series, day): opening range, initial balance, overnight range, previous day and week, NR7."""
    hour = F.hour("ts")

    def low_of(cond):
        return F.min(F.when(cond, F.col("low")))

    def high_of(cond):
        return F.max(F.when(cond, F.col("high")))

    days = bars.groupBy("series_id", F.to_date("ts").alias("day")).agg(
        low_of(hour == 13).alias("orb_low"), high_of(hour == 13).alias("orb_high"),
        low_of(hour.isin(13, 14)).alias("ib_low"), high_of(hour.isin(13, 14)).alias("ib_high"),
        F.max(F.when(hour == 13, F.col("open"))).alias("session_open"),
        F.max_by("low", F.when(hour == 13, F.col("ts"))).alias("last13_low"),
        F.max_by("high", F.when(hour == 13, F.col("ts"))).alias("last13_high"),
        low_of(hour <= 12).alias("_early_low"), high_of(hour <= 12).alias("_early_high"),
        low_of(hour >= 20).alias("_late_low"), high_of(hour >= 20).alias("_late_high"),
        F.min("low").alias("_low"), F.max("high").alias("_high"), F.max_by("close", "ts").alias("_close"),
    )
    # one row per calendar day of a series: small enough for plain windows
    w = Window.partitionBy("series_id").orderBy("day")
    eve = F.lag("day").over(w) == F.date_sub("day", 1)
    seven = w.rowsBetween(-6, 0)
    narrow = (F.count(F.lit(1)).over(seven) == 7) & (
        F.col("_high") - F.col("_low") <= F.min(F.col("_high") - F.col("_low")).over(seven)
    )
    days = days.withColumns({
        "overnight_low": F.least("_early_low", F.when(eve, F.lag("_late_low").over(w))),
        "overnight_high": F.greatest("_early_high", F.when(eve, F.lag("_late_high").over(w))),
        "prev_day_low": F.lag("_low").over(w),
        "prev_day_high": F.lag("_high").over(w),
        "prev_day_close": F.lag("_close").over(w),
        "_nr7": narrow,
        "week": F.trunc("day", "week"),
    }).withColumn("nr7", F.coalesce(F.lag("_nr7").over(w), F.lit(False)))
    ww = Window.partitionBy("series_id").orderBy("week")
    weeks = days.groupBy("series_id", "week").agg(F.min("_low").alias("_wl"), F.max("_high").alias("_wh"))
    weeks = weeks.select(
        "series_id", "week", F.lag("_wl").over(ww).alias("prev_week_low"), F.lag("_wh").over(ww).alias("prev_week_high")
    )
    return days.join(weeks, ["series_id", "week"]).select(
        "series_id", "day", "orb_low", "orb_high", "ib_low", "ib_high", "session_open", "overnight_low",
        "overnight_high", "prev_day_low", "prev_day_high", "prev_day_close", "prev_week_low", "prev_week_high", "nr7",
        "last13_low", "last13_high",
    )


def prepare(
    bars: DataFrame, size: int = BLOCK_ROWS, warmup: int = WARMUP, oscillators: bool = False
) -> DataFrame:
    """Bars with position, ATR(14), lags, and all level columns; optionally RSI(14) and CCI(20)."""
    w = series_window()
    blocked = to_blocks(index_bars_with_vwap(bars), back=max(warmup, 32), size=size)
    cols = blocked.withColumn("_sd", rolling_std("close", w, 20)).withColumns({
        **{f"{c}_lag{k}": F.lag(c, k).over(w) for c in ("close", "high") for k in (1, 2, 3)},
        "sd_lag1": F.lag("_sd").over(w),
        "vwap_lag3": F.lag("vwap", 3).over(w),
    }).drop("_sd")
    if oscillators:
        cols = with_window_indicators(cols).select(*cols.columns, "cci")
    folds = ["atr", "rsi"] if oscillators else ["atr"]
    folded = fold_columns(cols, folds, keep=cols.columns, size=size).drop("blk").withColumns({
        "day": F.to_date("ts"), "hour": F.hour("ts"),
    })
    joined = folded.join(day_context(bars), ["series_id", "day"], "left")
    in_session = F.col("hour").between(13, 19)
    # range of the latest 13 h bar so far, carried to the end of the day
    formed = {
        f"range_{c}": F.when(F.col("hour") == 13, F.col(c)).when(F.col("hour") > 13, F.col(f"last13_{c}"))
        for c in ("low", "high")
    }
    gated = {
        name: F.when(in_session & (F.col("hour") >= LEVEL_HOURS[name]), F.col(name)) for name in SESSION_LEVELS
    }
    bands = {
        "vwap_minus_sd": F.when(F.col("hour") >= 13, F.col("vwap") - F.col("sd_lag1")),
        "vwap_plus_sd": F.when(F.col("hour") >= 13, F.col("vwap") + F.col("sd_lag1")),
        "vwap_level": F.when(F.col("hour") >= 13, F.col("vwap")),
        "vwap_slope": (F.col("vwap") - F.col("vwap_lag3")) / no_zero("atr"),
    }
    return joined.withColumns(formed).withColumns({**gated, **bands})


def level_column(name: str) -> Column:
    return F.col("vwap_level" if name == "vwap" else name)


def trigger(level: Column, kind: str) -> Column:
    """Whether the bar fires a trigger against a level; missing values never fire.

    The three short triggers, and the long mirrors of the first two.
    """
    close, prev = F.col("close"), F.col("close_lag1")
    if kind == "close_below":
        cond = close < level
    elif kind == "cross_below":
        cond = (prev >= level) & (close < level)
    elif kind == "close_above":
        cond = close > level
    elif kind == "cross_above":
        cond = (prev <= level) & (close > level)
    elif kind == "retest_reject":
        touched = F.lit(False)
        for k in (1, 2, 3):
            touched = touched | is_true((F.col(f"high_lag{k}") >= level) & (F.col(f"close_lag{k}") < level))
        cond = touched & (close < level)
    else:
        raise ValueError(f"unknown trigger {kind!r}")
    return is_true(cond)


def fired_cells(prepared: DataFrame, levels: Iterable[str] = tuple(LEVEL_HOURS), triggers: Iterable[str] = TRIGGERS) -> DataFrame:
    """Explode each bar to the (level, trigger) cells it fires."""
    cells = F.array_compact(F.array(*[
        F.when(trigger(level_column(lv), tr), F.struct(F.lit(lv).alias("level"), F.lit(tr).alias("trigger")))
        for lv in levels for tr in triggers
    ]))
    return prepared.withColumn("_cell", F.explode(cells)).withColumns({
        "level": F.col("_cell.level"), "trigger": F.col("_cell.trigger"),
    }).drop("_cell")


def level_rows(prepared: DataFrame) -> DataFrame:
    """Long table of known levels: (series_id, bar_idx, ts, level, value)."""
    known = F.array_compact(F.array(*[
        F.when(level_column(n).isNotNull(), F.struct(F.lit(n).alias("level"), level_column(n).alias("value")))
        for n in LEVEL_HOURS
    ]))
    return prepared.select("series_id", "bar_idx", "ts", F.explode(known).alias("_l")).select(
        "series_id", "bar_idx", "ts", "_l.level", "_l.value"
    )


def setup_columns() -> dict[str, Column]:
    """The five named short setups."""
    h, close = F.col("hour"), F.col("close")
    late = (h > 13) & (h <= 20)
    session = h.between(13, 20)
    breakdown = close < F.col("range_low")
    rejection = (F.col("close_lag1") > F.col("vwap")) & (close < F.col("vwap")) & (F.col("vwap_slope") < 0)
    return {
        "orb_breakdown": is_true(late & breakdown),
        "gap_up_fade": is_true((h == 13) & (F.col("open") > F.col("prev_day_high"))),
        "prev_day_low_breakdown": is_true(session & (close < F.col("prev_day_low"))),
        "nr7_orb_breakdown": is_true(late & F.col("nr7") & breakdown),
        "vwap_rejection": is_true(session & rejection),
    }


# The declared level signals (name, level, trigger, direction).
DECLARED_SIGNALS = (
    ("short_overnight_low_cross", "overnight_low", "cross_below", "short"),
    ("short_prev_day_close", "prev_day_close", "close_below", "short"),
    ("short_prev_week_high_cross", "prev_week_high", "cross_below", "short"),
    ("short_overnight_high_cross", "overnight_high", "cross_below", "short"),
    ("short_overnight_high_close", "overnight_high", "close_below", "short"),
    ("long_overnight_low_cross", "overnight_low", "cross_above", "long"),
    ("long_prev_day_close", "prev_day_close", "close_above", "long"),
    ("long_prev_week_high_cross", "prev_week_high", "cross_above", "long"),
    ("long_overnight_high_cross", "overnight_high", "cross_above", "long"),
    ("long_overnight_high_close", "overnight_high", "close_above", "long"),
)


def fired_signals(prepared: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Explode each bar to the named conditions it fires (column ``signal``)."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return prepared.withColumn("signal", F.explode(hits))


def declared_columns() -> dict[str, Column]:
    """The declared short and long level signals, plus the two oscillator longs."""
    named = {n: trigger(level_column(lv), tr) for n, lv, tr, _ in DECLARED_SIGNALS}
    named["long_rsi_above_70"] = is_true(F.col("rsi") > 70)
    named["long_cci_above_150"] = is_true(F.col("cci") > 150)
    return named


def first_per_day(fired: DataFrame, keys: Iterable[str], check_atr: bool = True) -> DataFrame:
    """First bar of each UTC day per key with a usable ATR; validity is tested before the day is claimed.

    Rows are already split by (series, day), so this aggregate needs no shuffle.
    """
    keys = list(keys)
    valid = fired.filter(F.col("atr") > 0) if check_atr else fired
    return valid.groupBy("series_id", "day", *keys).agg(
        F.min("bar_idx").alias("entry_idx"),
        F.min("ts").alias("entry_ts"),
        F.min_by("close", "bar_idx").alias("entry_price"),
        F.min_by("atr", "bar_idx").alias("atr"),
        F.min_by("n_bars", "bar_idx").alias("n_bars"),
    ).drop("day")
