"""The catalogue of 61 entry conditions in 9 families.

``condition_columns`` gives one boolean Column per condition over the columns of
``with_condition_inputs``; ``pack`` stores them in one BIGINT, so the wide set
crosses a shuffle as eight bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import is_true, no_zero, series_window
from tickloom.functions.indicators import LOOKBACK, with_forward_returns, with_window_indicators
from tickloom.functions.recursive import WARMUP, fold_columns
from tickloom.operators.blocks import BLOCK_ROWS, index_bars_with_vwap, to_blocks

RECURSIVE_INPUTS = (
    "rsi", "atr", "atr_ma", "di_plus", "di_minus", "adx", "macd", "macd_signal", "demarker",
    "keltner_upper", "keltner_lower", "wave_trend", "schaff", "qqe", "supertrend", "psar", "laguerre",
)
RECURSIVE_LAGS = (
    ("rsi", 1), ("macd", 1), ("macd_signal", 1), ("laguerre", 1), ("qqe", 1), ("schaff", 1),
    ("wave_trend", 1), ("keltner_upper", 1), ("adx", 3), ("di_minus", 3), ("atr", 3),
)
# finite-memory columns whose earlier values the catalogue compares with
WINDOW_LAGS = (
    ("sma20", 1), ("aroon_up", 3), ("aroon_down", 3), ("stoch_k", 1), ("stoch_d", 1),
    ("williams", 1), ("cci", 1), ("bb_upper", 1), ("bb_lower", 1), ("volume", 1), ("vwap", 3),
    ("close", 1), ("open", 1), ("high", 1), ("close", 8), ("close", 24),
)


# Families and names of the catalogue, in order.
CATALOGUE = {
    "trend": (
        "supertrend_down", "psar_above_close", "close_below_sma20", "sma20_falling", "aroon_down_high",
        "aroon_down_rising_from_low", "aroon_up_falling_from_high", "close_at_20_bar_low",
    ),
    "strength": (
        "adx_above_25", "adx_below_20", "adx_rising", "di_minus_above_plus", "di_minus_rising",
        "adx_25_and_di_minus", "below_sma20_and_adx_25",
    ),
    "momentum": (
        "rsi_falling", "rsi_below_30", "rsi_30_to_50", "macd_cross_below_zero", "macd_below_zero",
        "macd_signal_falling", "stoch_d_cross_down", "williams_falling", "cci_turns_down", "demarker_above_07",
        "laguerre_falling", "qqe_falling", "schaff_cross_below_50", "wave_trend_falling",
    ),
    "volatility": (
        "atr_rising", "atr_above_mean", "bb_upper_falling", "bb_lower_falling", "bandwidth_above_mean",
        "ulcer_above_mean",
    ),
    "volume": (
        "volume_rising", "volume_above_mean", "volume_above_150pct",
    ),
    "vwap": (
        "close_below_vwap", "vwap_falling", "below_falling_vwap",
    ),
    "candles": (
        "doji", "shooting_star", "bearish_engulfing", "dark_cloud", "gap_above_prev_high",
    ),
    "extension": (
        "rsi_above_70", "rsi_above_75", "stoch_k_above_90", "williams_above_minus10", "cci_above_150",
        "demarker_above_08", "close_above_bb_upper", "close_2atr_above_sma20", "close_15atr_above_vwap",
        "three_up_bars", "four_up_bars", "ret8_above_1pct", "ret24_above_2pct",
    ),
    "channels": (
        "close_below_keltner", "keltner_upper_falling",
    ),
}


def condition_columns() -> list[tuple[str, str, Column]]:
    """(family, name, condition) in catalogue order."""
    c = F.col
    height = c("high") - c("low")
    below_vwap, vwap_down = c("close") < c("vwap"), c("vwap") < c("vwap_lag3")
    sma_down, strong = c("close") < c("sma20"), c("adx") > 25
    prev_up = c("close_lag1") > c("open_lag1")
    families = {
        "trend": {
            "supertrend_down": c("supertrend") < 0,
            "psar_above_close": c("psar") > c("close"),
            "close_below_sma20": sma_down,
            "sma20_falling": c("sma20") - c("sma20_lag1") < 0,
            "aroon_down_high": c("aroon_down") > 70,
            "aroon_down_rising_from_low": (c("aroon_down") > c("aroon_down_lag3")) & (c("aroon_down_lag3") < 30),
            "aroon_up_falling_from_high": (c("aroon_up") < c("aroon_up_lag3")) & (c("aroon_up_lag3") > 70),
            "close_at_20_bar_low": c("close") <= c("low20"),
        },
        "strength": {
            "adx_above_25": strong,
            "adx_below_20": c("adx") < 20,
            "adx_rising": c("adx") > c("adx_lag3"),
            "di_minus_above_plus": c("di_minus") > c("di_plus"),
            "di_minus_rising": c("di_minus") > c("di_minus_lag3"),
            "adx_25_and_di_minus": strong & (c("di_minus") > c("di_plus")),
            "below_sma20_and_adx_25": sma_down & strong,
        },
        "momentum": {
            "rsi_falling": c("rsi") < c("rsi_lag1"),
            "rsi_below_30": c("rsi") < 30,
            "rsi_30_to_50": (c("rsi") >= 30) & (c("rsi") < 50),
            "macd_cross_below_zero": (c("macd") < 0) & (c("macd_lag1") >= 0),
            "macd_below_zero": c("macd") < 0,
            "macd_signal_falling": c("macd_signal") < c("macd_signal_lag1"),
            "stoch_d_cross_down": (c("stoch_d") < c("stoch_k")) & (c("stoch_d_lag1") >= c("stoch_k_lag1")),
            "williams_falling": c("williams") < c("williams_lag1"),
            "cci_turns_down": (c("cci") < c("cci_lag1")) & (c("cci_lag1") > 0),
            "demarker_above_07": c("demarker") > 0.7,
            "laguerre_falling": c("laguerre") < c("laguerre_lag1"),
            "qqe_falling": c("qqe") < c("qqe_lag1"),
            "schaff_cross_below_50": (c("schaff") < 50) & (c("schaff_lag1") >= 50),
            "wave_trend_falling": c("wave_trend") < c("wave_trend_lag1"),
        },
        "volatility": {
            "atr_rising": c("atr") > c("atr_lag3"),
            "atr_above_mean": c("atr") > c("atr_ma"),
            "bb_upper_falling": c("bb_upper") < c("bb_upper_lag1"),
            "bb_lower_falling": c("bb_lower") < c("bb_lower_lag1"),
            "bandwidth_above_mean": c("bandwidth") > c("bandwidth_ma"),
            "ulcer_above_mean": c("ulcer") > c("ulcer_ma"),
        },
        "volume": {
            "volume_rising": c("volume") > c("volume_lag1"),
            "volume_above_mean": c("volume") > c("volume_ma"),
            "volume_above_150pct": c("volume") > 1.5 * c("volume_ma"),
        },
        "vwap": {
            "close_below_vwap": below_vwap,
            "vwap_falling": vwap_down,
            "below_falling_vwap": below_vwap & vwap_down,
        },
        "candles": {
            "doji": (c("close") - c("low") < 0.25 * height) & (c("high") - c("close") < 0.25 * height),
            "shooting_star": c("high") - c("close") > 0.6 * height,
            "bearish_engulfing": (c("close") < c("open")) & prev_up & (c("close") < c("open_lag1"))
            & (c("open") > c("close_lag1")),
            "dark_cloud": prev_up & (c("open") > c("close_lag1"))
            & (c("close") < (c("close_lag1") + c("open_lag1")) / 2),
            "gap_above_prev_high": c("open") > c("high_lag1"),
        },
        "extension": {
            "rsi_above_70": c("rsi") > 70,
            "rsi_above_75": c("rsi") > 75,
            "stoch_k_above_90": c("stoch_k") > 90,
            "williams_above_minus10": c("williams") > -10,
            "cci_above_150": c("cci") > 150,
            "demarker_above_08": c("demarker") > 0.8,
            "close_above_bb_upper": c("close") > c("bb_upper"),
            "close_2atr_above_sma20": c("close") > c("sma20") + 2 * c("atr"),
            "close_15atr_above_vwap": c("close") > c("vwap") + 1.5 * c("atr"),
            "three_up_bars": c("up3") == 3,
            "four_up_bars": c("up4") == 4,
            "ret8_above_1pct": c("close") / no_zero("close_lag8") - 1 > 0.01,
            "ret24_above_2pct": c("close") / no_zero("close_lag24") - 1 > 0.02,
        },
        "channels": {
            "close_below_keltner": c("close") < c("keltner_lower"),
            "keltner_upper_falling": c("keltner_upper") < c("keltner_upper_lag1"),
        },
    }
    return [(f, name, families[f][name]) for f, names in CATALOGUE.items() for name in names]




def condition_names() -> list[tuple[str, str]]:
    return [(family, name) for family, names in CATALOGUE.items() for name in names]


# conditions that read a recursive indicator; all others are settled before the fold
NEEDS_FOLD = frozenset({
    "supertrend_down", "psar_above_close", "adx_above_25", "adx_below_20", "adx_rising", "di_minus_above_plus",
    "di_minus_rising", "adx_25_and_di_minus", "below_sma20_and_adx_25", "rsi_falling", "rsi_below_30", "rsi_30_to_50",
    "macd_cross_below_zero", "macd_below_zero", "macd_signal_falling", "demarker_above_07", "laguerre_falling",
    "qqe_falling", "schaff_cross_below_50", "wave_trend_falling", "atr_rising", "atr_above_mean", "rsi_above_70",
    "rsi_above_75", "demarker_above_08", "close_2atr_above_sma20", "close_15atr_above_vwap", "close_below_keltner",
    "keltner_upper_falling",
})


def pack(conditions: dict[int, Column]) -> Column:
    """One BIGINT with bit k set where condition k holds."""
    bits = F.lit(0).cast("bigint")
    for k, cond in conditions.items():
        bits = bits + F.when(is_true(cond), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return bits


def with_condition_inputs(
    bars: DataFrame, horizons=(4, 8, 24), size: int = BLOCK_ROWS, warmup: int = WARMUP
) -> DataFrame:
    """One row per bar: ``window_bits`` (conditions without a recurrence), the recursive columns, forward returns.

    The window columns and the recursive fold share one shuffle on (series, block).
    Window-only conditions are packed before the fold, so that only a dozen columns
    cross into Python instead of all of them.
    """
    w = series_window()
    indexed = index_bars_with_vwap(bars)
    blocked = to_blocks(indexed, back=max(warmup, LOOKBACK), ahead=max(horizons, default=0), size=size)
    cols = with_window_indicators(blocked)
    up = F.when(F.col("close") > F.lag("close").over(w), 1).otherwise(0)
    cols = cols.withColumn("_up", up)
    cols = cols.withColumns({
        **{f"{c}_lag{k}": F.lag(c, k).over(w) for c, k in WINDOW_LAGS},
        **{f"up{n}": F.sum("_up").over(w.rowsBetween(-(n - 1), 0)) for n in (3, 4)},
    })
    cols = with_forward_returns(cols, horizons, w)
    early = {k: cond for k, (_, name, cond) in enumerate(condition_columns()) if name not in NEEDS_FOLD}
    kept = ["ts", "n_bars", "close", "sma20", "vwap", *[f"fwd{h}" for h in horizons]]
    packed = cols.select(
        "series_id", "blk", "bar_idx", "own", "open", "high", "low", "volume", *kept, pack(early).alias("window_bits")
    )
    return fold_columns(packed, RECURSIVE_INPUTS, RECURSIVE_LAGS, keep=[*kept, "window_bits"], size=size)


def settled_conditions() -> list[tuple[str, str, Column]]:
    """The catalogue over ``with_condition_inputs``: early conditions read their bit."""
    return [
        (family, name, cond if name in NEEDS_FOLD else F.bit_get(F.col("window_bits"), F.lit(k)) == 1)
        for k, (family, name, cond) in enumerate(condition_columns())
    ]


def signal_bits(bars: DataFrame, horizons=(4, 8, 24), **blocks) -> DataFrame:
    """Slim table: series_id, blk, bar_idx, ts, n_bars, signal bits and forward returns."""
    wide = with_condition_inputs(bars, horizons, **blocks)
    late = {k: cond for k, (_, name, cond) in enumerate(condition_columns()) if name in NEEDS_FOLD}
    return wide.select(
        "series_id", "blk", "bar_idx", "ts", "n_bars", (F.col("window_bits") + pack(late)).alias("bits"),
        *[f"fwd{h}" for h in horizons],
    )


def signal_rows(bars: DataFrame, **blocks) -> DataFrame:
    """Long table of true conditions: (series_id, bar_idx, ts, family, signal)."""
    wide = with_condition_inputs(bars, (), **blocks)
    hit = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(f).alias("family"), F.lit(s).alias("signal")))
        for f, s, cond in settled_conditions()
    ]))
    return wide.select("series_id", "bar_idx", "ts", F.explode(hit).alias("s")).select(
        "series_id", "bar_idx", "ts", "s.family", "s.signal"
    )
