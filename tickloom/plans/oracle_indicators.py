"""Oracle SQL of the indicators: named windows, and recursive CTEs for the recurrences."""

from __future__ import annotations

from tickloom.plans.common import bars_sql, lag, roll

PREPARED = f"""pre AS (
  SELECT *, (high + low + close) / 3 AS tp, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl,
         {lag('open')} AS po,
         greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,
         CASE WHEN volume <> 0 THEN
           sum(CASE WHEN volume <> 0 THEN (high + low + close) / 3 * volume END) OVER d
           / sum(nullif(volume, 0)) OVER d END AS vwap
  FROM idx WINDOW d AS (PARTITION BY series_id, day ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))"""

WINDOWED = f"""win1 AS (
  SELECT *, {roll('avg', 'close', 20)} AS sma20, {roll('stddev_samp', 'close', 20)} AS std20,
    {roll('avg', 'tp', 20)} AS tp_ma,
    100 * (close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) AS stoch_raw,
    -100 * ({roll('max', 'high', 14)} - close) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) AS williams,
    100 * (close - {roll('max', 'close', 14)}) / nullif({roll('max', 'close', 14)}, 0) AS dip,
    CASE WHEN bar_idx >= 14 THEN 100.0 * (14 - (bar_idx + (max(row(high, -bar_idx)) OVER a)[2])) / 14 END AS aroon_up,
    CASE WHEN bar_idx >= 14 THEN 100.0 * (14 - (bar_idx - (min(row(low, bar_idx)) OVER a)[2])) / 14 END AS aroon_down,
    {roll('avg', 'volume', 20)} AS volume_ma, {roll('min', 'low', 20)} AS low20
  FROM pre WINDOW a AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
win2 AS (
  SELECT *, sma20 + 2 * std20 AS bb_upper, sma20 - 2 * std20 AS bb_lower, 4 * std20 / nullif(sma20, 0) AS bandwidth,
    {roll('avg', 'stoch_raw', 3)} AS stoch_k, abs(tp - tp_ma) AS tp_dev, sqrt({roll('avg', 'dip * dip', 14)}) AS ulcer
  FROM win1),
win AS (
  SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d,
    (tp - tp_ma) / (0.015 * nullif({roll('avg', 'tp_dev', 20)}, 0)) AS cci,
    {roll('avg', 'bandwidth', 100)} AS bandwidth_ma, {roll('avg', 'ulcer', 100)} AS ulcer_ma
  FROM win2)"""


class Recurrence:
    """Collects state columns of one recursive CTE over ``source`` (alias p); r is the previous row."""

    def __init__(self, name: str, source: str):
        self.name, self.source = name, source
        self.first: list[str] = []
        self.next: list[str] = []

    def state(self, name: str, first: str, step: str) -> None:
        self.first.append(f"{first} AS {name}")
        self.next.append(f"{step} AS n_{name}")

    def ewm(self, name: str, x0: str, x: str, alpha: str) -> None:
        """Exponential mean of x with the gap rule."""
        self.state(name, f"CAST({x0} AS DOUBLE)", f"""CASE WHEN {x} IS NULL THEN r.{name} WHEN r.{name} IS NULL THEN {x}
          ELSE (pow(1 - {alpha}, r.g_{name} + 1) * r.{name} + {alpha} * ({x})) / (pow(1 - {alpha}, r.g_{name} + 1) + {alpha}) END""")
        self.state(f"g_{name}", "0", f"CASE WHEN {x} IS NULL AND r.{name} IS NOT NULL THEN r.g_{name} + 1 ELSE 0 END")

    def sql(self) -> str:
        return f"""{self.name} AS (
  SELECT p.series_id, p.bar_idx, {', '.join(self.first)} FROM {self.source} p WHERE p.bar_idx = 0
  UNION ALL
  SELECT p.series_id, p.bar_idx, {', '.join(self.next)}
  FROM {self.name} r JOIN {self.source} p ON p.series_id = r.series_id AND p.bar_idx = r.bar_idx + 1)"""


def _alpha(n: int) -> str:
    return f"(1.0::DOUBLE / {n})"


def _span(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


def recursions() -> str:
    r = Recurrence("rec", "pre")
    r.ewm("gain", "NULL", "greatest(p.close - p.pc, 0)", _alpha(14))
    r.ewm("loss", "NULL", "greatest(p.pc - p.close, 0)", _alpha(14))
    r.state("rsi", "NULL::DOUBLE", "100 - 100 / (1 + n_gain / nullif(n_loss, 0))")
    for n in (10, 14, 20):
        r.ewm(f"atr{n}", "p.tr", "p.tr", _alpha(n))
    up, dn = "(p.high - p.ph)", "(p.pl - p.low)"
    r.ewm("pdm", "0.0", f"CASE WHEN {up} > {dn} AND {up} > 0 THEN {up} ELSE 0 END", _alpha(14))
    r.ewm("mdm", "0.0", f"CASE WHEN {dn} > {up} AND {dn} > 0 THEN {dn} ELSE 0 END", _alpha(14))
    r.state("di_plus", "100 * 0.0 / nullif(p.tr, 0)", "100 * n_pdm / nullif(n_atr14, 0)")
    r.state("di_minus", "100 * 0.0 / nullif(p.tr, 0)", "100 * n_mdm / nullif(n_atr14, 0)")
    r.ewm("adx", "NULL", "(100 * abs(n_di_plus - n_di_minus) / nullif(n_di_plus + n_di_minus, 0))", _alpha(14))
    for n in (12, 26, 20, 23, 50):
        r.ewm(f"ema{n}", "p.close", "p.close", _span(n))
    r.ewm("macd_signal", "0.0", "(n_ema12 - n_ema26)", _span(9))
    r.ewm("dmax", "NULL", f"greatest({up}, 0)", _alpha(14))
    r.ewm("dsum", "NULL", f"nullif(greatest({up}, 0) + greatest({dn}, 0), 0)", _alpha(14))
    r.ewm("esa", "p.tp", "p.tp", _span(10))
    r.ewm("dev", "0.0", "abs(p.tp - n_esa)", _span(10))
    r.ewm("wave_trend", "NULL", "((p.tp - n_esa) / (0.015 * nullif(n_dev, 0)))", _span(21))
    r.ewm("qqe", "NULL", "n_rsi", _span(5))
    r.ewm("qqe_dev", "NULL", "abs(n_qqe - r.qqe)", _span(14))
    mid = "((p.high + p.low) / 2)"
    r.state("prev_close", "p.close", "p.close")
    r.state("fu", "NULL::DOUBLE", f"""CASE WHEN r.fu IS NULL OR {mid} + 3 * n_atr10 < r.fu OR r.prev_close > r.fu
        THEN {mid} + 3 * n_atr10 ELSE r.fu END""")
    r.state("fl", "NULL::DOUBLE", f"""CASE WHEN r.fl IS NULL OR {mid} - 3 * n_atr10 > r.fl OR r.prev_close < r.fl
        THEN {mid} - 3 * n_atr10 ELSE r.fl END""")
    r.state("supertrend", "1.0::DOUBLE",
            "CASE WHEN p.close > r.fu THEN 1.0 WHEN p.close < r.fl THEN -1.0 ELSE r.supertrend END")
    # parabolic SAR
    r.state("bull", "true", "CASE WHEN r.bull THEN NOT (p.low < r.sar + r.af * (r.ep - r.sar)) ELSE p.high > r.sar + r.af * (r.ep - r.sar) END")
    r.state("sar", "p.low", "CASE WHEN n_bull <> r.bull THEN r.ep ELSE r.sar + r.af * (r.ep - r.sar) END")
    r.state("ep", "p.high", """CASE WHEN n_bull <> r.bull THEN CASE WHEN n_bull THEN p.high ELSE p.low END
        WHEN r.bull THEN greatest(r.ep, p.high) ELSE least(r.ep, p.low) END""")
    r.state("af", "0.02::DOUBLE", """CASE WHEN n_bull <> r.bull THEN 0.02
        WHEN (r.bull AND p.high > r.ep) OR (NOT r.bull AND p.low < r.ep) THEN least(r.af + 0.02, 0.2::DOUBLE) ELSE r.af END""")
    # Laguerre filter
    r.state("la", "0.0::DOUBLE", "0.3 * p.close + 0.7 * r.la")
    r.state("lb", "0.0::DOUBLE", "-0.7 * n_la + r.la + 0.7 * r.lb")
    r.state("lc", "0.0::DOUBLE", "-0.7 * n_lb + r.lb + 0.7 * r.lc")
    r.state("ld", "0.0::DOUBLE", "-0.7 * n_lc + r.lc + 0.7 * r.ld")
    r.state("laguerre", "NULL::DOUBLE", """CASE WHEN n_la > n_lb AND n_lb > n_lc AND n_lc > n_ld THEN 100.0
        WHEN n_la < n_lb AND n_lb < n_lc AND n_lc < n_ld THEN 0.0 ELSE r.laguerre END""")
    line = f"""cyc AS (
  SELECT series_id, bar_idx, coalesce(100 * (m - lo) / nullif(hi - lo, 0), 50) AS st FROM (
    SELECT series_id, bar_idx, m, {roll('min', 'm', 10)} AS lo, {roll('max', 'm', 10)} AS hi
    FROM (SELECT series_id, bar_idx, ema23 - ema50 AS m FROM rec)))"""
    s = Recurrence("sch", "cyc")
    s.ewm("s1", "p.st", "p.st", _span(3))
    s.ewm("schaff", "p.st", "n_s1", _span(3))
    out = f"""rin AS (
  SELECT rec.series_id, rec.bar_idx, rsi, atr14 AS atr, {roll('avg', 'rec.atr14', 20).replace('PARTITION BY series_id ORDER BY bar_idx', 'PARTITION BY rec.series_id ORDER BY rec.bar_idx')} AS atr_ma,
    di_plus, di_minus, adx, ema12 - ema26 AS macd, macd_signal, dmax / dsum AS demarker,
    ema20 + 1.5 * atr20 AS keltner_upper, ema20 - 1.5 * atr20 AS keltner_lower, wave_trend,
    {roll('avg', 'rec.wave_trend', 4).replace('PARTITION BY series_id ORDER BY bar_idx', 'PARTITION BY rec.series_id ORDER BY rec.bar_idx')} AS wave_trend_ma,
    schaff, qqe, qqe + 4.236 * qqe_dev AS qqe_upper, qqe - 4.236 * qqe_dev AS qqe_lower, supertrend,
    CASE WHEN rec.bar_idx > 0 THEN sar END AS psar, laguerre
  FROM rec JOIN sch ON rec.series_id = sch.series_id AND rec.bar_idx = sch.bar_idx)"""
    return ",\n".join([r.sql(), line, s.sql(), out])


RECURSIVE_WITH = f"WITH RECURSIVE {bars_sql()},\n{PREPARED},\n{recursions()}"


def condition_input_sql() -> str:
    """CTE chain ending in ``cin``: every column the catalogue reads."""
    from tickloom.functions.conditions import RECURSIVE_INPUTS, RECURSIVE_LAGS, WINDOW_LAGS

    rec = ", ".join(f"rin.{c}" for c in RECURSIVE_INPUTS)
    lags = ", ".join(f"{lag(c, k)} AS {c}_lag{k}" for c, k in (*WINDOW_LAGS, *RECURSIVE_LAGS))
    ups = ", ".join(
        f"sum(up) OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS up{n}"
        for n in (3, 4)
    )
    return f"""{RECURSIVE_WITH},
{WINDOWED},
cin AS (SELECT *, {lags}, {ups} FROM (
  SELECT win.*, CASE WHEN close > pc THEN 1 ELSE 0 END AS up, {rec}
  FROM win JOIN rin ON win.series_id = rin.series_id AND win.bar_idx = rin.bar_idx))"""


# the catalogue in plain SQL, in catalogue order
CONDITION_SQL = {
    "supertrend_down": "supertrend < 0",
    "psar_above_close": "psar > close",
    "close_below_sma20": "close < sma20",
    "sma20_falling": "sma20 - sma20_lag1 < 0",
    "aroon_down_high": "aroon_down > 70",
    "aroon_down_rising_from_low": "aroon_down > aroon_down_lag3 AND aroon_down_lag3 < 30",
    "aroon_up_falling_from_high": "aroon_up < aroon_up_lag3 AND aroon_up_lag3 > 70",
    "close_at_20_bar_low": "close <= low20",
    "adx_above_25": "adx > 25",
    "adx_below_20": "adx < 20",
    "adx_rising": "adx > adx_lag3",
    "di_minus_above_plus": "di_minus > di_plus",
    "di_minus_rising": "di_minus > di_minus_lag3",
    "adx_25_and_di_minus": "adx > 25 AND di_minus > di_plus",
    "below_sma20_and_adx_25": "close < sma20 AND adx > 25",
    "rsi_falling": "rsi < rsi_lag1",
    "rsi_below_30": "rsi < 30",
    "rsi_30_to_50": "rsi >= 30 AND rsi < 50",
    "macd_cross_below_zero": "macd < 0 AND macd_lag1 >= 0",
    "macd_below_zero": "macd < 0",
    "macd_signal_falling": "macd_signal < macd_signal_lag1",
    "stoch_d_cross_down": "stoch_d < stoch_k AND stoch_d_lag1 >= stoch_k_lag1",
    "williams_falling": "williams < williams_lag1",
    "cci_turns_down": "cci < cci_lag1 AND cci_lag1 > 0",
    "demarker_above_07": "demarker > 0.7",
    "laguerre_falling": "laguerre < laguerre_lag1",
    "qqe_falling": "qqe < qqe_lag1",
    "schaff_cross_below_50": "schaff < 50 AND schaff_lag1 >= 50",
    "wave_trend_falling": "wave_trend < wave_trend_lag1",
    "atr_rising": "atr > atr_lag3",
    "atr_above_mean": "atr > atr_ma",
    "bb_upper_falling": "bb_upper < bb_upper_lag1",
    "bb_lower_falling": "bb_lower < bb_lower_lag1",
    "bandwidth_above_mean": "bandwidth > bandwidth_ma",
    "ulcer_above_mean": "ulcer > ulcer_ma",
    "volume_rising": "volume > volume_lag1",
    "volume_above_mean": "volume > volume_ma",
    "volume_above_150pct": "volume > 1.5 * volume_ma",
    "close_below_vwap": "close < vwap",
    "vwap_falling": "vwap < vwap_lag3",
    "below_falling_vwap": "close < vwap AND vwap < vwap_lag3",
    "doji": "close - low < 0.25 * (high - low) AND high - close < 0.25 * (high - low)",
    "shooting_star": "high - close > 0.6 * (high - low)",
    "bearish_engulfing": "close < open AND close_lag1 > open_lag1 AND close < open_lag1 AND open > close_lag1",
    "dark_cloud": "close_lag1 > open_lag1 AND open > close_lag1 AND close < (close_lag1 + open_lag1) / 2",
    "gap_above_prev_high": "open > high_lag1",
    "rsi_above_70": "rsi > 70",
    "rsi_above_75": "rsi > 75",
    "stoch_k_above_90": "stoch_k > 90",
    "williams_above_minus10": "williams > -10",
    "cci_above_150": "cci > 150",
    "demarker_above_08": "demarker > 0.8",
    "close_above_bb_upper": "close > bb_upper",
    "close_2atr_above_sma20": "close > sma20 + 2 * atr",
    "close_15atr_above_vwap": "close > vwap + 1.5 * atr",
    "three_up_bars": "up3 = 3",
    "four_up_bars": "up4 = 4",
    "ret8_above_1pct": "close / nullif(close_lag8, 0) - 1 > 0.01",
    "ret24_above_2pct": "close / nullif(close_lag24, 0) - 1 > 0.02",
    "close_below_keltner": "close < keltner_lower",
    "keltner_upper_falling": "keltner_upper < keltner_upper_lag1",
}
