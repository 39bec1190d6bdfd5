"""Registered queries: levels, entries, outcomes, the level matrix and its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import levels as lv
from tickloom.operators import mining as mn
from tickloom.operators import trades as tr
from tickloom.operators.blocks import index_bars
from tickloom.operators.outcomes import (
    MAIN, MATRIX_RULES, SCHEMES, TRAILS, ExitRule, one_at_a_time, outcomes, with_outcomes,
)
from tickloom.plans.common import DAILY, SMALL_BLOCKS, bars_sql, daily_bars, hourly_bars, r6, rnd, rounded
from tickloom.plans.oracle_levels import LEVEL_CTES, atr_sql, entries_sql, outcome_sql
from tickloom.plans.oracle_indicators import PREPARED
from tickloom.session import materialise

MIN_N = 15
MAIN_RULE = [r for r in MATRIX_RULES if r.name == MAIN]


def day_context(spark, sf):
    return lv.day_context(hourly_bars(spark, sf))


def level_rows(spark, sf):
    return rounded(lv.level_rows(lv.prepare(hourly_bars(spark, sf))))


def level_entries(spark, sf):
    e = mn.cell_entries(lv.prepare(hourly_bars(spark, sf)))
    return e.select("series_id", "level", "trigger", "entry_idx", "entry_ts", "entry_price",
                    r6("atr").alias("atr"), "is_sample")


def _cell_trades(spark, sf, rules=MATRIX_RULES):
    bars = hourly_bars(spark, sf)
    return with_outcomes(index_bars(bars), mn.cell_entries(lv.prepare(bars)), rules, store=True).withColumn("r", F.col(MAIN))


def trade_outcomes(spark, sf):
    bars = hourly_bars(spark, sf)
    return rounded(outcomes(index_bars(bars), mn.cell_entries(lv.prepare(bars)), [*MATRIX_RULES, *SCHEMES]))


def daily_outcomes(spark, sf):
    """Every daily bar as a long and a short entry under six rules with shorter holds."""
    from tickloom.functions.recursive import recursive_indicators

    ix = index_bars(daily_bars(spark, sf), "year")
    e = recursive_indicators(ix, ["atr"], keep=("ts", "close", "n_bars")).select(
        "series_id", F.col("bar_idx").alias("entry_idx"), F.col("close").alias("entry_price"), "atr")
    return rounded(outcomes(ix, e, DAILY_RULES))


DAILY_RULES = (
    ExitRule("short_fixed_1_1", stop=1.0, target=1.0, hold=10), ExitRule("long_fixed_1_1", long=True, stop=1.0, target=1.0, hold=10),
    ExitRule("short_trail_1", stop=1.5, trail=1.0, hold=5), ExitRule("long_trail_1", long=True, stop=1.5, trail=1.0, hold=5),
    ExitRule("short_both", stop=2.0, target=1.5, trail=1.0, hold=15), ExitRule("long_both", long=True, stop=2.0, target=1.5, trail=1.0, hold=15),
)


def level_matrix(spark, sf):
    return rounded(mn.mine(hourly_bars(spark, sf), min_n=MIN_N))


def level_matrix_blocks(spark, sf):
    """The matrix over series cut into small blocks."""
    return rounded(mn.mine(hourly_bars(spark, sf), min_n=MIN_N, **SMALL_BLOCKS))


def gated_matrix(spark, sf):
    g = mn.apply_gates(mn.mine(hourly_bars(spark, sf), min_n=MIN_N), min_n=20)
    return g.select("series_id", "level", "trigger", "n", r6("excess").alias("excess"),
                    F.array_join("gates", ",").alias("gates"), "n_gates")


def naive_baseline(spark, sf):
    return rounded(mn.naive_baseline(hourly_bars(spark, sf)))


def _window_trades(spark, sf, windows):
    bars = hourly_bars(spark, sf)
    e = mn.window_entries(lv.prepare(bars), windows)
    return with_outcomes(index_bars(bars), e, MAIN_RULE, store=True).withColumn("r", F.col(MAIN))


def window_scan(spark, sf):
    return rounded(mn.scan_windows(_window_trades(spark, sf, mn.DEFAULT_WINDOWS), min_n=MIN_N))


def hour_zero_effect(spark, sf):
    t = _window_trades(spark, sf, (("24h", None), ("1-23", (1, 23))))
    return rounded(mn.hour_effect(mn.scan_windows(t, min_n=MIN_N), "24h", "1-23"))


def entry_hour_profile(spark, sf):
    bars = hourly_bars(spark, sf)
    e = mn.cell_entries(lv.prepare(bars), None)
    t = with_outcomes(index_bars(bars), e, MAIN_RULE, store=True).withColumn("r", F.col(MAIN))
    return rounded(tr.entry_hours(t, mn.CELL))


def _setup_trades(spark, sf):
    bars = hourly_bars(spark, sf)
    fired = lv.fired_signals(lv.prepare(bars), lv.setup_columns())
    e = lv.first_per_day(fired, ["signal"], check_atr=False).filter(F.hour("entry_ts").between(12, 20))
    e = e.withColumn("is_sample", F.col("entry_idx") <= F.floor((F.col("n_bars") - 1) * F.lit(0.6)))
    return with_outcomes(index_bars(bars), e, SCHEMES, store=True)


def named_setups(spark, sf):
    return rounded(_setup_trades(spark, sf).select(
        "series_id", "signal", "entry_idx", "entry_ts", "is_sample", "fixed", "trailed"))


def setup_verdicts(spark, sf):
    t = _setup_trades(spark, sf).withColumn("r", F.col("trailed"))
    return rounded(tr.verdicts(tr.sample_means(t, ["series_id", "signal"]), min_n=5, small_n=10, full_n=15))


def scheme_comparison(spark, sf):
    long = _setup_trades(spark, sf).unpivot(
        ["series_id", "signal", "entry_idx"], ["fixed", "trailed"], "rule", "r")
    return rounded(tr.scheme_table(long, ["series_id", "signal"], ["fixed", "trailed"]))


LONG_SCHEMES = (ExitRule("short_r", trail=1.5), ExitRule("long_r", long=True, trail=1.5), ExitRule("slpt_r", long=True, target=2.0))


def declared_signals(spark, sf):
    """The twelve declared signals, one entry per day, each under its own direction and exit scheme."""
    bars = hourly_bars(spark, sf)
    fired = lv.fired_signals(lv.prepare(bars, oscillators=True), lv.declared_columns())
    t = with_outcomes(index_bars(bars), lv.first_per_day(fired, ["signal"]), LONG_SCHEMES, store=True)
    s = F.col("signal")
    r = (F.when(s.startswith("short"), F.col("short_r"))
         .when(s.isin("long_rsi_above_70", "long_cci_above_150"), F.col("slpt_r")).otherwise(F.col("long_r")))
    return rounded(t.withColumn("r", r).groupBy("series_id", "signal").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean_r"), (100 * F.avg((F.col("r") > 0).cast("int"))).alias("win_pct")))


def single_position(spark, sf):
    """Every bar under its day's VWAP, but never two open trades at once."""
    p = lv.prepare(hourly_bars(spark, sf))
    fired = p.filter(lv.trigger(F.col("vwap"), "close_below")).select("series_id", F.col("bar_idx").alias("entry_idx"))
    return one_at_a_time(fired, [], hold=24)


def matrix_trade_stats(spark, sf):
    t = materialise(_cell_trades(spark, sf, MAIN_RULE))
    return rounded(tr.trade_stats(t, mn.CELL).drop("wins"))


def matrix_years(spark, sf):
    y = tr.year_stats(_cell_trades(spark, sf, MAIN_RULE), mn.CELL)
    return rounded(y.drop("yearly"))


def matrix_concentration(spark, sf):
    return rounded(tr.concentration(materialise(_cell_trades(spark, sf, MAIN_RULE)), mn.CELL))


_LV = f"WITH RECURSIVE {LEVEL_CTES}"
_ENT = f"{_LV},\n{entries_sql('ent', 'trg', 'level, trigger', 'hr BETWEEN 12 AND 20')}"
_OUT = f"{_ENT},\n{outcome_sql('outc', 'ent', [*MATRIX_RULES, *SCHEMES])}"
_NAMES = [f"trail_{t}".replace(".", "") for t in TRAILS]
_TRD = f"{_OUT},\ntrd AS (SELECT ent.*, outc.* EXCLUDE (series_id, entry_idx), {MAIN} AS r FROM ent JOIN outc ON outc.series_id = ent.series_id AND outc.entry_idx = ent.entry_idx)"
_EQ = """eq1 AS (SELECT *, sum(r) OVER (PARTITION BY series_id, level, trigger ORDER BY entry_idx) AS eq FROM trd),
eq2 AS (SELECT *, eq - greatest(0, max(eq) OVER (PARTITION BY series_id, level, trigger ORDER BY entry_idx)) AS dd FROM eq1),
mdd AS (SELECT series_id, level, trigger, least(0, min(dd)) AS max_dd FROM eq2 GROUP BY 1, 2, 3)"""
_YEARS = """ys AS (SELECT series_id, level, trigger, year(entry_ts) AS y, sum(r) AS yr FROM trd GROUP BY 1, 2, 3, 4),
yrs AS (SELECT series_id, level, trigger, sum((yr > 0)::INT)::BIGINT AS positive_years, count(*) AS years,
  CASE WHEN sum(yr) <> 0 THEN 100 * max(yr) / sum(yr) END AS best_year_share_pct FROM ys GROUP BY 1, 2, 3)"""
_PARTS = f"""parts AS (
  SELECT 'all' AS part, * FROM idx UNION ALL SELECT CASE WHEN bar_idx <= floor(n_bars * 0.6) THEN 'is' ELSE 'oos' END, * FROM idx),
pidx AS (SELECT series_id || '#' || part AS series_id, part, ts, high, low, close, hr, day,
    row_number() OVER (PARTITION BY series_id, part ORDER BY ts) - 1 AS bar_idx,
    count(*) OVER (PARTITION BY series_id, part) AS n_bars FROM parts),
ppre AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM pidx WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx)),
{atr_sql('pra', 'ppre')},
pb AS (SELECT ppre.*, pra.atr FROM ppre JOIN pra ON pra.series_id = ppre.series_id AND pra.bar_idx = ppre.bar_idx),
{entries_sql('pent', 'pb', 'part', 'hr BETWEEN 12 AND 20')},
{outcome_sql('pout', 'pent', MATRIX_RULES, 'pidx')},
base AS (SELECT split_part(pent.series_id, '#', 1) AS series_id, sum((part = 'all')::INT)::BIGINT AS n_base,
    avg({MAIN}) FILTER (part = 'all') AS r_base, avg(mirror) FILTER (part = 'all') AS mirror_base,
    avg({MAIN}) FILTER (part = 'is') AS is_base, avg({MAIN}) FILTER (part = 'oos') AS oos_base
  FROM pent JOIN pout ON pout.series_id = pent.series_id AND pout.entry_idx = pent.entry_idx GROUP BY 1)"""
_MATRIX = f"""{_TRD},
{_EQ},
{_YEARS},
{_PARTS},
cells AS (SELECT series_id, level, trigger, count(*) AS n,
    count(*) / nullif(date_diff('day', min(entry_ts)::DATE, max(entry_ts)::DATE) / 365.25::DOUBLE, 0) AS per_year,
    100 * avg((r > 0)::INT) AS win_pct, avg(r) AS r_short, avg(r) FILTER (is_sample) AS is_r,
    avg(r) FILTER (NOT is_sample) AS oos_r, {' + '.join(f'(avg({n}) > 0)::INT' for n in _NAMES)} AS trails_positive,
    avg(mirror) AS r_mirror FROM trd GROUP BY 1, 2, 3 HAVING count(*) >= {MIN_N}),
mtx AS (SELECT cells.*, max_dd, positive_years, years, best_year_share_pct, n_base, r_base, mirror_base, is_base, oos_base,
    r_short - r_base AS excess, is_r - is_base AS excess_is, oos_r - oos_base AS excess_oos, r_mirror - mirror_base AS mirror_vs_base
  FROM cells JOIN mdd USING (series_id, level, trigger) JOIN yrs USING (series_id, level, trigger) LEFT JOIN base USING (series_id))"""
_MCOLS = ("per_year", "win_pct", "r_short", "is_r", "oos_r", "r_mirror", "max_dd", "best_year_share_pct", "r_base",
          "mirror_base", "is_base", "oos_base", "excess", "excess_is", "excess_oos", "mirror_vs_base")


def _window_sql(windows) -> str:
    rows = ", ".join(f"('{n}', {w[0] if w else 0}, {w[1] if w else 23})" for n, w in windows)
    return f"""{_LV},
wn(win, a, z) AS (VALUES {rows}),
wtrg AS (SELECT * FROM trg JOIN wn ON hr BETWEEN a AND z),
{entries_sql('ent', 'wtrg', 'level, trigger, win')},
{outcome_sql('outc', 'ent', MAIN_RULE)},
scan AS (SELECT ent.series_id, level, trigger, win AS "window", count(*) AS n, 100 * avg(({MAIN} > 0)::INT) AS win_pct,
    avg({MAIN}) AS r_per_trade, avg({MAIN}) FILTER (is_sample) AS is_r, avg({MAIN}) FILTER (NOT is_sample) AS oos_r
  FROM ent JOIN outc ON outc.series_id = ent.series_id AND outc.entry_idx = ent.entry_idx
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= {MIN_N})"""


_SETUPS = f"""{_LV},
fired AS (
  SELECT *, 'orb_breakdown' AS signal FROM lv WHERE hr BETWEEN 14 AND 20 AND close < range_low
  UNION ALL SELECT *, 'gap_up_fade' FROM lv WHERE hr = 13 AND open > prev_day_high
  UNION ALL SELECT *, 'prev_day_low_breakdown' FROM lv WHERE hr BETWEEN 13 AND 20 AND close < prev_day_low
  UNION ALL SELECT *, 'nr7_orb_breakdown' FROM lv WHERE hr BETWEEN 14 AND 20 AND nr7 AND close < range_low
  UNION ALL SELECT *, 'vwap_rejection' FROM lv WHERE hr BETWEEN 13 AND 20 AND c1 > vwap AND close < vwap AND vwap_slope < 0),
{entries_sql('ent', 'fired', 'signal', atr_test='true', split='floor((n_bars - 1) * 0.6)')},
{outcome_sql('outc', 'ent', SCHEMES)},
trd AS (SELECT ent.*, fixed, trailed, trailed AS r FROM ent JOIN outc ON outc.series_id = ent.series_id AND outc.entry_idx = ent.entry_idx)"""

_DECLARED = f"""{_LV},
g AS (SELECT series_id, bar_idx, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM pre),
rs AS (SELECT series_id, bar_idx, NULL::DOUBLE AS u, NULL::DOUBLE AS d FROM g WHERE bar_idx = 0
  UNION ALL SELECT g.series_id, g.bar_idx, coalesce(r.u + (g.up - r.u) / 14, g.up), coalesce(r.d + (g.dn - r.d) / 14, g.dn)
  FROM rs r JOIN g ON g.series_id = r.series_id AND g.bar_idx = r.bar_idx + 1),
cc1 AS (SELECT series_id, bar_idx, tp, avg(tp) OVER w AS m, count(*) OVER w AS n FROM pre
  WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
cc2 AS (SELECT series_id, bar_idx, tp, m, abs(tp - CASE WHEN n = 20 THEN m END) AS dev FROM cc1),
cc AS (SELECT series_id, bar_idx, CASE WHEN count(dev) OVER w = 20 THEN (tp - m) / (0.015 * nullif(avg(dev) OVER w, 0)) END AS cci
  FROM cc2 WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
osc AS (SELECT lv.*, 100 - 100 / (1 + u / nullif(d, 0)) AS rsi, cci FROM lv
  JOIN rs ON rs.series_id = lv.series_id AND rs.bar_idx = lv.bar_idx JOIN cc ON cc.series_id = lv.series_id AND cc.bar_idx = lv.bar_idx),
fired AS (
  {' UNION ALL '.join(f"SELECT *, '{n}' AS signal FROM osc WHERE {c}" for n, c in {
      'short_overnight_low_cross': 'c1 >= overnight_low AND close < overnight_low',
      'short_prev_day_close': 'close < prev_day_close',
      'short_prev_week_high_cross': 'c1 >= prev_week_high AND close < prev_week_high',
      'short_overnight_high_cross': 'c1 >= overnight_high AND close < overnight_high',
      'short_overnight_high_close': 'close < overnight_high',
      'long_overnight_low_cross': 'c1 <= overnight_low AND close > overnight_low',
      'long_prev_day_close': 'close > prev_day_close',
      'long_prev_week_high_cross': 'c1 <= prev_week_high AND close > prev_week_high',
      'long_overnight_high_cross': 'c1 <= overnight_high AND close > overnight_high',
      'long_overnight_high_close': 'close > overnight_high',
      'long_rsi_above_70': 'rsi > 70', 'long_cci_above_150': 'cci > 150'}.items())}),
{entries_sql('ent', 'fired', 'signal')},
{outcome_sql('outc', 'ent', LONG_SCHEMES)},
trd AS (SELECT ent.*, CASE WHEN signal LIKE 'short%' THEN short_r WHEN signal IN ('long_rsi_above_70', 'long_cci_above_150')
    THEN slpt_r ELSE long_r END AS r FROM ent JOIN outc ON outc.series_id = ent.series_id AND outc.entry_idx = ent.entry_idx)"""

_MATRIX_SQL = f"""{_MATRIX}
SELECT series_id, level, trigger, n, trails_positive, positive_years, years, n_base,
  {', '.join(f'{rnd(c)} AS {c}' for c in _MCOLS)} FROM mtx"""

QUERIES = {
    "day_context": (day_context, f"""{_LV}
SELECT d3.series_id, d3.day, s.orb_low, s.orb_high, s.ib_low, s.ib_high, s.so AS session_open,
  s.ovl AS overnight_low, s.ovh AS overnight_high, pdl AS prev_day_low, pdh AS prev_day_high, pdc AS prev_day_close,
  pwl AS prev_week_low, pwh AS prev_week_high, nr7, rl AS last13_low, rh AS last13_high
FROM d3 LEFT JOIN sess s ON s.series_id = d3.series_id AND s.skey = d3.day
LEFT JOIN w2 ON w2.series_id = d3.series_id AND w2.wk = date_trunc('week', d3.day)::DATE
LEFT JOIN o13 ON o13.series_id = d3.series_id AND o13.day = d3.day"""),
    "level_rows": (level_rows, f"{_LV} SELECT series_id, bar_idx, ts, level, {rnd('value')} AS value FROM lvl"),
    "level_entries": (level_entries, f"""{_ENT}
SELECT series_id, level, trigger, entry_idx, entry_ts, entry_price, {rnd('atr')} AS atr, is_sample FROM ent"""),
    "trade_outcomes": (trade_outcomes, f"""{_OUT}
SELECT series_id, entry_idx, rule, {rnd('r')} AS r FROM (UNPIVOT outc ON COLUMNS(* EXCLUDE (series_id, entry_idx)) INTO NAME rule VALUE r)"""),
    "daily_outcomes": (daily_outcomes, f"""WITH RECURSIVE {bars_sql(DAILY)},
{PREPARED},
{atr_sql()},
ent AS (SELECT pre.series_id, pre.bar_idx AS entry_idx, close AS entry_price, atr FROM pre
  JOIN ra ON ra.series_id = pre.series_id AND ra.bar_idx = pre.bar_idx WHERE atr > 1e-9),
{outcome_sql('outc', 'ent', DAILY_RULES)}
SELECT series_id, entry_idx, rule, {rnd('r')} AS r FROM (UNPIVOT outc ON COLUMNS(* EXCLUDE (series_id, entry_idx)) INTO NAME rule VALUE r)"""),
    "level_matrix": (level_matrix, _MATRIX_SQL),
    "level_matrix_blocks": (level_matrix_blocks, _MATRIX_SQL),
    "gated_matrix": (gated_matrix, f"""{_MATRIX},
gt AS (SELECT *, list_filter([CASE WHEN n >= 20 THEN 'sample' END, CASE WHEN excess > 0 THEN 'beats_naive' END,
  CASE WHEN excess_is > 0 AND excess_oos > 0 THEN 'both_halves' END, CASE WHEN trails_positive >= 3 THEN 'stable' END,
  CASE WHEN mirror_vs_base <= 0 THEN 'directional' END], lambda x: x IS NOT NULL) AS g FROM mtx)
SELECT series_id, level, trigger, n, {rnd('excess')} AS excess, array_to_string(g, ',') AS gates, len(g)::INT AS n_gates FROM gt"""),
    "naive_baseline": (naive_baseline, f"""WITH RECURSIVE {bars_sql()},
{_PARTS}
SELECT series_id, n_base, {rnd('r_base')} AS r_base, {rnd('mirror_base')} AS mirror_base,
  {rnd('is_base')} AS is_base, {rnd('oos_base')} AS oos_base FROM base"""),
    "window_scan": (window_scan, f"""{_window_sql(mn.DEFAULT_WINDOWS)}
SELECT series_id, level, trigger, "window", n, {rnd('win_pct')} AS win_pct, {rnd('r_per_trade')} AS r_per_trade,
  {rnd('is_r')} AS is_r, {rnd('oos_r')} AS oos_r, coalesce(is_r > 0 AND oos_r > 0, false) AS eligible FROM scan"""),
    "hour_zero_effect": (hour_zero_effect, f"""{_window_sql((('24h', None), ('1-23', (1, 23))))}
SELECT a.series_id, a.level, a.trigger, a.n AS n_with, b.n AS n_without, {rnd('a.r_per_trade')} AS r_with,
  {rnd('b.r_per_trade')} AS r_without, {rnd('b.r_per_trade - a.r_per_trade')} AS effect
FROM scan a JOIN scan b ON a.series_id = b.series_id AND a.level = b.level AND a.trigger = b.trigger
WHERE a."window" = '24h' AND b."window" = '1-23'"""),
    "entry_hour_profile": (entry_hour_profile, f"""{_LV},
{entries_sql('ent', 'trg', 'level, trigger')},
{outcome_sql('outc', 'ent', MAIN_RULE)},
p AS (SELECT ent.series_id, level, trigger, hour(entry_ts) AS hour, count(*) AS n, avg({MAIN}) AS m, sum({MAIN}) AS s,
    bool_and({MAIN} > 0) OR bool_and({MAIN} < 0) AS all_or_nothing
  FROM ent JOIN outc ON outc.series_id = ent.series_id AND outc.entry_idx = ent.entry_idx GROUP BY 1, 2, 3, 4)
SELECT series_id, level, trigger, hour, n, {rnd('m')} AS r_per_trade, {rnd('s')} AS r_sum, all_or_nothing,
  {rnd('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY series_id, level, trigger)')} AS share_pct FROM p"""),
    "named_setups": (named_setups, f"""{_SETUPS}
SELECT series_id, signal, entry_idx, entry_ts, is_sample, {rnd('fixed')} AS fixed, {rnd('trailed')} AS trailed FROM trd
WHERE hour(entry_ts) BETWEEN 12 AND 20"""),
    "setup_verdicts": (setup_verdicts, f"""{_SETUPS},
m AS (SELECT series_id, signal, count(*) AS n, avg(r) AS mean_r, stddev_samp(r) AS std_r, avg((r > 0)::INT) AS win_rate,
    avg(r) FILTER (is_sample) AS a, avg(r) FILTER (NOT is_sample) AS b FROM trd GROUP BY 1, 2)
SELECT series_id, signal, n, {rnd('mean_r')} AS mean_r, {rnd('std_r')} AS std_r, {rnd('win_rate')} AS win_rate,
  {rnd('a')} AS is_r, {rnd('b')} AS oos_r,
  CASE WHEN n < 5 THEN 'rejected' WHEN a > 0 AND b > 0 AND n >= 15 AND a > 0.03 THEN 'fit'
    WHEN a > 0 AND b > 0 THEN 'marginal' ELSE 'unfit' END AS verdict,
  CASE WHEN n < 5 THEN 'insufficient_sample' ELSE array_to_string(list_filter([
    CASE WHEN n < 10 THEN 'small_sample' END, CASE WHEN b <= 0 THEN 'fails_out_of_sample' END,
    CASE WHEN a <= 0.03 THEN 'weak_in_sample' END,
    CASE WHEN abs(a - b) > 2 * greatest(abs(a), abs(b), 1e-9) THEN 'halves_differ' END,
    CASE WHEN std_r > 2 THEN 'high_variance' END], lambda x: x IS NOT NULL), '; ') END AS risks
FROM m"""),
    "scheme_comparison": (scheme_comparison, f"""{_SETUPS}
SELECT series_id, signal, count(*) AS n, {rnd('avg(fixed)')} AS fixed_r, {rnd('100 * avg((fixed > 0)::INT)')} AS fixed_win_pct,
  {rnd('avg(trailed)')} AS trailed_r, {rnd('100 * avg((trailed > 0)::INT)')} AS trailed_win_pct FROM trd GROUP BY 1, 2"""),
    "declared_signals": (declared_signals, f"""{_DECLARED}
SELECT series_id, signal, count(*) AS n, {rnd('avg(r)')} AS mean_r, {rnd('100 * avg((r > 0)::INT)')} AS win_pct
FROM trd GROUP BY 1, 2"""),
    "single_position": (single_position, f"""WITH RECURSIVE {bars_sql()},
{PREPARED},
f AS (SELECT series_id, bar_idx FROM pre WHERE close < vwap),
pick AS (SELECT series_id, min(bar_idx) AS entry_idx FROM f GROUP BY 1
  UNION ALL SELECT p.series_id, (SELECT min(bar_idx) FROM f WHERE f.series_id = p.series_id AND f.bar_idx > p.entry_idx + 24)
  FROM pick p WHERE EXISTS (SELECT 1 FROM f WHERE f.series_id = p.series_id AND f.bar_idx > p.entry_idx + 24))
SELECT series_id, entry_idx FROM pick"""),
    "matrix_trade_stats": (matrix_trade_stats, f"""{_TRD},
{_EQ},
g AS (SELECT series_id, level, trigger, count(r)::DOUBLE AS n, sum((r > 0)::INT)::DOUBLE AS w, avg(r) AS m, sum(r) AS t, stddev_samp(r) AS sd,
    coalesce(avg(r) FILTER (r > 0), 0) AS aw, coalesce(avg(r) FILTER (r <= 0), 0) AS al, max(r) AS b, min(r) AS wo, median(r) AS med
  FROM trd GROUP BY 1, 2, 3)
SELECT series_id, level, trigger, n::BIGINT AS n, {rnd('m')} AS r_per_trade, {rnd('t')} AS r_total, {rnd('sd')} AS r_std,
  {rnd('aw')} AS avg_win, {rnd('al')} AS avg_loss, {rnd('b')} AS best, {rnd('wo')} AS worst, {rnd('100 * w / n')} AS win_pct,
  {rnd('100 * greatest(0, (w / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(w / n * (1 - w / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n))')} AS win_pct_lo,
  {rnd('100 * least(1, (w / n + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(w / n * (1 - w / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n))')} AS win_pct_hi,
  {rnd('med')} AS r_median, {rnd('max_dd')} AS max_dd, {rnd('t / abs(nullif(max_dd, 0))')} AS recovery_factor
FROM g JOIN mdd USING (series_id, level, trigger)"""),
    "matrix_years": (matrix_years, f"""{_TRD},
{_YEARS}
SELECT series_id, level, trigger, positive_years, years, {rnd('best_year_share_pct')} AS best_year_share_pct FROM yrs"""),
    "matrix_concentration": (matrix_concentration, f"""{_TRD},
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, level, trigger ORDER BY r DESC) AS k,
  count(*) OVER (PARTITION BY series_id, level, trigger) AS n FROM trd)
SELECT series_id, level, trigger, count(*) AS n,
  {rnd('CASE WHEN sum(r) > 0 THEN 100 * sum(r) FILTER (k <= 5) / sum(r) END')} AS top5_share_pct,
  {rnd('CASE WHEN sum(r) > 0 THEN 100 * sum(r) FILTER (k <= greatest(1, n // 20)) / sum(r) END')} AS top5pct_share_pct
FROM k GROUP BY 1, 2, 3"""),
}
