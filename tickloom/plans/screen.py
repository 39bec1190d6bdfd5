"""Registered queries: forward-return statistics and hour tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.indicators import with_basics
from tickloom.operators import screen as ops
from tickloom.operators.blocks import index_bars, own_rows, to_blocks
from tickloom.plans.common import SMALL_BLOCKS, bars_sql, hourly_bars, lag, p_value_sql, r6, rnd, roll, rounded
from tickloom.plans.indicators import atr_and_trend, condition_rows_sql

MIN_N = 30


def _basics(spark, sf):
    return own_rows(with_basics(to_blocks(index_bars(hourly_bars(spark, sf)), back=1)))


def newey_west(spark, sf):
    m = ops.signal_moments(hourly_bars(spark, sf))
    return m.filter(F.col("signal_id") >= 0).groupBy("series_id", "horizon", "scope").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("n").alias("n"),
        r6(F.sum("t_stat"), 4).alias("sum_t"), r6(F.max("t_stat"), 4).alias("max_t"),
    )


def baseline_drift(spark, sf):
    return rounded(ops.baseline_drift(ops.signal_moments(hourly_bars(spark, sf))))


def signal_screen(spark, sf):
    return rounded(ops.screen(hourly_bars(spark, sf), min_n=MIN_N), 5)


def signal_screen_blocks(spark, sf):
    """The screen over series cut into small blocks."""
    return rounded(ops.screen(hourly_bars(spark, sf), min_n=MIN_N, **SMALL_BLOCKS), 5)


def screen_highlights(spark, sf):
    top = ops.highlights(ops.screen(hourly_bars(spark, sf), min_n=MIN_N))
    return top.select("series_id", "highlight", "rank", "family", "signal", "horizon", "n",
                      r6("edge_pct", 5).alias("edge_pct"), r6("p_value", 5).alias("p_value"))


def false_positive_budget(spark, sf):
    return rounded(ops.false_positive_budget(ops.screen(hourly_bars(spark, sf), min_n=MIN_N)))


def hour_profile(spark, sf):
    return ops.hour_profile(_basics(spark, sf), min_n=25)


def hour_ranges(spark, sf):
    return rounded(ops.hour_ranges(_basics(spark, sf)))


def liquid_hours(spark, sf):
    return rounded(ops.liquid_hours(ops.hour_profile(_basics(spark, sf), min_n=25)))


def market_summary(spark, sf):
    return rounded(ops.market_summary(_basics(spark, sf)))


def session_shares(spark, sf):
    return rounded(ops.session_shares(_basics(spark, sf)))


def stop_distance(spark, sf):
    return rounded(ops.stop_distance(atr_and_trend(spark, sf)), 4)


_OBS = f"""{condition_rows_sql()},
h AS (SELECT unnest([4, 8, 24]) AS horizon),
fw AS (SELECT i.series_id, i.bar_idx, i.hr, h.horizon, f.close / nullif(i.close, 0) - 1 AS x
       FROM idx i, h, idx f WHERE f.series_id = i.series_id AND f.bar_idx = i.bar_idx + h.horizon),
cut AS (SELECT series_id, quantile_cont(epoch_us(ts), 0.6) AS cut FROM idx GROUP BY 1),
inw AS (SELECT s.series_id, s.family, s.signal, s.bar_idx, fw.horizon, fw.x, epoch_us(s.ts) <= cut.cut AS is_in
        FROM sig s JOIN fw ON fw.series_id = s.series_id AND fw.bar_idx = s.bar_idx
        JOIN cut ON cut.series_id = s.series_id WHERE s.hr BETWEEN 12 AND 20),
obs AS (SELECT *, 'all' AS scope FROM inw UNION ALL SELECT *, 'is' FROM inw WHERE is_in
        UNION ALL SELECT *, 'oos' FROM inw WHERE NOT is_in),
num AS (SELECT *, row_number() OVER g AS k, avg(x) OVER p AS m, count(*) OVER p AS n FROM obs
        WINDOW p AS (PARTITION BY series_id, signal, horizon, scope),
               g AS (PARTITION BY series_id, signal, horizon, scope ORDER BY bar_idx)),
lrv AS (SELECT a.series_id, a.family, a.signal, a.horizon, a.scope, any_value(a.n) AS n, any_value(a.m) AS m,
          sum((CASE WHEN a.k = b.k THEN 1.0 ELSE 2.0 END) * (1 - (a.k - b.k)::DOUBLE / a.horizon)
              * (a.x - a.m) * (b.x - b.m)) / any_value(a.n) AS s
        FROM num a JOIN num b ON a.series_id = b.series_id AND a.signal = b.signal AND a.horizon = b.horizon
          AND a.scope = b.scope AND b.k BETWEEN a.k - a.horizon + 1 AND a.k
        GROUP BY 1, 2, 3, 4, 5),
tst AS (SELECT *, CASE WHEN n < 3 OR s <= 1e-12 THEN 0.0 ELSE m / sqrt(s / n) END AS t FROM lrv)"""
_BASE = """base AS (SELECT series_id, horizon, count(*) AS n, avg(x) AS m,
  CASE WHEN count(*) < 3 THEN 0 ELSE avg(x) / sqrt(var_pop(x) / count(*)) END AS t
  FROM fw WHERE hr BETWEEN 12 AND 20 GROUP BY 1, 2)"""
_SCREEN = f"""{_OBS}, {_BASE},
wide AS (SELECT series_id, family, signal, horizon,
    max(n) FILTER (WHERE scope = 'all') AS n, max(100 * m) FILTER (WHERE scope = 'all') AS mean_fwd_pct,
    max(t) FILTER (WHERE scope = 'all') AS t_stat,
    max(100 * m) FILTER (WHERE scope = 'is' AND n >= 15) AS is_mean_pct,
    max(t) FILTER (WHERE scope = 'is' AND n >= 15) AS is_t,
    max(100 * m) FILTER (WHERE scope = 'oos' AND n >= 15) AS oos_mean_pct,
    max(t) FILTER (WHERE scope = 'oos' AND n >= 15) AS oos_t
  FROM tst GROUP BY 1, 2, 3, 4),
scr AS (SELECT w.series_id, family, signal, w.horizon, w.n, mean_fwd_pct, -mean_fwd_pct AS edge_pct, t_stat,
    {p_value_sql('t_stat')} AS p_value, {p_value_sql('t_stat')} < 0.05 AS significant,
    -mean_fwd_pct > 0 AS favourable, CASE WHEN b.n >= 10 THEN 100 * b.m END AS base_mean_pct,
    is_mean_pct, {p_value_sql('is_t')} AS is_p, oos_mean_pct, {p_value_sql('oos_t')} AS oos_p
  FROM wide w JOIN base b ON b.series_id = w.series_id AND b.horizon = w.horizon WHERE w.n >= {MIN_N})"""
_R5 = ", ".join(f"{rnd(c, 5)} AS {c}" for c in (
    "mean_fwd_pct", "edge_pct", "t_stat", "p_value", "base_mean_pct", "is_mean_pct", "is_p", "oos_mean_pct", "oos_p"))
_PRE = f"""WITH {bars_sql()},
b AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, (high - low) / nullif(close, 0) * 100 AS range_pct,
  abs(close - open) AS body, abs(close - open) / (high - low + 1e-10) * 100 AS body_pct,
  high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM idx)"""
_PROFILE = f"""{_PRE},
g AS (SELECT series_id, hr AS hour, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, avg(range_pct) AS rg
      FROM b GROUP BY 1, 2 HAVING count(ret) >= 25),
pt AS (SELECT *, coalesce(m / (nullif(sd, 0) / sqrt(n)), 0) AS t FROM g),
prof AS (SELECT series_id, hour, n, round(rg, 3) AS avg_range_pct, round(m * 100, 4) AS avg_return_pct,
  round(t, 2) AS t_stat, round({p_value_sql('t')}, 4) AS p_value, {p_value_sql('t')} < 0.05 AS significant,
  row_number() OVER (PARTITION BY series_id ORDER BY round(rg, 3) DESC, hour) <= 5 AS most_volatile FROM pt)"""

_SCREEN_SQL = f"""{_SCREEN}
SELECT series_id, family, signal, horizon, n, significant, favourable, {_R5} FROM scr"""

QUERIES = {
    "newey_west": (newey_west, f"""{_OBS}
SELECT series_id, horizon, scope, count(*) AS signals, sum(n)::BIGINT AS n, {rnd('sum(t)', 4)} AS sum_t,
  {rnd('max(t)', 4)} AS max_t FROM tst GROUP BY 1, 2, 3"""),
    "baseline_drift": (baseline_drift, f"""{_OBS}, {_BASE}
SELECT series_id, horizon, n, {rnd('100 * m')} AS mean_fwd_pct, {rnd('t')} AS t_stat,
  {rnd(p_value_sql('t'))} AS p_value FROM base"""),
    "signal_screen": (signal_screen, _SCREEN_SQL),
    "signal_screen_blocks": (signal_screen_blocks, _SCREEN_SQL),
    "screen_highlights": (screen_highlights, f"""{_SCREEN},
tag AS (SELECT *, 'significant' AS highlight FROM scr WHERE significant AND favourable
  UNION ALL SELECT *, 'robust' FROM scr WHERE significant AND favourable AND -is_mean_pct > 0 AND -oos_mean_pct > 0
  UNION ALL SELECT *, 'contrary' FROM scr WHERE significant AND NOT favourable),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, highlight
  ORDER BY CASE WHEN highlight = 'contrary' THEN edge_pct ELSE -edge_pct END, signal, horizon) AS rank FROM tag)
SELECT series_id, highlight, rank, family, signal, horizon, n, {rnd('edge_pct', 5)} AS edge_pct,
  {rnd('p_value', 5)} AS p_value FROM rk WHERE highlight <> 'contrary' OR rank <= 10"""),
    "false_positive_budget": (false_positive_budget, f"""{_SCREEN}
SELECT series_id, count(*) AS tests, sum(significant::INT)::BIGINT AS significant,
  {rnd('0.05::DOUBLE * count(*)')} AS expected_by_chance FROM scr GROUP BY 1"""),
    "hour_profile": (hour_profile, f"{_PROFILE} SELECT * FROM prof"),
    "hour_ranges": (hour_ranges, f"""{_PRE},
g AS (SELECT series_id, hr AS hour, avg(range_pct) AS a, stddev_samp(range_pct) AS s, count(range_pct) AS n FROM b GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY a DESC, hour) AS rank_high,
  row_number() OVER (PARTITION BY series_id ORDER BY a, hour) AS rank_low FROM g)
SELECT series_id, hour, {rnd('a')} AS avg_range, {rnd('s')} AS std_range, n, rank_high, rank_low
FROM r WHERE rank_high <= 5 OR rank_low <= 3"""),
    "liquid_hours": (liquid_hours, f"""{_PROFILE}
SELECT series_id, hour, {rnd('avg_range_pct')} AS avg_range_pct, {rnd('avg(avg_range_pct) OVER p')} AS mean_range_pct,
  avg_range_pct >= avg(avg_range_pct) OVER p AS liquid FROM prof WINDOW p AS (PARTITION BY series_id)"""),
    "market_summary": (market_summary, f"""{_PRE}
SELECT series_id, count(*) AS total_bars, min(ts) AS date_from, max(ts) AS date_to, {rnd('avg(close)')} AS avg_close,
  {rnd('100 * stddev_samp(ret)')} AS bar_volatility_pct, {rnd('avg(range_pct)')} AS avg_range_pct,
  {rnd('max(range_pct)')} AS max_range_pct, {rnd('min(range_pct)')} AS min_range_pct,
  {rnd('100 * avg((body_pct < 20)::INT)')} AS doji_pct, {rnd('100 * avg((uw > 2 * body)::INT)')} AS short_rejection_pct,
  {rnd('100 * avg((lw > 2 * body)::INT)')} AS long_lower_wick_pct FROM b GROUP BY 1"""),
    "session_shares": (session_shares, f"""{_PRE},
w(bucket, a, z) AS (VALUES ('00-08', 0, 8), ('12-15', 12, 15), ('12-20', 12, 20), ('00-23', 0, 23)),
tot AS (SELECT series_id, count(range_pct) AS nb, sum(range_pct) AS sr FROM b GROUP BY 1)
SELECT b.series_id, bucket, count(range_pct) AS n, {rnd('avg(range_pct)')} AS avg_range_pct,
  {rnd('100.0 * count(range_pct) / any_value(nb)')} AS share_of_bars_pct,
  {rnd('100 * sum(range_pct) / any_value(sr)')} AS share_of_range_pct
FROM b JOIN w ON hr BETWEEN a AND z JOIN tot ON tot.series_id = b.series_id GROUP BY 1, 2"""),
    "stop_distance": (stop_distance, f"""WITH {bars_sql()},
m AS (SELECT *, {roll('avg', '(high - low)', 14)} AS atr FROM idx),
l AS (SELECT series_id, {rnd('arg_max(atr, bar_idx)')} AS a FROM m GROUP BY 1)
SELECT series_id, {rnd('2 * nullif(a, 0)', 4)} AS stop_distance, {rnd('4 * nullif(a, 0)', 4)} AS target_distance FROM l"""),
}
