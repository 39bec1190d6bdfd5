"""Registered queries: bootstrap, equity and general trade statistics over daily trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.recursive import recursive_indicators
from tickloom.operators import bootstrap as bs
from tickloom.operators import trades as tr
from tickloom.operators.blocks import index_bars
from tickloom.operators.outcomes import ExitRule, with_outcomes
from tickloom.plans.common import DAILY, bars_sql, daily_bars, r6, rnd, rounded
from tickloom.plans.oracle_indicators import PREPARED
from tickloom.plans.oracle_levels import atr_sql, outcome_sql
from tickloom.session import materialise

RULE = ExitRule("r", long=True, stop=1.5, target=2.0, trail=1.0, hold=10)
KEYS = ["series_id"]
N_RUNS, RUIN = 1000, -60.0


def daily_trades(spark, sf):
    """Every daily bar as a long entry."""
    ix = index_bars(daily_bars(spark, sf), "year")
    e = recursive_indicators(ix, ["atr"], keep=("ts", "close")).select(
        "series_id", F.col("bar_idx").alias("entry_idx"), F.col("ts").alias("entry_ts"),
        F.col("close").alias("entry_price"), "atr")
    return with_outcomes(ix, e, [RULE])


def order_results(spark, sf):
    """Order totals against a fixed mark, as a results table per customer and year order."""
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("entry_idx"),
        F.col("o_orderdate").alias("entry_ts"), ((F.col("o_totalprice") - 240000) / 99991).alias("r"))


def bootstrap_report(spark, sf):
    return rounded(bs.bootstrap(materialise(daily_trades(spark, sf)), KEYS, N_RUNS, 7, ruin_level=RUIN), 5)


def bootstrap_paths(spark, sf):
    runs = bs.run_summaries(bs.resample(bs.number_trades(daily_trades(spark, sf), KEYS), KEYS, N_RUNS, 7), KEYS)
    return rounded(runs, 5)


def calendar_rate(spark, sf):
    return rounded(bs.calendar_rate(order_results(spark, sf), KEYS))


def equity_curve(spark, sf):
    e = bs.equity_curve(order_results(spark, sf), KEYS)
    return e.select("series_id", "entry_idx", r6("equity", 8).alias("equity"))


def trade_stats(spark, sf):
    return rounded(tr.trade_stats(order_results(spark, sf), KEYS), 8)


def trade_years(spark, sf):
    y = tr.year_stats(order_results(spark, sf), KEYS)
    return rounded(y.select("series_id", "positive_years", "years", "best_year_share_pct",
                            F.to_json("yearly").alias("yearly")), 0)


def yearly_sums(spark, sf):
    return rounded(tr.yearly_sums(order_results(spark, sf), KEYS), 8)


def trade_concentration(spark, sf):
    return rounded(tr.concentration(order_results(spark, sf), KEYS), 4)


def trades_per_year(spark, sf):
    return rounded(tr.trades_per_year(order_results(spark, sf), KEYS))


def wilson_by_status(spark, sf):
    """Wilson bounds of the share of large orders per status and priority."""
    from tickloom.functions.columns import wilson_bounds

    o = spark.read.parquet(f"{sf}/orders.parquet")
    g = o.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("o_totalprice") > 300000).cast("bigint")).alias("wins"))
    lo, hi = wilson_bounds(F.col("wins").cast("double"), F.col("n"))
    return rounded(g.select("*", lo.alias("lower"), hi.alias("upper")))


_TRADES = f"""WITH RECURSIVE {bars_sql(DAILY)},
{PREPARED},
{atr_sql()},
ent AS (SELECT pre.series_id, pre.bar_idx AS entry_idx, ts AS entry_ts, close AS entry_price, atr FROM pre
  JOIN ra ON ra.series_id = pre.series_id AND ra.bar_idx = pre.bar_idx WHERE atr > 1e-9),
{outcome_sql('outc', 'ent', [RULE])},
num AS (SELECT series_id, r, row_number() OVER (PARTITION BY series_id ORDER BY entry_idx) - 1 AS seq,
  count(*) OVER (PARTITION BY series_id) AS n FROM outc)"""


def _paths(runs: int) -> str:
    return f"""{_TRADES},
runs AS (SELECT unnest(range({runs})) AS run),
dr AS (SELECT series_id, run, seq AS k, ('0x' || substr(md5('7|' || series_id || '|' || run || '|' || seq), 1, 15))::BIGINT % n AS pick
  FROM num, runs),
pt AS (SELECT dr.series_id, run, k, num.r FROM dr JOIN num ON num.series_id = dr.series_id AND num.seq = dr.pick),
cm AS (SELECT *, sum(r) OVER (PARTITION BY series_id, run ORDER BY k) AS eq FROM pt),
dd AS (SELECT *, eq - greatest(0, max(eq) OVER (PARTITION BY series_id, run ORDER BY k)) AS d FROM cm),
sm AS (SELECT series_id, run, count(*) AS n, sum(r) AS total, least(0, min(eq)) AS low, least(0, min(d)) AS max_dd
  FROM dd GROUP BY 1, 2)"""


_RES = """WITH res AS (SELECT o_custkey AS series_id, o_orderkey AS entry_idx, o_orderdate AS entry_ts,
  (o_totalprice - 240000) / 99991 AS r FROM orders)"""
_RES_DD = f"""{_RES},
e1 AS (SELECT *, sum(r) OVER (PARTITION BY series_id ORDER BY entry_idx) AS eq FROM res),
e2 AS (SELECT *, eq - greatest(0, max(eq) OVER (PARTITION BY series_id ORDER BY entry_idx)) AS dd FROM e1)"""
_Z = "3.8416::DOUBLE"


def _wilson(n: str, w: str) -> tuple[str, str]:
    half = f"1.96::DOUBLE * sqrt({w} / {n} * (1 - {w} / {n}) / {n} + {_Z} / (4 * {n} * {n}))"
    return (
        f"greatest(0, ({w} / {n} + {_Z} / (2 * {n}) - {half}) / (1 + {_Z} / {n}))",
        f"least(1, ({w} / {n} + {_Z} / (2 * {n}) + {half}) / (1 + {_Z} / {n}))",
    )


_LO, _HI = _wilson("n", "w")

QUERIES = {
    "bootstrap_report": (bootstrap_report, f"""{_paths(N_RUNS)}
SELECT series_id, count(*) AS n_runs, max(n) AS n_trades, {rnd('100 * avg((total > 0)::INT)', 5)} AS profit_rate,
  {rnd('quantile_cont(max_dd, 0.5)', 5)} AS dd_p50, {rnd('quantile_cont(max_dd, 0.95)', 5)} AS dd_p95,
  {rnd('quantile_cont(max_dd, 0.05)', 5)} AS dd_p05, {rnd('min(max_dd)', 5)} AS dd_worst,
  {rnd('quantile_cont(total, 0.05)', 5)} AS final_lo, {rnd('quantile_cont(total, 0.95)', 5)} AS final_hi,
  {rnd('avg(total)', 5)} AS final_mean, {rnd(f'100 * avg((low < {RUIN})::INT)', 5)} AS bust_rate FROM sm GROUP BY 1"""),
    "bootstrap_paths": (bootstrap_paths, f"""{_paths(N_RUNS)}
SELECT series_id, run, n, {rnd('total', 5)} AS total, {rnd('low', 5)} AS low, {rnd('max_dd', 5)} AS max_dd FROM sm"""),
    "calendar_rate": (calendar_rate, f"""{_RES}
SELECT series_id, count(r) AS n, (max(year(entry_ts)) - min(year(entry_ts)) + 1)::INT AS years,
  {rnd('count(r)::DOUBLE / (max(year(entry_ts)) - min(year(entry_ts)) + 1)')} AS trades_per_year FROM res GROUP BY 1"""),
    "equity_curve": (equity_curve, f"{_RES_DD} SELECT series_id, entry_idx, {rnd('eq', 8)} AS equity FROM e1"),
    "trade_stats": (trade_stats, f"""{_RES_DD},
m AS (SELECT series_id, least(0, min(dd)) AS max_dd FROM e2 GROUP BY 1),
g AS (SELECT series_id, count(r)::DOUBLE AS n, sum((r > 0)::INT)::DOUBLE AS w, avg(r) AS mean, sum(r) AS t, stddev_samp(r) AS sd,
    coalesce(avg(r) FILTER (r > 0), 0) AS aw, coalesce(avg(r) FILTER (r <= 0), 0) AS al, max(r) AS b, min(r) AS wo, median(r) AS med
  FROM res GROUP BY 1)
SELECT series_id, n::BIGINT AS n, w::BIGINT AS wins, {rnd('mean', 8)} AS r_per_trade, {rnd('t', 8)} AS r_total, {rnd('sd', 8)} AS r_std,
  {rnd('aw', 8)} AS avg_win, {rnd('al', 8)} AS avg_loss, {rnd('b', 8)} AS best, {rnd('wo', 8)} AS worst,
  {rnd('100 * w / n', 8)} AS win_pct, {rnd(f'100 * {_LO}', 8)} AS win_pct_lo, {rnd(f'100 * {_HI}', 8)} AS win_pct_hi,
  {rnd('med', 8)} AS r_median, {rnd('max_dd', 8)} AS max_dd, {rnd('t / abs(nullif(max_dd, 0))', 8)} AS recovery_factor
FROM g JOIN m USING (series_id)"""),
    "trade_years": (trade_years, f"""{_RES},
y AS (SELECT series_id, year(entry_ts) AS y, sum(r) AS s FROM res GROUP BY 1, 2)
SELECT series_id, sum((s > 0)::INT)::BIGINT AS positive_years, count(*) AS years,
  {rnd('CASE WHEN sum(s) <> 0 THEN 100 * max(s) / sum(s) END', 0)} AS best_year_share_pct,
  '{{' || string_agg('"' || y || '":' || (round(s, 1) + 0.0)::VARCHAR, ',' ORDER BY y) || '}}' AS yearly FROM y GROUP BY 1"""),
    "yearly_sums": (yearly_sums, f"""{_RES}
SELECT series_id, year(entry_ts)::INT AS year, {rnd('sum(r)', 8)} AS year_r, count(r) AS year_n FROM res GROUP BY 1, 2"""),
    "trade_concentration": (trade_concentration, f"""{_RES},
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r DESC) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM res)
SELECT series_id, count(*) AS n, {rnd('CASE WHEN sum(r) > 0 THEN 100 * sum(r) FILTER (k <= 5) / sum(r) END', 4)} AS top5_share_pct,
  {rnd('CASE WHEN sum(r) > 0 THEN 100 * sum(r) FILTER (k <= greatest(1, n // 20)) / sum(r) END', 4)} AS top5pct_share_pct
FROM k GROUP BY 1"""),
    "trades_per_year": (trades_per_year, f"""{_RES}
SELECT series_id, count(*) AS n,
  {rnd("count(*) / nullif(date_diff('day', min(entry_ts), max(entry_ts)) / 365.25::DOUBLE, 0)")} AS per_year FROM res GROUP BY 1"""),
    "wilson_by_status": (wilson_by_status, f"""WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n,
  sum((o_totalprice > 300000)::INT)::DOUBLE AS w FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, n::BIGINT AS n, w::BIGINT AS wins, {rnd(_LO)} AS lower, {rnd(_HI)} AS upper FROM g"""),
}
