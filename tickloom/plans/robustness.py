"""Registered queries: regimes, breaks and date splits on daily bars; hourly variants where they differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import regimes as rg
from tickloom.operators.blocks import exact_quantiles, index_bars
from tickloom.session import materialise
from tickloom.plans.common import DAILY, HOURLY, bars_sql, daily_bars, hourly_bars, lag, r6, rnd, roll, rolled_daily, rounded, table


def _daily(spark, sf):
    return index_bars(daily_bars(spark, sf), "year")


def volatility_regimes(spark, sf):
    return rg.regimes(_daily(spark, sf))


def hourly_regimes(spark, sf):
    return rg.regimes(index_bars(hourly_bars(spark, sf)), min_days=0)


def structural_breaks(spark, sf):
    return rg.structural_breaks(_daily(spark, sf))


def series_spans(spark, sf):
    return rg.spans(rolled_daily(spark, sf))


def split_proposals(spark, sf):
    ix = _daily(spark, sf)
    span = rg.spans(ix)
    return rg.simple_split(span).unionByName(rg.walk_forward(span, 2, 3.0, 1.5)).unionByName(
        rg.regime_proposals(span, materialise(rg.regimes(ix))))


def split_recommendation(spark, sf):
    ix = _daily(spark, sf)
    return rg.recommendation(rg.spans(ix), rg.regimes(ix))


def combined_proposal(spark, sf):
    """Walk-forward where the history is long enough, else the simple split; per customer."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderdate").alias("ts"))
    span = rg.spans(o)
    return rg.chosen_split(rg.simple_split(span).unionByName(rg.walk_forward(span, 2, 3.0, 1.5)))


def signal_changes(spark, sf):
    """Part types a supplier ships after 1998 against those it shipped before."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select(F.col("l_suppkey").alias("series_id"), F.concat_ws("/", "p_brand", "p_type").alias("signal"), "l_shipdate")
    late = rows.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    early = rows.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return rg.signal_changes(late, early, ["series_id", "signal"])


def price_quantiles(spark, sf):
    """Exact quantiles of line prices per return flag, without gathering a flag in one task."""
    li = table(spark, sf, "lineitem")
    return rounded(exact_quantiles(li, ["l_returnflag"], "l_extendedprice",
                                   {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}), 4)


def _regime_sql(kind: str, min_days: int) -> str:
    return f"""{bars_sql(kind)},
rt AS (SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM idx),
vl AS (SELECT *, {roll('stddev_samp', 'ret', 50)} * sqrt(252) AS vol FROM rt),
th AS (SELECT series_id, quantile_cont(vol, 0.25) AS lo, quantile_cont(vol, 0.75) AS hi FROM vl GROUP BY 1 HAVING count(vol) >= 100),
lb AS (SELECT vl.*, CASE WHEN vol > hi THEN 'high_vol' WHEN vol < lo THEN 'low_vol' ELSE 'normal' END AS label
  FROM vl JOIN th ON th.series_id = vl.series_id),
ch AS (SELECT *, CASE WHEN label = {lag('label')} THEN 0 ELSE 1 END AS c FROM lb),
ru AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY bar_idx) AS run FROM ch),
rg AS (SELECT series_id, any_value(label) AS type, min(ts)::DATE AS start, max(ts)::DATE AS "end",
    date_sub('day', min(ts), max(ts)) AS duration_days, round(avg(vol) * 100, 2) AS avg_annual_vol
  FROM ru WHERE label <> 'normal' GROUP BY series_id, run HAVING date_sub('day', min(ts), max(ts)) >= {min_days})"""


_SPAN = """sp AS (SELECT series_id, min(ts) AS date_from, max(ts) AS date_to, count(*) AS total_bars,
  date_sub('day', min(ts), max(ts)) AS total_days, round(date_sub('day', min(ts), max(ts)) / 365.25::DOUBLE, 2) AS total_years
  FROM bars GROUP BY 1)"""
_SIMPLE = """SELECT series_id, 'simple_split' AS proposal, 1 AS oos_no, date_from::DATE AS is_from,
  date_from::DATE + floor(total_days * 0.6)::INT AS is_to, date_from::DATE + floor(total_days * 0.6)::INT AS oos_from, date_to::DATE AS oos_to FROM sp"""
_WALK = """SELECT series_id, 'walk_forward', i + 1, date_from::DATE, date_from::DATE + (total_days // 3)::INT,
  date_from::DATE + ((total_days // 3) * (i + 1))::INT, least(date_from::DATE + ((total_days // 3) * (i + 2))::INT, date_to::DATE)
  FROM sp, (SELECT unnest([0, 1]) AS i) WHERE total_days / 365.25 >= 6.0"""

QUERIES = {
    "volatility_regimes": (volatility_regimes, f"WITH {_regime_sql(DAILY, 14)} SELECT * FROM rg"),
    "hourly_regimes": (hourly_regimes, f"WITH {_regime_sql(HOURLY, 0)} SELECT * FROM rg"),
    "structural_breaks": (structural_breaks, f"""WITH {bars_sql(DAILY)},
rt AS (SELECT *, coalesce(close / nullif({lag('close')}, 0) - 1, 0) AS ret FROM idx),
cu AS (SELECT *, sum(ret) OVER (PARTITION BY series_id ORDER BY bar_idx) AS cum FROM rt),
sl AS (SELECT *, CASE WHEN bar_idx >= 99 THEN regr_slope(cum, bar_idx)
  OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) END AS slope FROM cu),
df AS (SELECT *, abs(slope - {lag('slope')}) AS change FROM sl),
q AS (SELECT series_id, quantile_cont(change, 0.95) AS lim FROM df GROUP BY 1),
f AS (SELECT df.series_id, ts, round(change * 10000, 2) AS magnitude FROM df JOIN q ON q.series_id = df.series_id WHERE change > lim)
SELECT series_id, ts::DATE AS date, magnitude, row_number() OVER (PARTITION BY series_id ORDER BY magnitude DESC, ts) AS rank
FROM f QUALIFY rank <= 10"""),
    "series_spans": (series_spans, f"WITH {DAILY}, {_SPAN} SELECT * FROM sp"),
    "split_proposals": (split_proposals, f"""WITH {_regime_sql(DAILY, 14)}, {_SPAN},
best AS (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY series_id, type ORDER BY duration_days DESC, start) = 1),
cyc AS (SELECT series_id, min(start) AS a, max("end") AS b FROM rg GROUP BY 1 HAVING count(*) >= 2)
{_SIMPLE}
UNION ALL {_WALK}
UNION ALL SELECT sp.series_id, CASE type WHEN 'high_vol' THEN 'high_volatility' ELSE 'low_volatility' END, 1, date_from::DATE, start, start, "end"
  FROM sp JOIN best ON best.series_id = sp.series_id
UNION ALL SELECT sp.series_id, 'full_cycle', 1, a, b, b, date_to::DATE FROM sp JOIN cyc ON cyc.series_id = sp.series_id"""),
    "split_recommendation": (split_recommendation, f"""WITH {_regime_sql(DAILY, 14)}, {_SPAN},
h AS (SELECT series_id, count(*) FILTER (type = 'high_vol') AS n FROM rg GROUP BY 1),
j AS (SELECT sp.*, coalesce(n, 0) AS high_runs FROM sp LEFT JOIN h ON h.series_id = sp.series_id)
SELECT series_id, total_years, CASE WHEN total_years < 3 THEN 'insufficient_data' WHEN total_years < 5 THEN 'conservative'
    WHEN total_years < 8 THEN 'walk_forward' ELSE 'robust_walk_forward' END AS strategy,
  round(total_years * CASE WHEN total_years < 3 THEN 0 WHEN total_years < 5 THEN 0.7 WHEN total_years < 8 THEN 0.6 ELSE 0.5 END, 1) AS optimal_is_years,
  round(total_years * CASE WHEN total_years < 3 THEN 0 WHEN total_years < 5 THEN 0.3 WHEN total_years < 8 THEN 0.4 ELSE 0.5 END, 1) AS optimal_oos_years,
  high_runs, total_years >= 3 AND high_runs >= 3 AS diverse FROM j"""),
    "combined_proposal": (combined_proposal, f"""WITH bars AS (SELECT o_custkey AS series_id, o_orderdate AS ts FROM orders), {_SPAN},
p AS ({_SIMPLE} UNION ALL {_WALK})
SELECT * FROM p WHERE proposal = 'walk_forward' OR series_id NOT IN (SELECT series_id FROM p WHERE proposal = 'walk_forward')"""),
    "signal_changes": (signal_changes, """WITH r AS (SELECT DISTINCT l_suppkey AS series_id, p_brand || '/' || p_type AS signal,
  l_shipdate >= TIMESTAMP '1998-01-01' AS late FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT series_id, signal, CASE WHEN bool_and(late) THEN 'add' ELSE 'drop' END AS change FROM r
GROUP BY 1, 2 HAVING count(*) = 1"""),
    "price_quantiles": (price_quantiles, f"""SELECT l_returnflag, {', '.join(
        f"{rnd(f'quantile_cont(l_extendedprice, {p})', 4)} AS p{n}" for n, p in
        (('05', 0.05), ('25', 0.25), ('50', 0.5), ('75', 0.75), ('95', 0.95)))} FROM lineitem GROUP BY 1"""),
}
