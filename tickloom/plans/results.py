"""Registered queries: strategy-result profiles; a strategy is a supplier within a return-flag stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import results as ops
from tickloom.plans.common import rnd, rounded, table, work_folder
from tickloom.sources.strategies import canonical_rows, read_strategies


def raw_export(spark, sf):
    """An export with its own headers and text numbers, one row per supplier and return flag."""
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_suppkey", "l_returnflag").agg(
        F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).alias("net"),
        F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return g.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("Strategy Name"),
        F.concat(F.lit("$"), F.format_number("net", 2)).alias("Net Profit"),
        F.round(F.col("q") / 16, 4).cast("string").alias("Profit Factor"),
        F.round(F.col("d") * 30, 4).cast("string").alias("Win/Loss Ratio"),
        F.col("n").cast("string").alias("# Trades"),
        F.concat(F.round(F.col("t") * 200, 4).cast("string"), F.lit("%")).alias("Max Drawdown %"),
        F.round(F.col("d") * 40, 4).cast("string").alias("Sharpe"), F.lit("-").alias("Time in Market"),
        F.col("l_returnflag").alias("Stage Flag"))


def strategies(spark, sf):
    raw = raw_export(spark, sf)
    rows, _ = canonical_rows(raw)
    return rows


def thresholds(spark, sf):
    """Filters set at fractions of the mean metrics of all strategies."""
    s = strategies(spark, sf)
    m = s.agg(F.avg("profitfactor").alias("pf"), F.avg("numberoftrades").alias("n"), F.avg("maxdrawdownpct").alias("dd"),
              F.avg("winlossratio").alias("wl"))
    rows = F.array(
        F.struct(F.lit("profitfactor").alias("metric"), F.lit(">=").alias("comparator"), (F.col("pf") * 0.9).alias("threshold")),
        F.struct(F.lit("numberoftrades").alias("metric"), F.lit(">").alias("comparator"), (F.col("n") * 0.7).alias("threshold")),
        F.struct(F.lit("maxdrawdownpct").alias("metric"), F.lit("<=").alias("comparator"), (F.col("dd") * 1.1).alias("threshold")),
        F.struct(F.lit("winlossratio").alias("metric"), F.lit(">=").alias("comparator"), (F.col("wl") * 0.5).alias("threshold")))
    return m.select(F.explode(rows).alias("t")).select("t.*")


def strategy_rows(spark, sf):
    return rounded(strategies(spark, sf))


def strategy_file(spark, sf):
    """The export written as a semicolon file and read back by the scanner."""
    path = work_folder(spark)
    raw_export(spark, sf).write.option("header", True).option("sep", ";").csv(path)
    return rounded(read_strategies(spark, path)[0])


def unmapped_columns(spark, sf):
    """Headers without a known metric, with the distinct values they hold."""
    raw = raw_export(spark, sf)
    _, unknown = canonical_rows(raw)
    cells = F.array(*[F.struct(F.lit(c).alias("header"), F.col(f"`{c}`").alias("value")) for c in unknown])
    return raw.select(F.explode(cells).alias("c")).groupBy("c.header").agg(F.countDistinct("c.value").alias("n_values"))


def survivor_distribution(spark, sf):
    return rounded(ops.distribution(strategies(spark, sf)))


def filter_margins(spark, sf):
    return rounded(ops.margins(strategies(spark, sf), thresholds(spark, sf)))


def tail_hints(spark, sf):
    return rounded(ops.tail_hints(strategies(spark, sf), thresholds(spark, sf)))


def stage_funnel(spark, sf):
    """Orders that survive successive filters."""
    li = table(spark, sf, "lineitem")
    stages = F.array_compact(F.array(
        F.struct(F.lit(1).alias("no"), F.lit("all").alias("stage")),
        F.when(F.col("l_quantity") > 10, F.struct(F.lit(2).alias("no"), F.lit("quantity").alias("stage"))),
        F.when((F.col("l_quantity") > 10) & (F.col("l_discount") > 0.03), F.struct(F.lit(3).alias("no"), F.lit("discount").alias("stage")))))
    s = li.select("l_returnflag", F.explode(stages).alias("s")).select("l_returnflag", F.col("s.no").alias("stage_no"), "s.stage")
    return rounded(ops.funnel(s, ["l_returnflag"]))


def calibration_hints(spark, sf):
    return rounded(ops.calibration_hints(strategies(spark, sf)))


_S = """s AS (SELECT 'S' || l_suppkey AS strategyname, round(sum(l_extendedprice * (l_discount - 0.04)), 2) AS netprofit,
  round(avg(l_quantity) / 16, 4) AS profitfactor, round(avg(l_discount) * 30, 4) AS winlossratio, count(*)::DOUBLE AS numberoftrades,
  round(avg(l_tax) * 200, 4) AS maxdrawdownpct, round(avg(l_discount) * 40, 4) AS sharperatio, NULL::DOUBLE AS timeinmarket
  FROM lineitem GROUP BY l_suppkey, l_returnflag)"""
_LONG = """lm AS (SELECT metric, value FROM (UNPIVOT s ON netprofit, profitfactor, winlossratio, numberoftrades, maxdrawdownpct, sharperatio
  INTO NAME metric VALUE value))"""
_THR = """th AS (SELECT 'profitfactor' AS metric, '>=' AS comparator, avg(profitfactor) * 0.9::DOUBLE AS threshold FROM s
  UNION ALL SELECT 'numberoftrades', '>', avg(numberoftrades) * 0.7::DOUBLE FROM s
  UNION ALL SELECT 'maxdrawdownpct', '<=', avg(maxdrawdownpct) * 1.1::DOUBLE FROM s
  UNION ALL SELECT 'winlossratio', '>=', avg(winlossratio) * 0.5::DOUBLE FROM s)"""

QUERIES = {
    "strategy_rows": (strategy_rows, f"""WITH {_S} SELECT * FROM s"""),
    "strategy_file": (strategy_file, f"""WITH {_S} SELECT * FROM s"""),
    "unmapped_columns": (unmapped_columns, "SELECT 'Stage Flag' AS header, count(DISTINCT l_returnflag) AS n_values FROM lineitem"),
    "survivor_distribution": (survivor_distribution, f"""WITH {_S}, {_LONG},
o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value) AS k, count(*) OVER (PARTITION BY metric) AS n FROM lm)
SELECT metric, count(*) AS n, {rnd('min(value)')} AS min, {rnd('max(value)')} AS max, {rnd('median(value)')} AS median,
  {rnd('max(value) FILTER (k = least(floor(0.25 * n) + 1, n))')} AS p25,
  {rnd('max(value) FILTER (k = least(floor(0.75 * n) + 1, n))')} AS p75 FROM o GROUP BY 1"""),
    "filter_margins": (filter_margins, f"""WITH {_S}, {_LONG}, {_THR}
SELECT lm.metric, comparator, {rnd('threshold')} AS threshold, count(*) AS n,
  sum((CASE WHEN comparator LIKE '>%' THEN value < threshold * 1.1::DOUBLE ELSE value > threshold * 0.9::DOUBLE END)::INT)::BIGINT AS n_tight,
  {rnd("CASE WHEN comparator LIKE '>%' THEN min(value) ELSE max(value) END")} AS worst
FROM lm JOIN th ON th.metric = lm.metric GROUP BY lm.metric, comparator, threshold"""),
    "tail_hints": (tail_hints, f"""WITH {_S}, {_LONG}, {_THR}
SELECT lm.metric, {rnd('median(value)')} AS median, {rnd('threshold')} AS threshold FROM lm JOIN th ON th.metric = lm.metric
WHERE comparator = '>=' GROUP BY lm.metric, threshold HAVING median(value) < threshold * 1.25"""),
    "stage_funnel": (stage_funnel, f"""WITH g AS (
  SELECT l_returnflag, 1 AS stage_no, 'all' AS stage, count(*) AS n FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 2, 'quantity', count(*) FROM lineitem WHERE l_quantity > 10 GROUP BY 1
  UNION ALL SELECT l_returnflag, 3, 'discount', count(*) FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.03 GROUP BY 1),
p AS (SELECT *, lag(n) OVER (PARTITION BY l_returnflag ORDER BY stage_no) AS prev FROM g)
SELECT l_returnflag, stage_no, stage, n, prev - n AS killed, {rnd('100.0::DOUBLE * (prev - n) / prev')} AS killed_pct FROM p"""),
    "calibration_hints": (calibration_hints, f"""WITH {_S}, {_LONG},
m AS (SELECT metric, median(value) AS median FROM lm GROUP BY 1)
SELECT metric, {rnd('median')} AS median, CASE metric WHEN 'profitfactor' THEN 'filter_not_binding' ELSE 'lower_reward_risk_instead' END AS hint
FROM m WHERE (metric = 'profitfactor' AND median > 1.6) OR (metric = 'winlossratio' AND median < 1.55)"""),
}
