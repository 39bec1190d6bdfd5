"""Profiles of strategy-result tables: distributions, filter margins, funnels, hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.operators.blocks import exact_quantiles

METRICS = (
    "netprofit", "profitfactor", "winlossratio", "numberoftrades", "maxdrawdownpct", "sharperatio", "timeinmarket",
)


def long_metrics(strategies: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """(keys, metric, value) of the metrics present, without missing values."""
    have = [m for m in metrics if m in strategies.columns]
    cast = strategies.select(*keys, *[F.col(m).cast("double").alias(m) for m in have])
    return cast.unpivot(list(keys), have, "metric", "value").filter(F.col("value").isNotNull())


def distribution(strategies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median, extremes and the two order statistics p25 and p75 per metric."""
    keys = [*keys, "metric"]
    values = long_metrics(strategies, keys[:-1])
    base = values.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))
    median = exact_quantiles(values, keys, "value", {"median": 0.5})
    sides = exact_quantiles(values, keys, "value", {"p25": 0.25, "p75": 0.75}, rank="floor")
    return base.join(median, keys).join(sides, keys)


def margins(strategies: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How closely the survivors passed each filter: those within 10 % of it, and the worst value."""
    values = long_metrics(strategies, keys)
    j = values.join(thresholds, "metric")
    floor = F.col("comparator").isin(">=", ">")
    ceiling = F.col("comparator").isin("<=", "<")
    tight = F.when(floor, F.col("value") < F.col("threshold") * 1.10).when(ceiling, F.col("value") > F.col("threshold") * 0.90)
    return j.filter(floor | ceiling).groupBy(*keys, "metric", "comparator", "threshold").agg(
        F.count("value").alias("n"), F.sum(tight.cast("bigint")).alias("n_tight"),
        F.when(F.first("comparator").isin(">=", ">"), F.min("value")).otherwise(F.max("value")).alias("worst"),
    )


def tail_hints(strategies: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lower-bound filters whose survivors' median lies under 1.25 times the filter."""
    keys = list(keys)
    median = exact_quantiles(long_metrics(strategies, keys), [*keys, "metric"], "value", {"median": 0.5})
    return median.join(thresholds.filter(F.col("comparator") == ">="), "metric").filter(
        F.col("median") < F.col("threshold") * 1.25
    ).select(*keys, "metric", "median", "threshold")


def funnel(strategies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per ordered stage, and how many the stage removed from the one before.

    Needs stage_no and stage.
    """
    keys = list(keys)
    counts = strategies.groupBy(*keys, "stage_no", "stage").agg(F.count(F.lit(1)).alias("n"))
    # a handful of stages per key: the window sees counts, not strategies
    prev = F.lag("n").over(Window.partitionBy(*keys).orderBy("stage_no"))
    killed = prev - F.col("n")
    pct = F.when(prev.isNotNull(), F.coalesce(100 * killed / F.nullif(prev, F.lit(0).cast("bigint")), F.lit(0.0)))
    return counts.withColumns({"killed": killed, "killed_pct": pct})


def calibration_hints(strategies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hints from the medians of profit factor (> 1.6) and win/loss ratio (< 1.55)."""
    keys = list(keys)
    values = long_metrics(strategies, keys, ("profitfactor", "winlossratio"))
    median = exact_quantiles(values, [*keys, "metric"], "value", {"median": 0.5})
    loose = (F.col("metric") == "profitfactor") & (F.col("median") > 1.6)
    near = (F.col("metric") == "winlossratio") & (F.col("median") < 1.55)
    return median.filter(loose | near).select(
        *keys, "metric", "median",
        F.when(loose, F.lit("filter_not_binding")).otherwise(F.lit("lower_reward_risk_instead")).alias("hint"),
    )
