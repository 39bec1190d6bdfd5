"""Statistics of trade results: win rates, drawdown, years, concentration, hours, verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import no_zero, wilson_bounds
from tickloom.operators.blocks import exact_quantiles, path_stats


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def attach(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two per-cell result tables on their keys."""
    cols = [F.col(f"e.{c}") for c in extra.columns if c not in keys]
    return base.alias("b").join(extra.alias("e"), _same("b", "e", keys), "left").select("b.*", *cols)


def core_stats(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, win rate with Wilson bounds, mean, total, spread, extremes: one partial aggregate."""
    r = F.col("r")
    won = r > 0
    g = trades.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count("r").alias("n"),
        F.sum(won.cast("bigint")).alias("wins"),
        F.avg("r").alias("r_per_trade"),
        F.sum("r").alias("r_total"),
        F.stddev_samp("r").alias("r_std"),
        F.coalesce(F.avg(F.when(won, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(~won, r)), F.lit(0.0)).alias("avg_loss"),
        F.max("r").alias("best"),
        F.min("r").alias("worst"),
    )
    lo, hi = wilson_bounds(F.col("wins").cast("double"), F.col("n"))
    return g.withColumns({
        "win_pct": 100 * F.col("wins") / F.col("n"), "win_pct_lo": 100 * lo, "win_pct_hi": 100 * hi,
    })


def trade_stats(trades: DataFrame, keys: Sequence[str], position: str = "entry_idx") -> DataFrame:
    """``core_stats`` plus exact median, maximum drawdown and recovery factor."""
    keys = list(keys)
    known = trades.filter(F.col("r").isNotNull())
    median = exact_quantiles(known, keys, "r", {"r_median": 0.5})
    path = path_stats(known, keys, position, "r").select(*keys, "max_dd")
    out = attach(attach(core_stats(known, keys), median, keys), path, keys)
    return out.withColumn("recovery_factor", F.col("r_total") / F.abs(no_zero("max_dd")))


def yearly_sums(trades: DataFrame, keys: Sequence[str], ts: str = "entry_ts") -> DataFrame:
    return trades.filter(F.col("r").isNotNull()).groupBy(*keys, F.year(ts).alias("year")).agg(
        F.sum("r").alias("year_r"), F.count("r").alias("year_n")
    )


def year_stats(trades: DataFrame, keys: Sequence[str], ts: str = "entry_ts") -> DataFrame:
    """Positive years, all years, best year's share of the total, and the sums per year."""
    years = yearly_sums(trades, keys, ts)
    total = F.sum("year_r")
    return years.groupBy(*keys).agg(
        F.sum((F.col("year_r") > 0).cast("bigint")).alias("positive_years"),
        F.count(F.lit(1)).alias("years"),
        F.when(total != 0, 100 * F.max("year_r") / total).alias("best_year_share_pct"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", F.round("year_r", 1))))).alias("yearly"),
    )


def trades_per_year(trades: DataFrame, keys: Sequence[str], ts: str = "entry_ts") -> DataFrame:
    """Trades per year of the span from the first to the last trade."""
    days = F.datediff(F.max(ts), F.min(ts))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / no_zero((days / 365.25).cast("double"))).alias("per_year")
    )


def concentration(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the total contributed by the best 5 trades and the best 5 %; NULL unless the total is positive.

    The best 5 % are summed from an exact threshold: values above it, plus as many
    ties as are needed.
    """
    keys = list(keys)
    known = trades.filter(F.col("r").isNotNull())
    top5 = known.withColumn(
        "_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("r").desc()))
    ).filter(F.col("_k") <= 5).groupBy(*keys).agg(F.sum("r").alias("_top5"))
    cut = exact_quantiles(known, keys, "r", {"_cut": 0.95}, rank="top")
    flagged = known.alias("t").join(cut.alias("c"), _same("t", "c", keys)).select("t.*", "_cut")
    sums = flagged.groupBy(*keys).agg(
        F.count("r").alias("n"), F.sum("r").alias("_total"), F.max("_cut").alias("_cut"),
        F.sum(F.when(F.col("r") > F.col("_cut"), F.col("r")).otherwise(0.0)).alias("_above"),
        F.sum((F.col("r") > F.col("_cut")).cast("bigint")).alias("_n_above"),
    )
    k = F.greatest(F.lit(1).cast("bigint"), F.expr("n div 20"))
    best = F.col("_above") + (k - F.col("_n_above")) * F.col("_cut")
    out = attach(sums, top5, keys)
    return out.select(
        *keys, "n",
        F.when(F.col("_total") > 0, 100 * F.col("_top5") / F.col("_total")).alias("top5_share_pct"),
        F.when(F.col("_total") > 0, 100 * best / F.col("_total")).alias("top5pct_share_pct"),
    )


def entry_hours(trades: DataFrame, keys: Sequence[str], ts: str = "entry_ts") -> DataFrame:
    """Result per hour of entry: share of trades, mean and summed R, all-or-nothing flag."""
    by_hour = trades.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.count("r").alias("n"), F.avg("r").alias("r_per_trade"), F.sum("r").alias("r_sum"),
        (F.every(F.col("r") > 0) | F.every(F.col("r") < 0)).alias("all_or_nothing"),
    )
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return by_hour.withColumn("share_pct", 100 * F.col("n") / whole)


def sample_means(trades: DataFrame, keys: Sequence[str], flag: str = "is_sample") -> DataFrame:
    """n, mean, standard deviation, and the means of both halves."""
    return trades.groupBy(*keys).agg(
        F.count("r").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("std_r"),
        F.avg((F.col("r") > 0).cast("int")).alias("win_rate"),
        F.avg(F.when(F.col(flag), F.col("r"))).alias("is_r"),
        F.avg(F.when(~F.col(flag), F.col("r"))).alias("oos_r"),
    )


def verdicts(means: DataFrame, min_n: int = 40, small_n: int = 100, full_n: int = 200) -> DataFrame:
    """Verdict and risk list per cell from ``sample_means``."""
    a, b, n = F.col("is_r"), F.col("oos_r"), F.col("n")
    fails_oos, weak_is = b <= 0, a <= 0.03
    apart = F.abs(a - b) > 2 * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    risks = F.array_compact(F.array(
        F.when(n < small_n, F.lit("small_sample")),
        F.when(fails_oos, F.lit("fails_out_of_sample")),
        F.when(weak_is, F.lit("weak_in_sample")),
        F.when(a.isNotNull() & b.isNotNull() & apart, F.lit("halves_differ")),
        F.when(F.col("std_r") > 2.0, F.lit("high_variance")),
    ))
    both = F.coalesce((a > 0) & (b > 0), F.lit(False))
    clean = ~F.coalesce(fails_oos, F.lit(False)) & ~F.coalesce(weak_is, F.lit(False))
    verdict = (
        F.when(n < min_n, F.lit("rejected"))
        .when(both & (n >= full_n) & clean, F.lit("fit"))
        .when(both, F.lit("marginal"))
        .otherwise(F.lit("unfit"))
    )
    return means.withColumns({
        "verdict": verdict,
        "risks": F.when(n < min_n, F.lit("insufficient_sample")).otherwise(F.array_join(risks, "; ")),
    })


def scheme_table(long_outcomes: DataFrame, keys: Sequence[str], schemes: Sequence[str]) -> DataFrame:
    """Mean R and win % per cell, one column pair per exit scheme."""
    aggs = []
    for s in schemes:
        mine = F.when(F.col("rule") == s, F.col("r"))
        aggs += [F.avg(mine).alias(f"{s}_r"), (100 * F.avg((mine > 0).cast("int"))).alias(f"{s}_win_pct")]
    return long_outcomes.groupBy(*keys).agg(F.countDistinct("entry_idx").alias("n"), *aggs)
