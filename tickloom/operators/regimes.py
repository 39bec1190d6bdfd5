"""Volatility regimes, structural breaks and date-split proposals per series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import no_zero, rolling_std, series_window
from tickloom.functions.indicators import with_slope
from tickloom.operators.blocks import BLOCK_ROWS, exact_quantiles, own_rows, to_blocks
from tickloom.session import materialise


def _returns(indexed: DataFrame, back: int, size: int) -> DataFrame:
    w = series_window()
    blocked = to_blocks(indexed.select("series_id", "ts", "bar_idx", "n_bars", "close"), back=back, size=size)
    return blocked.withColumn("ret", F.col("close") / no_zero(F.lag("close").over(w)) - 1)


def volatility(indexed: DataFrame, window: int = 50, periods_per_year: int = 252, size: int = BLOCK_ROWS) -> DataFrame:
    """Rolling annualised return volatility; keeps the block column."""
    w = series_window()
    vol = rolling_std("ret", w, window) * math.sqrt(periods_per_year)
    return own_rows(_returns(indexed, window + 1, size).withColumn("vol", vol))


def regimes(
    indexed: DataFrame, window: int = 50, min_days: int = 14, periods_per_year: int = 252, size: int = BLOCK_ROWS
) -> DataFrame:
    """Runs of high (above the 75th percentile) and low (below the 25th) volatility of at least ``min_days``.

    Runs are first formed inside blocks, then numbered across block edges on a
    table of one row per block.  The volatility is written once: thresholds and labels
    both read it.
    """
    vol = materialise(volatility(indexed, window, periods_per_year, size))
    cuts = exact_quantiles(vol, ["series_id"], "vol", {"_lo": 0.25, "_hi": 0.75}, count="_known")
    limits = cuts.filter(F.col("_known") >= 2 * window)
    label = (
        F.when(F.col("vol") > F.col("_hi"), F.lit("high_vol"))
        .when(F.col("vol") < F.col("_lo"), F.lit("low_vol"))
        .otherwise(F.lit("normal"))
    )
    labelled = vol.join(limits, "series_id").withColumn("label", label)
    w = series_window()
    step = F.when(F.col("label") == F.lag("label").over(w), 0).otherwise(1)
    local = labelled.withColumn("_step", step).withColumn(
        "_run", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = local.groupBy("series_id", "blk", "_run").agg(
        F.first("label").alias("label"), F.min("bar_idx").alias("_from"),
        F.min("ts").alias("_start"), F.max("ts").alias("_end"), F.sum("vol").alias("_vol"), F.count("vol").alias("_n"),
    )
    # a block's first run goes on where the block before ended with the same label: one row per block tells
    pieces = materialise(pieces)
    edges = pieces.groupBy("series_id", "blk").agg(
        F.max("_run").alias("_runs"), F.min_by("label", "_run").alias("_first"), F.max_by("label", "_run").alias("_last"))
    bw = Window.partitionBy("series_id").orderBy("blk")
    goes_on = F.when(F.col("_first") == F.lag("_last").over(bw), 1).otherwise(0)
    edges = edges.withColumn("_on", goes_on).withColumn("_base", F.sum(F.col("_runs") - F.col("_on")).over(bw) - F.col("_runs"))
    joined = pieces.join(edges.select("series_id", "blk", "_base"), ["series_id", "blk"]).withColumn("_id", F.col("_base") + F.col("_run"))
    runs = joined.filter(F.col("label") != "normal").groupBy("series_id", "_id").agg(
        F.first("label").alias("type"), F.min("_start").alias("_s"), F.max("_end").alias("_e"),
        (F.sum("_vol") / F.sum("_n")).alias("_avg"),
    )
    days = full_days(F.col("_s"), F.col("_e"))
    return runs.select(
        "series_id", "type", F.to_date("_s").alias("start"), F.to_date("_e").alias("end"),
        days.alias("duration_days"), F.round(F.col("_avg") * 100, 2).alias("avg_annual_vol"),
    ).filter(F.col("duration_days") >= min_days)


def full_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two times, independent of the session's time zone."""
    a, b = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    early = (b - F.to_date(b).cast("timestamp_ntz")) < (a - F.to_date(a).cast("timestamp_ntz"))
    return (F.datediff(b, a) - F.when(early, 1).otherwise(0)).cast("bigint")


def structural_breaks(
    indexed: DataFrame, window: int = 100, top: int = 10, size: int = BLOCK_ROWS
) -> DataFrame:
    """Largest changes of the cumulative-return slope beyond the 95th percentile, ``top`` per series."""
    w = series_window()
    # a running sum local to the block differs by a constant, which a slope ignores
    cum = _returns(indexed, window + 3, size).withColumn(
        "cum", F.sum(F.coalesce("ret", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    sloped = with_slope(cum, "cum", window, "slope", w)
    change = own_rows(sloped.withColumn("change", F.abs(F.col("slope") - F.lag("slope").over(w))))
    change = materialise(change.select("series_id", "ts", "change"))
    limit = exact_quantiles(change, ["series_id"], "change", {"_limit": 0.95})
    found = change.join(limit, "series_id").filter(F.col("change") > F.col("_limit")).select(
        "series_id", "ts", F.round(F.col("change") * 10000, 2).alias("magnitude")
    )
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("magnitude").desc(), "ts"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "series_id", F.to_date("ts").alias("date"), "magnitude", "rank"
    )


def spans(bars: DataFrame) -> DataFrame:
    """First and last time, whole days and years per series."""
    g = bars.groupBy("series_id").agg(
        F.min("ts").alias("date_from"), F.max("ts").alias("date_to"), F.count(F.lit(1)).alias("total_bars")
    )
    return g.withColumn("total_days", full_days(F.col("date_from"), F.col("date_to"))).withColumn(
        "total_years", F.round(F.col("total_days") / 365.25, 2)
    )


def _proposal(df: DataFrame, name: str, is_from: Column, is_to: Column, oos_from: Column, oos_to: Column,
              no: Column | None = None) -> DataFrame:
    return df.select(
        "series_id", F.lit(name).alias("proposal"), (no if no is not None else F.lit(1)).cast("int").alias("oos_no"),
        F.to_date(is_from).alias("is_from"), F.to_date(is_to).alias("is_to"),
        F.to_date(oos_from).alias("oos_from"), F.to_date(oos_to).alias("oos_to"),
    )


def simple_split(span: DataFrame, ratio: float = 0.6) -> DataFrame:
    """In-sample the first floor(days*ratio) days, out-of-sample the rest."""
    cut = F.date_add(F.to_date("date_from"), F.floor(F.col("total_days") * F.lit(ratio)).cast("int"))
    return _proposal(span, "simple_split", F.col("date_from"), cut, cut, F.col("date_to"))


def walk_forward(
    span: DataFrame, periods: int = 3, min_is_years: float = 3.0, min_oos_years: float = 1.5
) -> DataFrame:
    """One in-sample period and ``periods`` equal out-of-sample ranges, where the series is long enough."""
    if periods <= 1:
        return _proposal(span.filter(F.lit(False)), "walk_forward", *[F.col("date_from")] * 4)
    long_enough = F.col("total_days") / 365.25 >= min_is_years + min_oos_years * periods
    step = F.expr(f"int(total_days div {periods + 1})")
    start = F.to_date("date_from")
    rows = span.filter(long_enough).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    oos_from = F.date_add(start, step * (F.col("_i") + 1))
    oos_to = F.least(F.date_add(start, step * (F.col("_i") + 2)), F.to_date("date_to"))
    return _proposal(rows, "walk_forward", start, F.date_add(start, step), oos_from, oos_to, F.col("_i") + 1)


def regime_proposals(span: DataFrame, found: DataFrame) -> DataFrame:
    """Longest high- and low-volatility runs as out-of-sample ranges, and the full cycle."""
    order = F.struct("duration_days", (-F.datediff("start", F.lit("1970-01-01").cast("date"))).alias("early"))

    def longest(kind: str) -> Column:
        mine = F.col("type") == kind
        return F.max_by(F.struct("start", "end"), F.when(mine, order))

    per = found.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_runs"), longest("high_vol").alias("high"), longest("low_vol").alias("low"),
        F.min("start").alias("_first"), F.max("end").alias("_last"),
    )
    base = span.join(per, "series_id")
    start = F.col("date_from")
    parts = [
        _proposal(base.filter(F.col(f"{k}.start").isNotNull()), f"{k}_volatility", start, F.col(f"{k}.start"),
                  F.col(f"{k}.start"), F.col(f"{k}.end"))
        for k in ("high", "low")
    ]
    cycle = _proposal(base.filter(F.col("_runs") >= 2), "full_cycle", F.col("_first"), F.col("_last"),
                      F.col("_last"), F.col("date_to"))
    return parts[0].unionByName(parts[1]).unionByName(cycle)


def recommendation(span: DataFrame, found: DataFrame) -> DataFrame:
    """Split advice by length of history, with a note on regime diversity."""
    high = found.groupBy("series_id").agg(F.sum((F.col("type") == "high_vol").cast("bigint")).alias("high_runs"))
    y = F.col("total_years")

    def by_length(short, mid, long):
        return F.when(y < 3, F.lit(None)).when(y < 5, short).when(y < 8, mid).otherwise(long)

    joined = span.join(high, "series_id", "left").withColumn("high_runs", F.coalesce("high_runs", F.lit(0).cast("bigint")))
    return joined.select(
        "series_id", "total_years",
        F.coalesce(by_length(F.lit("conservative"), F.lit("walk_forward"), F.lit("robust_walk_forward")),
                   F.lit("insufficient_data")).alias("strategy"),
        F.coalesce(F.round(y * by_length(F.lit(0.7), F.lit(0.6), F.lit(0.5)), 1), F.lit(0.0)).alias("optimal_is_years"),
        F.coalesce(F.round(y * by_length(F.lit(0.3), F.lit(0.4), F.lit(0.5)), 1), F.lit(0.0)).alias("optimal_oos_years"),
        "high_runs", ((y >= 3) & (F.col("high_runs") >= 3)).alias("diverse"),
    )


def chosen_split(proposals: DataFrame) -> DataFrame:
    """The walk-forward proposal where there is one, else the simple split."""
    ranked = proposals.filter(F.col("proposal").isin("walk_forward", "simple_split"))
    best = F.max(F.col("proposal") == "walk_forward").over(Window.partitionBy("series_id"))
    return ranked.withColumn("_wf", best).filter(
        F.col("_wf") == (F.col("proposal") == "walk_forward")
    ).drop("_wf")


def signal_changes(proposed: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Signals to add (proposed only) and to drop (current only)."""
    add = proposed.select(*keys).distinct().join(current, keys, "left_anti").withColumn("change", F.lit("add"))
    drop = current.select(*keys).distinct().join(proposed, keys, "left_anti").withColumn("change", F.lit("drop"))
    return add.unionByName(drop)
