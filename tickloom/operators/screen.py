"""Signal statistics: Newey-West t-statistics, screens, baselines, hour profiles.

The screen never explodes bars by condition.  Each block of a series is reduced
to one small mergeable summary per (condition, horizon, scope): count, sum, sum
of squares, Bartlett-weighted lag products, and the first and last ``horizon-1``
values.  Summaries of consecutive blocks are merged in order; the seam products
come from the stored edges, so the result equals the statistic of the whole
compacted sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import hour_between, no_zero, two_sided_p
from tickloom.functions.conditions import condition_names, signal_bits
from tickloom.operators.blocks import FAN_IN, merge_tree
from tickloom.operators.splits import quantile_cut

SCOPES = ("all", "is", "oos")
BASELINE = -1
SUMMARY_SCHEMA = (
    "series_id string, signal_id int, blk bigint, horizon int, scope string, lag int, n bigint, "
    "s1 double, s2 double, cross double, head array<double>, tail array<double>"
)
MERGED_SCHEMA = "series_id string, signal_id int, horizon int, scope string, n bigint, mean double, t_stat double"

MERGED_ARROW = pa.schema([
    ("series_id", pa.string()), ("signal_id", pa.int32()), ("horizon", pa.int32()), ("scope", pa.string()),
    ("n", pa.int64()), ("mean", pa.float64()), ("t_stat", pa.float64()),
])


def bartlett(lag: int) -> np.ndarray:
    return 1.0 - np.arange(1, lag + 1) / (lag + 1.0)


def lag_products(x: np.ndarray, lag: int) -> float:
    """Sum over j of w_j * sum_t x_t x_{t-j}."""
    return float(sum(w * (x[j:] @ x[:-j]) for j, w in enumerate(bartlett(lag), 1) if j < len(x)))


def seam_products(tail: np.ndarray, head: np.ndarray, lag: int) -> float:
    """The lag products whose two values lie on different sides of a seam."""
    joined = np.concatenate([tail, head])
    return lag_products(joined, lag) - lag_products(tail, lag) - lag_products(head, lag)


def summarise(x: np.ndarray, lag: int) -> tuple:
    return len(x), float(x.sum()), float(x @ x), lag_products(x, lag), x[:lag].tolist(), x[len(x) - min(lag, len(x)):].tolist()


def t_of_summary(n: int, s1: float, s2: float, cross: float, head, tail, lag: int) -> tuple[float, float]:
    """Mean and Newey-West t-statistic; 0 for fewer than three values or no variance."""
    mean = s1 / n
    if n < 3:
        return mean, 0.0
    spread = s2 - n * mean * mean
    for j, w in enumerate(bartlett(lag), 1):
        if j >= n:
            break
        # centring: every lag misses the first (last) j values on one side
        spread -= 2 * w * mean * (2 * s1 - sum(head[:j]) - sum(tail[len(tail) - j:]))
        spread += 2 * w * mean * mean * (n - j)
    spread += 2 * cross
    long_run = spread / n
    return mean, mean / float(np.sqrt(long_run / n)) if long_run > 1e-12 * s2 / n else 0.0


def block_summaries(bits: DataFrame, horizons: Sequence[int], n_signals: int) -> DataFrame:
    """One summary per block, condition, horizon and scope (plus the all-bars baseline, lag 0)."""
    horizons = list(horizons)

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        series_id, blk = pdf["series_id"].iat[0], int(pdf["blk"].iat[0])
        packed = pdf["bits"].to_numpy(dtype="int64")
        in_sample = pdf["is_sample"].to_numpy(dtype=bool)
        scopes = {"all": np.ones(len(pdf), bool), "is": in_sample, "oos": ~in_sample}
        out = []
        for h in horizons:
            fwd = pdf[f"fwd{h}"].to_numpy(dtype="float64")
            known = ~np.isnan(fwd)
            if known.any():
                out.append((series_id, BASELINE, blk, h, "all", 0, *summarise(fwd[known], 0)))
            for k in range(n_signals):
                hit = known & ((packed >> k) & 1).astype(bool)
                if not hit.any():
                    continue
                for scope, member in scopes.items():
                    x = fwd[hit & member]
                    if len(x):
                        out.append((series_id, k, blk, h, scope, h - 1, *summarise(x, h - 1)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in SUMMARY_SCHEMA.split(", ")])

    return bits.groupBy("series_id", "blk").applyInPandas(reduce_block, SUMMARY_SCHEMA)


_STATE = ("lag", "n", "s1", "s2", "cross", "head", "tail")


def _in_order(table: pa.Table) -> dict[tuple, tuple]:
    """Summaries of consecutive blocks merged, by horizon and scope."""
    rows, states = table.to_pydict(), {}
    for h, scope, lag, n, s1, s2, cross, head, tail in zip(rows["horizon"], rows["scope"], *(rows[f] for f in _STATE)):
        head, tail = np.asarray(head, float), np.asarray(tail, float)
        if (h, scope) in states:
            _, n0, s10, s20, cross0, head0, tail0 = states[h, scope]
            cross += cross0 + seam_products(tail0, head, lag)
            n, s1, s2 = n0 + n, s10 + s1, s20 + s2
            head = np.concatenate([head0, head])[:lag]
            both = np.concatenate([tail0, tail])
            tail = both[len(both) - min(lag, len(both)):]
        states[h, scope] = (lag, n, s1, s2, cross, head, tail)
    return states


def merge_summaries(summaries: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Combine the block summaries of each condition in block order, ``fan_in`` blocks at a time."""
    keys = ("series_id", "signal_id")

    def combine(table: pa.Table) -> pa.Table:
        states = _in_order(table)
        first = [{**{k: table.column(k)[0].as_py() for k in keys}, "blk": 0, "horizon": h, "scope": scope,
                  **{f: v.tolist() if isinstance(v, np.ndarray) else v for f, v in zip(_STATE, state)}} for (h, scope), state in states.items()]
        return pa.Table.from_pylist(first, schema=table.schema)

    def finish(table: pa.Table) -> pa.Table:
        series_id, signal_id = (table.column(k)[0].as_py() for k in keys)
        out = [(series_id, signal_id, h, scope, n, *t_of_summary(n, s1, s2, cross, head, tail, lag))
               for (h, scope), (lag, n, s1, s2, cross, head, tail) in _in_order(table.sort_by("blk")).items()]
        return pa.table(dict(zip(MERGED_ARROW.names, zip(*out))), schema=MERGED_ARROW)

    return merge_tree(summaries, keys, combine, fan_in)[-1].groupBy(*keys).applyInArrow(finish, MERGED_SCHEMA)


def check_direction(direction: str) -> None:
    if direction not in ("short", "long"):
        raise ValueError("direction must be 'short' or 'long'")


def edge_of(mean: Column, direction: str) -> Column:
    """Return seen from the trade's side."""
    check_direction(direction)
    return -mean if direction == "short" else mean


def signal_moments(
    bars: DataFrame,
    window: tuple[int, int] | None = (12, 20),
    horizons: Sequence[int] = (4, 8, 24),
    split: float = 0.6,
    **blocks,
) -> DataFrame:
    """n, mean forward return and t-statistic per condition, horizon and scope; id -1 is the baseline."""
    lo, hi = window or (None, None)
    flagged = quantile_cut(signal_bits(bars, horizons, **blocks), split)
    inside = flagged.filter(hour_between("ts", lo, hi)).select(
        "series_id", "blk", "bar_idx", "bits", "is_sample", *[f"fwd{h}" for h in horizons]
    )
    return merge_summaries(block_summaries(inside, horizons, len(condition_names())))


def baseline_drift(moments: DataFrame, min_n: int = 10) -> DataFrame:
    """Statistics of all bars in the window; NULL under ``min_n`` bars."""
    enough = F.col("n") >= min_n
    return moments.filter(F.col("signal_id") == BASELINE).select(
        "series_id", "horizon", "n",
        F.when(enough, 100 * F.col("mean")).alias("mean_fwd_pct"),
        F.when(enough, F.col("t_stat")).alias("t_stat"),
        F.when(enough, two_sided_p(F.col("t_stat"))).alias("p_value"),
    )


def screen_from_moments(moments: DataFrame, direction: str = "short", min_n: int = 50) -> DataFrame:
    """One row per condition and horizon with full, in-sample and out-of-sample evidence."""
    half_n = max(min_n // 2, 15)
    names = F.create_map(*[
        x for k, (f, s) in enumerate(condition_names())
        for x in (F.lit(k), F.struct(F.lit(f).alias("family"), F.lit(s).alias("signal")))
    ])

    def at(scope: str, value: str) -> Column:
        limit = min_n if scope == "all" else half_n
        return F.max(F.when((F.col("scope") == scope) & (F.col("n") >= limit), F.col(value)))

    # the baseline rides along over at most 550 summary rows per (series, horizon)
    is_base = (F.col("signal_id") == BASELINE) & (F.col("n") >= 10)
    with_base = moments.withColumn(
        "base_mean_pct",
        F.max(F.when(is_base, 100 * F.col("mean"))).over(Window.partitionBy("series_id", "horizon")),
    )
    rows = with_base.filter(F.col("signal_id") != BASELINE).groupBy("series_id", "signal_id", "horizon").agg(
        F.max("base_mean_pct").alias("base_mean_pct"),
        at("all", "n").alias("n"),
        (100 * at("all", "mean")).alias("mean_fwd_pct"),
        at("all", "t_stat").alias("t_stat"),
        (100 * at("is", "mean")).alias("is_mean_pct"),
        two_sided_p(at("is", "t_stat")).alias("is_p"),
        (100 * at("oos", "mean")).alias("oos_mean_pct"),
        two_sided_p(at("oos", "t_stat")).alias("oos_p"),
    ).filter(F.col("n").isNotNull())
    p = two_sided_p(F.col("t_stat"))
    edge = edge_of(F.col("mean_fwd_pct"), direction)
    return rows.select(
        "series_id", names[F.col("signal_id")]["family"].alias("family"),
        names[F.col("signal_id")]["signal"].alias("signal"), "horizon", "n", "mean_fwd_pct",
        edge.alias("edge_pct"), "t_stat", p.alias("p_value"), (p < 0.05).alias("significant"),
        (edge > 0).alias("favourable"), "base_mean_pct", "is_mean_pct", "is_p", "oos_mean_pct", "oos_p",
    )


def screen(
    bars: DataFrame,
    window: tuple[int, int] | None = (12, 20),
    horizons: Sequence[int] = (4, 8, 24),
    min_n: int = 50,
    direction: str = "short",
    split: float = 0.6,
    **blocks,
) -> DataFrame:
    """Edge of all catalogue conditions on all horizons."""
    check_direction(direction)
    return screen_from_moments(signal_moments(bars, window, horizons, split, **blocks), direction, min_n)


def highlights(screened: DataFrame, direction: str = "short", contrary_limit: int = 10) -> DataFrame:
    """Significant rows grouped as robust, significant or contrary, ranked per series.

    Robust rows also have a positive edge in both halves.  Contrary rows are the
    ``contrary_limit`` worst ones.  A robust row also appears as significant.
    """
    ranked = screened.filter("significant")
    both = is_robust(direction)
    kinds = F.array_compact(F.array(
        F.when(F.col("favourable"), F.lit("significant")),
        F.when(F.col("favourable") & both, F.lit("robust")),
        F.when(~F.col("favourable"), F.lit("contrary")),
    ))
    tagged = ranked.withColumn("highlight", F.explode(kinds))
    order = F.when(F.col("highlight") == "contrary", F.col("edge_pct")).otherwise(-F.col("edge_pct"))
    w = Window.partitionBy("series_id", "highlight").orderBy(order, "signal", "horizon")
    return tagged.withColumn("rank", F.row_number().over(w)).filter(
        (F.col("highlight") != "contrary") | (F.col("rank") <= contrary_limit)
    )


def is_robust(direction: str) -> Column:
    both = (edge_of(F.col("is_mean_pct"), direction) > 0) & (edge_of(F.col("oos_mean_pct"), direction) > 0)
    return F.coalesce(both, F.lit(False))


def false_positive_budget(screened: DataFrame) -> DataFrame:
    """Tests made, significant results, and how many chance alone explains at p < 0.05."""
    return screened.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("tests"),
        F.sum(F.col("significant").cast("int")).alias("significant"),
        (0.05 * F.count(F.lit(1))).alias("expected_by_chance"),
    )


# hour-of-day tables: bounded results, one partial aggregate per split


def hour_profile(basics: DataFrame, min_n: int = 30) -> DataFrame:
    """Mean return, naive t and p, and mean range per hour with at least ``min_n`` returns."""
    by_hour = basics.groupBy("series_id", F.hour("ts").alias("hour")).agg(
        F.count("ret").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        F.avg("range_pct").alias("range_mean"),
    ).filter(F.col("n") >= min_n)
    t = F.coalesce(F.col("mean") / (no_zero("sd") / F.sqrt(F.col("n").cast("double"))), F.lit(0.0))
    tested = by_hour.withColumn("t", t).withColumn("p", two_sided_p(F.col("t")))
    w = Window.partitionBy("series_id").orderBy(F.round("range_mean", 3).desc(), "hour")
    return tested.select(
        "series_id", "hour", "n",
        F.round("range_mean", 3).alias("avg_range_pct"),
        F.round(F.col("mean") * 100, 4).alias("avg_return_pct"),
        F.round("t", 2).alias("t_stat"),
        F.round("p", 4).alias("p_value"),
        (F.col("p") < 0.05).alias("significant"),
        (F.row_number().over(w) <= 5).alias("most_volatile"),
    )


def hour_ranges(basics: DataFrame, top: int = 5, bottom: int = 3) -> DataFrame:
    """Range statistics of the most and least volatile hours."""
    by_hour = basics.groupBy("series_id", F.hour("ts").alias("hour")).agg(
        F.avg("range_pct").alias("avg_range"),
        F.stddev_samp("range_pct").alias("std_range"),
        F.count("range_pct").alias("n"),
    )
    p = Window.partitionBy("series_id")
    ranked = by_hour.withColumns({
        "rank_high": F.row_number().over(p.orderBy(F.col("avg_range").desc(), "hour")),
        "rank_low": F.row_number().over(p.orderBy("avg_range", "hour")),
    })
    return ranked.filter((F.col("rank_high") <= top) | (F.col("rank_low") <= bottom))


def liquid_hours(profile: DataFrame) -> DataFrame:
    """Hours at or above the unweighted mean of the hours' mean ranges."""
    mean = F.avg("avg_range_pct").over(Window.partitionBy("series_id"))
    return profile.select("series_id", "hour", "avg_range_pct", mean.alias("mean_range_pct"),
                          (F.col("avg_range_pct") >= mean).alias("liquid"))


def market_summary(basics: DataFrame) -> DataFrame:
    """Counts, span, volatility and candle-pattern shares per series."""
    def share(cond: Column) -> Column:
        return 100 * F.avg(F.coalesce(cond, F.lit(False)).cast("int"))

    return basics.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_bars"),
        F.min("ts").alias("date_from"),
        F.max("ts").alias("date_to"),
        F.avg("close").alias("avg_close"),
        (100 * F.stddev_samp("ret")).alias("bar_volatility_pct"),
        F.avg("range_pct").alias("avg_range_pct"),
        F.max("range_pct").alias("max_range_pct"),
        F.min("range_pct").alias("min_range_pct"),
        share(F.col("body_pct") < 20).alias("doji_pct"),
        share(F.col("upper_wick") > 2 * F.col("body")).alias("short_rejection_pct"),
        share(F.col("lower_wick") > 2 * F.col("body")).alias("long_lower_wick_pct"),
    )


def stop_distance(last_atr: DataFrame, stop: float = 2.0, target: float = 4.0) -> DataFrame:
    """Suggested stop and target distances; NULL where the ATR is missing or zero."""
    atr = F.when(F.col("last_atr") > 0, F.col("last_atr"))
    return last_atr.select("series_id", (stop * atr).alias("stop_distance"), (target * atr).alias("target_distance"))


# The hour windows (inclusive, UTC) of the documented session-share table.
SESSION_WINDOWS = (("00-08", 0, 8), ("12-15", 12, 15), ("12-20", 12, 20), ("00-23", 0, 23))


def session_shares(basics: DataFrame, windows=SESSION_WINDOWS) -> DataFrame:
    """Mean bar range per hour window, with the window's share of all bars and of all range.

    Windows may overlap; bars are first reduced to 24 hourly rows per series.
    """
    by_hour = basics.groupBy("series_id", F.hour("ts").alias("hour")).agg(
        F.sum("range_pct").alias("range"), F.count("range_pct").alias("bars")
    )
    p = Window.partitionBy("series_id")
    totals = by_hour.withColumns({"all_bars": F.sum("bars").over(p), "all_range": F.sum("range").over(p)})
    member = F.array_compact(F.array(*[
        F.when(F.col("hour").between(a, b), F.lit(name)) for name, a, b in windows
    ]))
    return totals.withColumn("bucket", F.explode(member)).groupBy("series_id", "bucket").agg(
        F.sum("bars").alias("n"),
        (F.sum("range") / no_zero(F.sum("bars").cast("double"))).alias("avg_range_pct"),
        (100 * F.sum("bars") / F.max("all_bars")).alias("share_of_bars_pct"),
        (100 * F.sum("range") / no_zero(F.max("all_range"))).alias("share_of_range_pct"),
    )
