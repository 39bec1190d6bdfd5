"""In-sample / out-of-sample flags from positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def check_split(split: float) -> None:
    if not 0.05 < split < 0.95:
        raise ValueError("split must lie between 0.05 and 0.95")


def quantile_cut(indexed: DataFrame, split: float = 0.6, out: str = "is_sample") -> DataFrame:
    """True up to the interpolated ``split`` quantile of the bar times.

    The times of a series are distinct and sorted, so the bars at or before the
    quantile are exactly those with position <= (n-1)*split: no quantile is computed.
    """
    check_split(split)
    return indexed.withColumn(out, F.col("bar_idx") <= F.floor((F.col("n_bars") - 1) * F.lit(split)))


def position_cut(indexed: DataFrame, split: float = 0.6, out: str = "is_sample") -> DataFrame:
    """True up to the bar at position floor(n*split); at most one bar later than ``quantile_cut``."""
    check_split(split)
    return indexed.withColumn(out, F.col("bar_idx") <= F.floor(F.col("n_bars") * F.lit(split)))
