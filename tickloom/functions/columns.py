"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full_window(how, x: Column | str, w: WindowSpec, n: int) -> Column:
    """Rolling aggregate over the last ``n`` rows, NULL unless all ``n`` values are present.

    ``w`` is a partitioned and ordered window without a frame.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    x = as_col(x)
    return F.when(F.count(x).over(frame) == n, how(x).over(frame))


def sma(x, w: WindowSpec, n: int) -> Column:
    return full_window(F.avg, x, w, n)


def rolling_std(x, w: WindowSpec, n: int) -> Column:
    return full_window(F.stddev_samp, x, w, n)


def rolling_min(x, w: WindowSpec, n: int) -> Column:
    return full_window(F.min, x, w, n)


def rolling_max(x, w: WindowSpec, n: int) -> Column:
    return full_window(F.max, x, w, n)


def no_zero(x: Column | str) -> Column:
    """0 becomes NULL, so that a division by it is missing instead of an error."""
    return F.nullif(as_col(x), F.lit(0.0))


def is_true(cond: Column) -> Column:
    """Missing comparisons count as false."""
    return F.coalesce(cond, F.lit(False))


# Coefficients of the rational Chebyshev fit of erfc from
# Numerical Recipes (relative error below 1.2e-7 everywhere).
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc_of_magnitude(x: Column) -> Column:
    """erfc for x >= 0 as one Horner expression (no UDF)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_p(t_stat: Column) -> Column:
    """Two-sided normal p-value of a t-statistic."""
    return erfc_of_magnitude(F.abs(t_stat) / F.sqrt(F.lit(2.0)))


def wilson_bounds(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a proportion, clamped to [0, 1]; (0, 0) for n <= 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = wins / m
    z2 = z * z
    spread = z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    scale = 1 + z2 / m
    mid = p + z2 / (2 * m)
    lower = F.greatest(F.lit(0.0), (mid - spread) / scale)
    upper = F.least(F.lit(1.0), (mid + spread) / scale)
    return (
        F.when(n > 0, lower).otherwise(F.lit(0.0)),
        F.when(n > 0, upper).otherwise(F.lit(0.0)),
    )


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``select`` of columns that are costly to compute: later filters and columns read their values instead of repeating them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def norm_symbol(name: Column | str) -> Column:
    """Strip broker suffixes (_exness, m, c) until none is left."""
    return F.regexp_replace(as_col(name), r"(_exness|[mc])+$", "")


def hour_between(ts: Column | str, lo: int | None, hi: int | None) -> Column:
    """Inclusive hour-of-day window; None bounds mean the whole day."""
    if lo is None or hi is None:
        return F.lit(True)
    return F.hour(as_col(ts)).between(lo, hi)


def number_of(raw: Column | str) -> Column:
    """Tolerant number parse: currency and percent signs, thousands commas, blanks.

    Text that is no number gives NULL; ``text_of`` keeps it.
    """
    s = _stripped(raw)
    thousands = s.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$")
    return F.when(thousands, F.regexp_replace(s, ",", "")).otherwise(s).try_cast("double")


def text_of(raw: Column | str) -> Column:
    """The cleaned text where it is neither a number nor one of the blank marks."""
    s = _stripped(raw)
    blank = s.isin("", "-", "N/A")
    return F.when(~blank & number_of(raw).isNull(), s)


def _stripped(raw: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(as_col(raw)), r"[%$]", ""))


def series_window(*extra: str) -> WindowSpec:
    """The canonical ordered window inside one block of one series."""
    return Window.partitionBy("series_id", "blk", *extra).orderBy("bar_idx")
