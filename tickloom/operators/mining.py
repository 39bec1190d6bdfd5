"""The level x trigger matrix: entries, outcomes over a rule grid, naive baseline, gates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import hour_between
from tickloom.functions.recursive import WARMUP, fold_columns
from tickloom.operators.blocks import BLOCK_ROWS, chunk_paths, index_bars, piece_drawdown, to_blocks
from tickloom.operators.levels import fired_cells, first_per_day, prepare
from tickloom.operators.outcomes import MAIN, MATRIX_RULES, TRAILS, ExitRule, outcome_columns, with_outcomes
from tickloom.operators.splits import check_split, position_cut

CELL = ("series_id", "level", "trigger")
Hours = tuple[int, int] | None

# The named hour windows (inclusive, UTC; None = whole day).
DEFAULT_WINDOWS: tuple[tuple[str, Hours], ...] = (
    ("24h", None), ("12-20", (12, 20)), ("13-19", (13, 19)), ("14-20", (14, 20)), ("15-20", (15, 20)),
    ("8-20", (8, 20)), ("8-22", (8, 22)), ("0-12", (0, 12)), ("20-23", (20, 23)),
)


def _bounds(window: Hours) -> tuple[int | None, int | None]:
    return window if window is not None else (None, None)


def _flag(entries: DataFrame, split: float) -> DataFrame:
    check_split(split)
    return entries.withColumn("is_sample", F.col("entry_idx") <= F.floor(F.col("n_bars") * F.lit(split)))


def cell_entries(prepared: DataFrame, window: Hours = (12, 20), split: float = 0.6, **cells) -> DataFrame:
    """At most one entry per day for every (level, trigger) cell."""
    fired = fired_cells(prepared.filter(hour_between("ts", *_bounds(window))), **cells)
    return _flag(first_per_day(fired, ["level", "trigger"]), split)


def window_entries(
    prepared: DataFrame, windows: Sequence[tuple[str, Hours]] = DEFAULT_WINDOWS, split: float = 0.6, **cells
) -> DataFrame:
    """Entries per cell and named hour window; a bar counts in every window that holds its hour."""
    member = F.array_compact(F.array(*[
        F.when(hour_between("ts", *_bounds(w)), F.lit(name)) for name, w in windows
    ]))
    fired = fired_cells(prepared, **cells).withColumn("window", F.explode(member))
    return _flag(first_per_day(fired, ["level", "trigger", "window"]), split)


def naive_trades(
    bars: DataFrame,
    window: Hours = (12, 20),
    split: float = 0.6,
    rules: Sequence[ExitRule] = MATRIX_RULES,
    size: int = BLOCK_ROWS,
    warmup: int = WARMUP,
) -> DataFrame:
    """First usable bar of each day with the same exit rules, for the whole series and for each half.

    A half is a series of its own: its ATR warms up afresh and its trades end with it.
    """
    indexed = position_cut(index_bars(bars), split)
    cut = F.floor(F.col("n_bars") * F.lit(split)) + 1
    inside = F.col("is_sample")
    half = F.struct(
        F.when(inside, F.lit("is")).otherwise(F.lit("oos")).alias("part"),
        F.when(inside, F.col("bar_idx")).otherwise(F.col("bar_idx") - cut).alias("bar_idx"),
        F.when(inside, F.least(cut, F.col("n_bars"))).otherwise(F.col("n_bars") - cut).alias("n_bars"),
    )
    whole = F.struct(F.lit("all").alias("part"), "bar_idx", "n_bars")
    parts = indexed.withColumn("_p", F.explode(F.array(whole, half))).select(
        F.concat_ws("#", "series_id", "_p.part").alias("series_id"), "ts", "open", "high", "low", "close",
        "volume", "_p.bar_idx", "_p.n_bars",
    )
    folded = fold_columns(
        to_blocks(parts, back=warmup, size=size), ["atr"], keep=["ts", "n_bars", "high", "low", "close"], size=size
    ).withColumn("day", F.to_date("ts"))
    entries = first_per_day(folded.filter(hour_between("ts", *_bounds(window))), [])
    traded = with_outcomes(parts, entries, rules, size, store=True)
    return traded.withColumns({
        "part": F.substring_index("series_id", "#", -1),
        "series_id": F.expr("left(series_id, length(series_id) - length(substring_index(series_id, '#', -1)) - 1)"),
    })


def naive_baseline(bars: DataFrame, window: Hours = (12, 20), split: float = 0.6, **blocks) -> DataFrame:
    """Mean R of the naive entry: whole series, mirror, and both halves, one row per series."""
    rules = [r for r in MATRIX_RULES if r.name in (MAIN, "mirror")]
    t = naive_trades(bars, window, split, rules, **blocks)

    def mean(part: str, rule: str) -> Column:
        return F.avg(F.when(F.col("part") == part, F.col(rule)))

    return t.groupBy("series_id").agg(
        F.sum((F.col("part") == "all").cast("bigint")).alias("n_base"),
        mean("all", MAIN).alias("r_base"), mean("all", "mirror").alias("mirror_base"),
        mean("is", MAIN).alias("is_base"), mean("oos", MAIN).alias("oos_base"),
    )


def mine(
    bars: DataFrame,
    window: Hours = (12, 20),
    split: float = 0.6,
    min_n: int = 100,
    size: int = BLOCK_ROWS,
    warmup: int = WARMUP,
) -> DataFrame:
    """The matrix: all levels x triggers x exit rules, with excess over the naive baseline.

    Entry tables are written once; pass stored indexed bars (``index_bars_with_vwap``)
    so that they are not numbered again for every pass.
    """
    prepared = prepare(bars, size, warmup)
    entries = cell_entries(prepared, window, split)
    trades = with_outcomes(index_bars(bars), entries, MATRIX_RULES, size, store=True).withColumn("r", F.col(MAIN))
    matrix = matrix_stats(trades, min_n)
    base = naive_baseline(bars, window, split, size=size, warmup=warmup)
    return with_excess(matrix, base)


def matrix_stats(trades: DataFrame, min_n: int = 100) -> DataFrame:
    """Per-cell statistics of trades that carry one R column per rule.

    One pass: trades are reduced to pieces of a year, pieces to years, years to
    the cell; only the first step shuffles trades.
    """
    rules = [f"trail_{t}".replace(".", "") for t in TRAILS] + ["mirror"]
    inside = F.col("is_sample")
    sums = {
        "_wins": (F.col("r") > 0).cast("bigint"),
        "_is_n": inside.cast("bigint"), "_is_sum": F.when(inside, F.col("r")),
        "_oos_n": (~inside).cast("bigint"), "_oos_sum": F.when(~inside, F.col("r")),
        **{f"_s_{n}": F.col(n) for n in rules},
    }
    pieces = chunk_paths(
        trades.withColumn("year", F.year("entry_ts")), CELL, "entry_idx", "r", by=["year"],
        aggs=[*[F.sum(c).alias(n) for n, c in sums.items()],
              F.min("entry_ts").alias("_first"), F.max("entry_ts").alias("_last")],
    )
    years = pieces.groupBy(*CELL, "year").agg(
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.min(piece_drawdown()).alias("_dd"),
        *[F.sum(n).alias(n) for n in sums], F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    )
    n, total = F.sum("_n"), F.sum("_sum")
    days = F.datediff(F.max("_last"), F.min("_first")).cast("double")
    positive = sum(((F.sum(f"_s_{r}") > 0).cast("int") for r in rules if r != "mirror"), F.lit(0))
    return years.groupBy(*CELL).agg(
        n.alias("n"),
        (n / F.nullif(days / 365.25, F.lit(0.0))).alias("per_year"),
        (100 * F.sum("_wins") / n).alias("win_pct"),
        (total / n).alias("r_short"),
        (F.sum("_is_sum") / F.nullif(F.sum("_is_n"), F.lit(0))).alias("is_r"),
        (F.sum("_oos_sum") / F.nullif(F.sum("_oos_n"), F.lit(0))).alias("oos_r"),
        positive.alias("trails_positive"),
        (F.sum("_s_mirror") / n).alias("r_mirror"),
        F.min("_dd").alias("max_dd"),
        F.sum((F.col("_sum") > 0).cast("bigint")).alias("positive_years"),
        F.count(F.lit(1)).alias("years"),
        F.when(total != 0, 100 * F.max("_sum") / total).alias("best_year_share_pct"),
    ).filter(F.col("n") >= min_n)


def with_excess(matrix: DataFrame, base: DataFrame) -> DataFrame:
    """Excess over the naive baseline (one row per series)."""
    return matrix.join(base, "series_id", "left").withColumns({
        "excess": F.col("r_short") - F.col("r_base"),
        "excess_is": F.col("is_r") - F.col("is_base"),
        "excess_oos": F.col("oos_r") - F.col("oos_base"),
        "mirror_vs_base": F.col("r_mirror") - F.col("mirror_base"),
    })


def apply_gates(mined: DataFrame, min_n: int = 100, stable_trails: int = 3) -> DataFrame:
    """Five robustness gates; a missing comparison fails its gate."""
    gates = {
        "sample": F.col("n") >= min_n,
        "beats_naive": F.col("excess") > 0,
        "both_halves": (F.col("excess_is") > 0) & (F.col("excess_oos") > 0),
        "stable": F.col("trails_positive") >= stable_trails,
        "directional": F.col("mirror_vs_base") <= 0,
    }
    passed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in gates.items()]))
    return mined.withColumn("gates", passed).withColumn("n_gates", F.size("gates"))


def scan_windows(trades: DataFrame, min_n: int = 40) -> DataFrame:
    """Cell x window results; a window is eligible only if both halves are positive."""
    keys = [*CELL, "window"]
    g = trades.groupBy(*keys).agg(
        F.count("r").alias("n"), (100 * F.avg((F.col("r") > 0).cast("int"))).alias("win_pct"),
        F.avg("r").alias("r_per_trade"),
        F.avg(F.when(F.col("is_sample"), F.col("r"))).alias("is_r"),
        F.avg(F.when(~F.col("is_sample"), F.col("r"))).alias("oos_r"),
    ).filter(F.col("n") >= min_n)
    both = F.coalesce((F.col("is_r") > 0) & (F.col("oos_r") > 0), F.lit(False))
    return g.withColumn("eligible", both)


def hour_effect(scanned: DataFrame, with_: str, without: str) -> DataFrame:
    """The same cells in two windows side by side (for example with and without 00 h)."""
    def at(window: str, c: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(c)))

    return scanned.groupBy(*CELL).agg(
        at(with_, "n").alias("n_with"), at(without, "n").alias("n_without"),
        at(with_, "r_per_trade").alias("r_with"), at(without, "r_per_trade").alias("r_without"),
        (at(without, "r_per_trade") - at(with_, "r_per_trade")).alias("effect"),
    ).filter(F.col("n_with").isNotNull() & F.col("n_without").isNotNull())
