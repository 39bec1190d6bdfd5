"""Splitting long series: positions, blocks with halos, two-level scans, exact quantiles.

A series is never handled as one group.  Rows get a dense position within their
series, positions are cut into fixed-size blocks, and each block carries the few
neighbouring rows ("halo") its windows look at.  A series that holds a third of
all bars is then just many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import materialise

BLOCK_ROWS = 65_536
#: Consecutive blocks whose summaries are merged in one step.
FAN_IN = 64

SEGMENTS = {
    "day": lambda ts: F.to_date(ts),
    "month": lambda ts: F.trunc(F.to_date(ts), "month"),
    "year": lambda ts: F.trunc(F.to_date(ts), "year"),
}


def dense_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    segment: Column,
    position: str,
    total: str | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``, ordered by segment then ``order``.

    Two levels: rows are numbered inside their segment, and the segments' start
    offsets come from a running sum over one count per (keys, segment).
    ``segment`` must be monotone in ``order``.  ``extra`` columns are evaluated
    after the numbering, on the same partitioning.
    """
    keys = list(keys)
    seg = df.withColumn("_seg", segment)
    counts = seg.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*keys).orderBy("_seg")
    starts = counts.select(
        *keys,
        "_seg",
        (F.sum("_rows").over(w) - F.col("_rows")).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"),
    )
    local = seg.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order))
    )
    if extra:
        local = local.withColumns(extra)
    out = local.join(starts, [*keys, "_seg"]).withColumn(
        position, F.col("_start") + F.col("_local") - 1
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_seg", "_local", "_start", "_total")


def index_bars(bars: DataFrame, segment: str = "day") -> DataFrame:
    """Add ``bar_idx`` (position in the series) and ``n_bars``.

    ``segment`` is the calendar unit numbered by one task: "day" for intraday
    bars, "year" for daily bars.  Bars that carry both columns already (a stored
    indexed table) pass through.
    """
    if {"bar_idx", "n_bars"} <= set(bars.columns):
        return bars
    return dense_positions(
        bars, ["series_id"], ["ts"], SEGMENTS[segment](F.col("ts")), "bar_idx", "n_bars"
    )


def index_bars_with_vwap(bars: DataFrame) -> DataFrame:
    """``index_bars`` plus the session VWAP, which accumulates on the same (series, day) split.

    A stored table that has position and VWAP passes through.
    """
    if {"bar_idx", "n_bars", "vwap"} <= set(bars.columns):
        return bars
    bars = bars.drop("bar_idx", "n_bars")
    day = Window.partitionBy("series_id", "_seg").orderBy("ts").rowsBetween(
        Window.unboundedPreceding, 0
    )
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    vol = F.nullif(F.col("volume"), F.lit(0.0))
    return dense_positions(
        bars,
        ["series_id"],
        ["ts"],
        SEGMENTS["day"](F.col("ts")),
        "bar_idx",
        "n_bars",
        extra={
            "vwap": F.when(
                vol.isNotNull(), F.sum(tp * vol).over(day) / F.sum(vol).over(day)
            )
        },
    )


def to_blocks(
    bars: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK_ROWS, place: bool = True
) -> DataFrame:
    """Assign rows to blocks; rows near an edge are copied to the neighbours that look at them.

    Adds ``blk`` and ``own`` (false for halo copies).  ``back``/``ahead`` are the
    numbers of earlier/later rows a block needs.  ``place`` also brings each block
    together; leave it off where more rows are added first.
    """
    first = F.expr(f"greatest(bar_idx - {ahead}, 0L) div {size}")
    last = F.expr(f"least(bar_idx + {back}, n_bars - 1) div {size}")
    cut = bars.withColumn("blk", F.explode(F.sequence(first, last))).withColumn(
        "own", F.expr(f"bar_idx div {size}") == F.col("blk")
    )
    return spread(cut, "series_id", "blk") if place else cut


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` for a step whose cost is per row, not per byte.

    The partition count is the session's, and adaptive coalescing by size leaves it
    alone, so a few megabytes of blocks still use all cores.
    """
    conf = df.sparkSession.conf
    n = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get(
        "spark.sql.shuffle.partitions"
    )
    return df.repartition(int(n), *keys)


def merge_tree(
    parts: DataFrame, keys: Sequence[str], combine: Callable[[pa.Table], pa.Table], fan_in: int = FAN_IN
) -> list[DataFrame]:
    """Levels of an ordered merge: ``parts``, then summaries of ``fan_in`` consecutive blocks each, and so on.

    ``parts`` has the keys, ``blk`` and summary columns; ``combine`` gets the rows of up to ``fan_in`` blocks of one key, sorted
    by block, and returns the rows of their merger (any ``blk``).  The last level has fewer than ``fan_in`` blocks a key, so
    no task ever holds more of a key, however long its series.
    """
    levels = [materialise(parts)]
    last = levels[0].agg(F.max("blk").alias("last")).first().last
    shape, names = levels[0].schema, levels[0].columns

    def merged(table: pa.Table) -> pa.Table:
        up = table.column("up")[0]
        out = combine(table.drop_columns(["up"]).sort_by("blk"))
        place = pa.array([up.as_py()] * out.num_rows, pa.int64())
        return out.set_column(out.schema.get_field_index("blk"), "blk", place).select(names)

    while last is not None and last >= fan_in:
        grouped = levels[-1].withColumn("up", F.expr(f"blk div {fan_in}")).groupBy(*keys, "up")
        levels.append(materialise(grouped.applyInArrow(merged, shape)))
        last //= fan_in
    return levels


def own_rows(blocked: DataFrame) -> DataFrame:
    """Keep each row once, in its home block."""
    return blocked.filter("own").drop("own")


def chunk_paths(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    by: Sequence[str] = (),
    aggs: Sequence[Column] = (),
    chunk: int = 4096,
) -> DataFrame:
    """Summaries of consecutive pieces of each key's running sum of ``value``.

    A piece is at most ``chunk`` positions, and is also cut by the columns ``by``
    (monotone in ``position``, such as the year).  Each row carries the piece's
    count, sum, low point and drawdown, the path's level ``_base`` before it and the
    peak ``_top`` so far, plus the requested ``aggs`` over its rows.  The path
    starts at 0.
    """
    keys, by = list(keys), list(by)
    parts = df.withColumn("_chunk", F.floor(F.col(position) / chunk))
    w = Window.partitionBy(*keys, *by, "_chunk").orderBy(position).rowsBetween(
        Window.unboundedPreceding, 0
    )
    run = parts.withColumn("_cum", F.sum(value).over(w))
    run = run.withColumn("_peak", F.greatest(F.lit(0.0), F.max("_cum").over(w)))
    chunks = run.groupBy(*keys, *by, "_chunk").agg(
        F.count(value).alias("_n"),
        F.sum(value).alias("_sum"),
        F.min("_cum").alias("_low"),
        F.max("_peak").alias("_high"),
        F.min(F.col("_cum") - F.col("_peak")).alias("_dd"),
        *aggs,
    )
    before = Window.partitionBy(*keys).orderBy("_chunk", *by).rowsBetween(Window.unboundedPreceding, -1)
    based = chunks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    top = F.coalesce(F.max(F.col("_base") + F.col("_high")).over(before), F.lit(0.0))
    return based.withColumn("_top", F.greatest(F.lit(0.0), top))


def piece_drawdown() -> Column:
    """Deepest fall inside a piece of ``chunk_paths``, against the peak so far."""
    return F.least(F.lit(0.0), F.least(F.col("_dd"), F.col("_base") + F.col("_low") - F.col("_top")))


def path_stats(
    df: DataFrame, keys: Sequence[str], position: str, value: str, chunk: int = 4096
) -> DataFrame:
    """Final sum, lowest point and maximum drawdown of the running sum of ``value``.

    Three levels: positions in pieces of ``chunk``, pieces in stretches of ``chunk`` pieces, stretches in paths.  So no task
    orders more than ``chunk`` rows of a path of up to ``chunk`` cubed positions, however sparse they are.  Returns keys, n, total,
    low (<= 0) and max_dd (<= 0).
    """
    keys = list(keys)
    piece = F.floor(F.col(position) / chunk)
    rows = df.select(*keys, piece.alias("_piece"), F.col(position).alias("_at"), F.when(F.col(value).isNotNull(), 1).otherwise(0).alias("_n"),
                         F.coalesce(F.col(value), F.lit(0.0)).alias("_sum"))
    rows = rows.withColumns({"_low": F.least(F.lit(0.0), F.col("_sum")), "_high": F.greatest(F.lit(0.0), F.col("_sum")), "_dd": F.least(F.lit(0.0), F.col("_sum"))})
    level = _joined(rows, [*keys, "_piece"], "_at").withColumn("_stretch", F.floor(F.col("_piece") / chunk))
    level = _joined(level, [*keys, "_stretch"], "_piece")
    whole = _joined(level, keys, "_stretch")
    return whole.select(*keys, F.col("_n").alias("n"), F.col("_sum").alias("total"), F.col("_low").alias("low"), F.col("_dd").alias("max_dd"))


def _joined(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Paths of consecutive parts as one: count, sum, lowest and highest point against the start (0 included), deepest fall."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(w), F.lit(0.0)))
    topped = based.withColumn("_top", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_high")).over(w)))
    return topped.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"), F.min(F.col("_base") + F.col("_low")).alias("_low"),
        F.max(F.col("_base") + F.col("_high")).alias("_high"), F.min(F.least(F.col("_dd"), F.col("_base") + F.col("_low") - F.col("_top"))).alias("_dd"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
    rank: str = "linear",
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per group without gathering a group in one place.

    A bounded quantile sketch brackets each wanted rank, the bracket's values are
    counted, and the order statistics are read off inside the bracket.  ``rank``
    is "linear" (interpolated, position p*(n-1)), "floor" (the element at
    min(floor(p*n), n-1)) or "top" (the smallest of the top max(1, floor((1-p)*n))
    values).  Groups of at most ``accuracy`` rows are read whole.  NULL values are
    ignored; ``count`` names an extra column with the number of values.  A bracket that misses
    its rank raises an error.
    """
    keys = list(keys)
    vals = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    levels = sorted({x for p in probs.values() for x in (max(p - slack, 0.0), min(p + slack, 1.0))})
    sketch = vals.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(x) for x in levels]), accuracy).alias("_q"),
    )
    # the two ends of the sketch are replaced by the true extremes
    ends = {0.0: F.col("_min"), 1.0: F.col("_max")}
    names = {x: ends.get(x, F.col("_q")[i]) for i, x in enumerate(levels)}
    small = F.col("_n") <= accuracy
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            _rank(p, rank, "floor").alias("r0"),
            _rank(p, rank, "ceil").alias("r1"),
            _rank_fraction(p, rank).alias("frac"),
            F.when(small, F.col("_min")).otherwise(names[max(p - slack, 0.0)]).alias("lo"),
            F.when(small, F.col("_max")).otherwise(names[min(p + slack, 1.0)]).alias("hi"),
        )
        for name, p in probs.items()
    ])
    targets = sketch.select(*keys, F.col("_n"), F.explode(wanted).alias("t")).select(*keys, "_n", "t.*")
    # collapse equal values first; then cumulative counts inside each bracket
    counted = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # NULL group keys must meet themselves
    cond = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], F.lit(True))
    inside = counted.alias("c").join(targets.alias("t"), cond & (F.col("c._v") <= F.col("t.hi")))
    # everything under the bracket collapses into one NULL value before the shuffle
    collapsed = inside.select(
        *[F.col(f"t.{k}").alias(k) for k in keys], "name", "r0", "r1", "frac", "_n",
        F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v"), "_c",
    ).groupBy(*keys, "name", "_v").agg(
        F.sum("_c").alias("_c"), *[F.first(c).alias(c) for c in ("r0", "r1", "frac", "_n")]
    )
    ranked = collapsed.withColumn(
        "_end",
        F.sum("_c").over(
            Window.partitionBy(*keys, "name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    start = F.col("_end") - F.col("_c")
    picked = ranked.groupBy(*keys, "name").agg(
        F.max(F.when((F.col("r0") >= start) & (F.col("r0") < F.col("_end")), F.col("_v"))).alias("_a"),
        F.max(F.when((F.col("r1") >= start) & (F.col("r1") < F.col("_end")), F.col("_v"))).alias("_b"),
        F.max("frac").alias("frac"),
        F.max("_n").alias("_n"),
    )
    # the sketch promises its rank error; a bracket that misses its rank must never pass for an unknown value
    missed = F.col("_a").isNull() | F.col("_b").isNull()
    fail = F.raise_error(F.lit("quantile bracket missed its rank: raise the accuracy"))
    solved = picked.withColumn(
        "_x", F.when(missed, fail.cast("double")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("frac")))
    out = [F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in probs]
    if count:
        out.append(F.max("_n").alias(count))
    return solved.groupBy(*keys).agg(*out)


def _rank(p: float, rule: str, how: str) -> Column:
    n = F.col("_n")
    if rule == "floor":
        return F.least(F.floor(F.lit(float(p)) * n), n - 1)
    if rule == "top":
        return n - F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(1 - float(p)) * n + F.lit(1e-9)))
    at = F.lit(float(p)) * (n - 1)
    return F.floor(at) if how == "floor" else F.ceil(at)


def _rank_fraction(p: float, rule: str) -> Column:
    if rule != "linear":
        return F.lit(0.0)
    at = F.lit(float(p)) * (F.col("_n") - 1)
    return at - F.floor(at)
