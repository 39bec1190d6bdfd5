"""Bootstrap resampling of trade results (with replacement) and its fragility report."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickloom.operators.blocks import dense_positions, path_stats, spread
from tickloom.session import materialise

#: Trades of a group that travel in one row, and runs that one row of them serves.
GATHERED, RUNS = 65_536, 16


def number_trades(trades: DataFrame, keys: Sequence[str], order: str = "entry_idx") -> DataFrame:
    """Finite results with a dense sequence number and the group's size."""
    r = F.col("r")
    finite = trades.filter(r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")))
    kept = finite.select(*keys, order, "r")
    return dense_positions(kept, keys, [order], F.floor(F.col(order) / 4096), "seq", "n_trades").drop(order)


def resample(numbered: DataFrame, keys: Sequence[str], n_runs: int = 1000, seed: int = 1) -> DataFrame:
    """``n_runs`` paths of n draws each: (keys, run, k, r).

    Every trade's own number serves as draw position k, so the draws are made where
    the trades lie; the drawn index is a hash of (seed, keys, run, k), which any engine
    reproduces and which makes the groups' draws independent, and an equi join on (keys, index) fetches the results.  The slim
    trades are spread before they are multiplied.
    """
    keys = list(keys)
    draws = spread(numbered, *keys, "seq").select(
        *keys, F.col("seq").alias("k"), "n_trades", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run")
    )
    index = _drawn(seed, keys, F.col("run"), F.col("k"), F.col("n_trades"))
    drawn = draws.select(*keys, "run", "k", index.alias("seq"))
    # the trades are the build side; left alone, Spark takes the draws for small, since it doesn't see what explode adds
    fetched = numbered.select(*keys, "seq", "r").hint("shuffle_hash")
    return drawn.join(fetched, [*keys, "seq"]).select(*keys, "run", "k", "r")


def _drawn(seed: int, keys: Sequence[str], run: Column, k: Column, n: Column) -> Column:
    """The index of draw k of a run: a hash of (seed, keys, run, k), which any engine reproduces."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys], run.cast("string"), k.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % n


def gathered_runs(numbered: DataFrame, keys: Sequence[str], n_runs: int, seed: int) -> DataFrame:
    """``run_summaries`` of groups whose results fit into one row: they travel once per slice of runs, and no draw is shuffled."""
    keys = list(keys)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "r")))
    held = numbered.groupBy(*keys).agg(F.transform(ordered, lambda x: x["r"]).alias("_r"))
    slices = F.sequence(F.lit(0), F.lit(n_runs - 1), F.lit(RUNS))
    prefix = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    dealt = spread(held.select(*keys, "_r", prefix.alias("_prefix"), F.explode(slices).alias("_first")), *keys, "_first")
    names = [f"k{i}" for i in range(len(keys))]
    rows = dealt.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, names)], "_r", "_prefix", "_first")
    made = T.StructType.fromDDL("run int, n long, total double, low double, max_dd double")
    shape = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in names], *made])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = np.asarray(batch.column("_r")[i].as_py(), float)
                first, prefix = batch.column("_first")[i].as_py(), batch.column("_prefix")[i].as_py()
                number = [str(k).encode() for k in range(len(r))]
                out = []
                for run in range(first, min(first + RUNS, n_runs)):
                    head = f"{prefix}|{run}|".encode()
                    # the first 15 hexadecimal digits of each digest
                    index = np.frombuffer(b"".join([md5(head + k).digest() for k in number]), ">u8")[::2] >> np.uint64(4)
                    path = np.cumsum(r[(index % np.uint64(len(r))).astype(np.int64)])
                    peak = np.maximum(np.maximum.accumulate(path), 0.0)
                    out.append((run, len(r), path[-1], min(path.min(), 0.0), (path - peak).min()))
                at = pa.array([i] * len(out))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(at) for k in names], *[pa.array(x, kind) for x, kind in zip(
                        zip(*out), (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]], names=[*names, *made.names])

    walked = rows.mapInArrow(walk, shape)
    return walked.select(*[F.col(k).alias(c) for k, c in zip(names, keys)], *made.names)


def run_summaries(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final level, lowest point and drawdown of each path."""
    return path_stats(paths, [*keys, "run"], "k", "r")


def bootstrap_report(
    runs: DataFrame,
    keys: Sequence[str],
    ruin_level: float | None = None,
    profitable_level: float = 0.0,
    band: tuple[float, float] = (0.05, 0.95),
) -> DataFrame:
    """Profit and bust rates, drawdown distribution and final band; one row per run enters each group.

    ``dd_p95`` is the mild tail (drawdowns are negative); ``dd_p05`` the severe one.
    """
    def share(cond):
        return 100 * F.avg(cond.cast("int"))

    aggs = [
        F.count(F.lit(1)).alias("n_runs"),
        F.max("n").alias("n_trades"),
        share(F.col("total") > profitable_level).alias("profit_rate"),
        F.percentile("max_dd", 0.5).alias("dd_p50"),
        F.percentile("max_dd", 0.95).alias("dd_p95"),
        F.percentile("max_dd", 0.05).alias("dd_p05"),
        F.min("max_dd").alias("dd_worst"),
        F.percentile("total", band[0]).alias("final_lo"),
        F.percentile("total", band[1]).alias("final_hi"),
        F.avg("total").alias("final_mean"),
    ]
    if ruin_level is not None:
        # the path starts at 0, so a positive level counts every run
        aggs.append(share(F.col("low") < ruin_level).alias("bust_rate"))
    return runs.groupBy(*keys).agg(*aggs)


def calendar_rate(trades: DataFrame, keys: Sequence[str], ts: str = "entry_ts") -> DataFrame:
    """Trades per calendar year touched."""
    years = F.max(F.year(ts)) - F.min(F.year(ts)) + 1
    return trades.groupBy(*keys).agg(
        F.count("r").alias("n"), years.alias("years"), (F.count("r") / years).alias("trades_per_year")
    )


def bootstrap(
    trades: DataFrame, keys: Sequence[str] = ("series_id",), n_runs: int = 1000, seed: int = 1,
    order: str = "entry_idx", **report,
) -> DataFrame:
    """Trades to report: groups of at most ``GATHERED`` trades are walked run by run, larger ones by joins."""
    return bootstrap_report(all_runs(number_trades(trades, keys, order), keys, n_runs, seed), keys, **report)


def all_runs(numbered: DataFrame, keys: Sequence[str], n_runs: int = 1000, seed: int = 1) -> DataFrame:
    """Summary of every run of every group."""
    numbered = materialise(numbered)
    few = gathered_runs(numbered.filter(F.col("n_trades") <= GATHERED), keys, n_runs, seed)
    many = numbered.filter(F.col("n_trades") > GATHERED)
    if many.isEmpty():
        return few
    return few.unionByName(run_summaries(resample(many, keys, n_runs, seed), keys).select(*few.columns))


def equity_curve(trades: DataFrame, keys: Sequence[str], position: str = "entry_idx", chunk: int = 4096) -> DataFrame:
    """Running sum of r per key, in three levels: inside pieces, pieces inside stretches of ``chunk`` pieces, stretches.

    However sparse the positions are, no window orders more than ``chunk`` pieces of a path of up to ``chunk`` cubed positions.
    """
    keys = list(keys)

    def before(*group: str, order: str) -> Column:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_s").over(w), F.lit(0.0))

    parts = trades.withColumn("_chunk", F.floor(F.col(position) / chunk))
    pieces = parts.groupBy(*keys, "_chunk").agg(F.sum("r").alias("_s")).withColumn("_stretch", F.floor(F.col("_chunk") / chunk))
    stretches = pieces.groupBy(*keys, "_stretch").agg(F.sum("_s").alias("_s"))
    stretches = stretches.select(*keys, "_stretch", before(*keys, order="_stretch").alias("_first"))
    starts = pieces.withColumn("_within", before(*keys, "_stretch", order="_chunk")).join(stretches, [*keys, "_stretch"])
    starts = starts.select(*keys, "_chunk", (F.col("_first") + F.col("_within")).alias("_start"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(starts, [*keys, "_chunk"]).withColumn(
        "equity", F.col("_start") + F.sum("r").over(w)
    ).drop("_chunk", "_start")
