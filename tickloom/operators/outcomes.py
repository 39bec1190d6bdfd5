"""Trade outcomes in ATR multiples (R) under stop, target, trailing stop and time-out.

The outcome of an entry depends only on the entry bar and the exit rule, so it is
computed once per distinct entry bar for a whole grid of rules, and every entry
set (cells, windows, baselines) joins that table.

The trailing stop needs no recurrence: after j bars it is the running favourable
extreme minus its distance, and it never falls below the initial stop.  The first bar that reaches a stop or
target is found by descent over ranges of 1, 2, 4, ... bars, so a longer hold costs one more range, not a longer path.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.operators.blocks import BLOCK_ROWS, FAN_IN, merge_tree, spread, to_blocks
from tickloom.session import materialise

ATR_FLOOR = 1e-9


@dataclass(frozen=True)
class ExitRule:
    """Exit rule of a trade; distances in ATR, ``hold`` in bars."""

    name: str
    long: bool = False
    stop: float = 2.0
    target: float | None = None
    trail: float | None = None
    hold: int = 24


# The rule grid of the level matrix and the two exit schemes.
TRAILS = (1.0, 1.5, 2.0, 2.5)
MATRIX_RULES = tuple(ExitRule(f"trail_{t}".replace(".", ""), trail=t) for t in TRAILS) + (
    ExitRule("mirror", long=True, trail=1.5),
)
MAIN = "trail_15"
SCHEMES = (ExitRule("fixed", target=2.0), ExitRule("trailed", trail=1.5))


def _shifted(x: np.ndarray, by: int, fill: float) -> np.ndarray:
    return np.concatenate([x[by:], np.full(min(by, len(x)), fill)])


class PriceSide:
    """Bars of a block as a trade of one direction sees them: signed prices, larger is better.

    ``best``, ``worst`` and ``fall`` hold, for every power of two up to the longest hold, the best price, the worst price, and the
    deepest fall from an earlier bar's best to a later bar's worst, of as many bars from each bar on.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, close: np.ndarray, long: bool, hold: int) -> None:
        sign = 1.0 if long else -1.0
        worst, best = (low, high) if long else (-high, -low)
        self.close = sign * close
        # a missing price neither stops a trade nor is a new best
        self.worst = [np.where(np.isnan(worst), np.inf, worst)]
        self.best = [np.where(np.isnan(best), -np.inf, best)]
        self.fall = [np.full(len(low), -np.inf)]
        for k in range(max(hold, 1).bit_length() - 1):
            next_best, next_worst, next_fall = (_shifted(x, 1 << k, f) for x, f in (
                (self.best[k], -np.inf), (self.worst[k], np.inf), (self.fall[k], -np.inf)))
            self.fall.append(np.maximum(np.maximum(self.fall[k], next_fall), self.best[k] - next_worst))
            self.best.append(np.maximum(self.best[k], next_best))
            self.worst.append(np.minimum(self.worst[k], next_worst))

    def first_hit(self, at: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, trail: np.ndarray | None,
                  goal: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bar after ``at`` (up to before ``end``) that reaches the stop or the goal; ``end`` where none does.

        Also returns the stop that held there, and whether it was the stop.  Bars are skipped by powers of two as long as none of them
        can be a hit, and single bars are decided by the prices themselves.
        """
        place, top = at + 1, start.copy()
        limit, stopped, done = np.empty(len(at)), np.zeros(len(at), bool), place >= end
        live = np.flatnonzero(~done)
        while len(live):
            for k in reversed(range(len(self.best))):
                here = place[live]
                inside = here + (1 << k) <= end[live]
                at_k = np.where(inside, here, 0)
                # the first bar knows the initial stop alone: it is always decided by itself
                skip = inside & (self.worst[k][at_k] > stop[live]) & (here > at[live] + 1)
                if trail is not None:
                    slack = 1e-9 * np.maximum(np.abs(top[live]), 1.0) + 1e-9 * np.abs(trail[live])
                    skip &= (self.fall[k][at_k] < trail[live] - slack) & (top[live] - self.worst[k][at_k] < trail[live] - slack)
                if goal is not None:
                    skip &= self.best[k][at_k] < goal[live]
                moved = live[skip]
                top[moved] = np.maximum(top[moved], self.best[k][place[moved]])
                place[moved] += 1 << k
            live = live[place[live] < end[live]]
            here = place[live]
            level = stop[live]
            if trail is not None:
                level = np.where(here > at[live] + 1, np.maximum(level, top[live] - trail[live]), level)
            limit[live] = level
            stopped[live] = self.worst[0][here] <= level
            won = self.best[0][here] >= goal[live] if goal is not None else False
            top[live] = np.maximum(top[live], self.best[0][here])
            live = live[~(stopped[live] | won)]
            place[live] += 1
            live = live[place[live] < end[live]]
        return place, limit, stopped


def _rule_results(side: PriceSide, rule: ExitRule, at: np.ndarray, price: np.ndarray, atr: np.ndarray) -> np.ndarray:
    """R of each entry at bar ``at`` of the block under one rule; 0 without bars."""
    if not len(side.close):
        return np.zeros(len(at))
    start = price if rule.long else -price
    end = np.minimum(at + 1 + rule.hold, len(side.close))
    goal = None if rule.target is None else start + rule.target * atr
    trail = None if rule.trail is None else rule.trail * atr
    place, limit, stopped = side.first_hit(at, end, start, start - rule.stop * atr, trail, goal)
    last = np.maximum(end - 1, 0)
    out = np.where(end > at + 1, (side.close[last] - start) / atr, 0.0)
    hit = place < end
    out = np.where(hit & stopped, (np.where(hit, limit, 0.0) - start) / atr, out)
    if goal is not None:
        out = np.where(hit & ~stopped, (goal - start) / atr, out)
    return np.where(np.isnan(out), 0.0, out)


def outcome_columns(
    indexed: DataFrame, entries: DataFrame, rules: Sequence[ExitRule], size: int = BLOCK_ROWS
) -> DataFrame:
    """One row per distinct entry bar with one R column per rule.

    ``indexed`` needs series_id, bar_idx, n_bars, high, low, close; ``entries``
    needs series_id, entry_idx, entry_price, atr.  Entries without a usable ATR
    are skipped.  A block's bars are met by its entries; memory is that of the block and its halo of ``hold`` bars,
    whatever the number of entries.
    """
    rules, hold = list(rules), max(r.hold for r in rules)
    usable = entries.filter(F.col("atr") > ATR_FLOOR)
    distinct = usable.groupBy("series_id", "entry_idx").agg(
        F.first("entry_price").alias("entry_price"), F.first("atr").alias("atr")
    ).withColumn("blk", F.expr(f"entry_idx div {size}"))
    bars = to_blocks(
        indexed.select("series_id", "bar_idx", "n_bars", "high", "low", "close"), ahead=hold, size=size, place=False
    ).select("series_id", "blk", "bar_idx", "high", "low", "close")
    shape = ", ".join([f"series_id {entries.schema['series_id'].dataType.simpleString()}", "entry_idx bigint", *[f"`{r.name}` double" for r in rules]])

    def follow(prices: pa.Table, marks: pa.Table) -> pa.Table:
        prices = prices.sort_by("bar_idx")
        index = prices.column("bar_idx").to_numpy()
        low, high, close = (prices.column(c).to_numpy().astype(float) for c in ("low", "high", "close"))
        entry = marks.column("entry_idx").to_numpy()
        price, atr = (marks.column(c).to_numpy().astype(float) for c in ("entry_price", "atr"))
        # positions are dense: an entry's bars follow it, whether its own bar is there or not
        at = np.searchsorted(index, entry, "right") - 1 if len(index) else np.full(len(entry), -1)
        sides = {}
        for r in rules:
            if r.long not in sides:
                sides[r.long] = PriceSide(low, high, close, r.long, hold)
        made = [_rule_results(sides[r.long], r, at, price, atr) for r in rules]
        return pa.table([marks.column("series_id"), marks.column("entry_idx"), *map(pa.array, made)], names=["series_id", "entry_idx", *[r.name for r in rules]])

    keys = ("series_id", "blk")
    return spread(bars, *keys).groupBy(*keys).cogroup(spread(distinct, *keys).groupBy(*keys)).applyInArrow(
        lambda prices, marks: follow(prices, marks) if marks.num_rows else _no_outcomes(marks, rules), shape)


def _no_outcomes(marks: pa.Table, rules: Sequence[ExitRule]) -> pa.Table:
    return pa.table([marks.column("series_id"), marks.column("entry_idx"), *[pa.array([], pa.float64())] * len(rules)],
                    names=["series_id", "entry_idx", *[r.name for r in rules]])


def outcomes(indexed: DataFrame, entries: DataFrame, rules: Sequence[ExitRule], size: int = BLOCK_ROWS) -> DataFrame:
    """Long form: (series_id, entry_idx, rule, r)."""
    wide = outcome_columns(indexed, entries, rules, size)
    return wide.unpivot(["series_id", "entry_idx"], [r.name for r in rules], "rule", "r")


def with_outcomes(
    indexed: DataFrame, entries: DataFrame, rules: Sequence[ExitRule], size: int = BLOCK_ROWS, store: bool = False
) -> DataFrame:
    """Join each entry to the outcomes of its bar.

    Entries are read twice; ``store`` writes them once instead of deriving them
    from the bars a second time.
    """
    if store:
        entries = materialise(entries)
    return entries.join(outcome_columns(indexed, entries, rules, size), ["series_id", "entry_idx"])


def one_at_a_time(entries: DataFrame, keys: Iterable[str], hold: int, size: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Drop entries that fall inside an open trade (up to ``hold`` bars after the last accepted one).

    The rule is sequential, but what a block needs to know of the past is only how
    many of its first bars are still taken (0..hold).  So each block answers for
    every such number, answers of ``fan_in`` blocks are composed into one, level by level, the right
    numbers are handed down again, and the blocks run once more with theirs.
    """
    keys = list(dict.fromkeys(["series_id", *keys]))
    parts = entries.withColumn("blk", F.expr(f"entry_idx div {size}"))
    key_types = ", ".join(f"`{k}` {entries.schema[k].dataType.simpleString()}" for k in keys)

    def run(positions: np.ndarray, busy_until: int) -> tuple[np.ndarray, int]:
        taken, at = [], 0
        while True:
            at = int(np.searchsorted(positions, busy_until, side="right"))
            if at >= len(positions):
                return np.asarray(taken, dtype="int64"), busy_until
            taken.append(at)
            busy_until = int(positions[at]) + hold

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        blk = int(pdf["blk"].iat[0])
        positions, first = np.sort(pdf["entry_idx"].to_numpy("int64")), blk * size
        # busy_until = first - 1 + k for k = 0..hold
        out = [max(run(positions, first - 1 + k)[1] - (first + size - 1), 0) for k in range(hold + 1)]
        return pdf[keys].head(1).assign(blk=blk, span=size, carry=[out])

    def along(rows: Iterable[dict], carry: int) -> Iterable[tuple[int, int]]:
        """(block, bars taken on entry) of consecutive answers, and at last the block behind them."""
        prev = None
        for row in rows:
            if prev is not None:
                carry = max(carry - (row["blk"] - prev - 1) * row["span"], 0)
            yield row["blk"], carry
            carry, prev = row["carry"][carry], row["blk"]
        yield -1, carry

    def compose(table: pa.Table) -> pa.Table:
        """Answers of consecutive groups of blocks as the answer of one group, which covers them and the gaps up to its edges."""
        rows = table.to_pylist()
        up, span = rows[0]["blk"] // fan_in, rows[0]["span"]
        first, end = up * fan_in, (up + 1) * fan_in - 1
        carry = []
        for k in range(hold + 1):
            k = max(k - (rows[0]["blk"] - first) * span, 0)
            *_, (_, out) = along(rows, k)
            carry.append(max(out - (end - rows[-1]["blk"]) * span, 0))
        return pa.Table.from_pylist([{**rows[0], "span": span * fan_in, "carry": carry}], schema=table.schema)

    def hand_down(below: pa.Table, above: pa.Table) -> pa.Table:
        rows, taken = below.sort_by("blk").to_pylist(), above.column("taken")[0].as_py() if above.num_rows else 0
        if not rows:
            return pa.Table.from_pylist([], schema=taken_schema)
        base = rows[0]["blk"] // fan_in * fan_in if above.num_rows else 0
        found = along(rows, max(taken - (rows[0]["blk"] - base) * rows[0]["span"], 0))
        return pa.Table.from_pylist([{**{k: rows[0][k] for k in keys}, "blk": b, "taken": t} for b, t in found if b >= 0], schema=taken_schema)

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("entry_idx", ignore_index=True)
        first = int(left["blk"].iat[0]) * size
        kept, _ = run(left["entry_idx"].to_numpy("int64"), first - 1 + int(right["taken"].iat[0]))
        return left.iloc[kept]

    answered = parts.groupBy(*keys, "blk").applyInPandas(answers, f"{key_types}, blk bigint, span bigint, carry array<int>")
    shape = f"{key_types}, blk bigint, taken int"
    taken_schema = to_arrow_schema(answered.select(*keys, "blk", F.lit(0).alias("taken")).schema)
    # answers of ever longer stretches up, then how many bars are taken down again, level by level
    *lower, top = merge_tree(answered, keys, compose, fan_in)
    taken = top.groupBy(*keys).applyInArrow(lambda t: hand_down(t, t.slice(0, 0)), shape)
    for level in reversed(lower):
        grouped = level.withColumn("up", F.expr(f"blk div {fan_in}"))
        from_above = taken.withColumnRenamed("blk", "up")
        taken = materialise(grouped.groupBy(*keys, "up").cogroup(from_above.groupBy(*keys, "up")).applyInArrow(hand_down, shape))
    return (
        parts.groupBy(*keys, "blk").cogroup(taken.groupBy(*keys, "blk")).applyInPandas(pick, parts.schema).drop("blk")
    )
