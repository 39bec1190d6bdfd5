"""Indicators defined by recurrences, folded per block of a series with a checked state.

One grouped-map call computes all wanted columns of a block with NumPy/pandas; Spark cuts
the blocks.  A block starts ``WARMUP`` rows early, and most folds forget their start in
that many rows.  None is taken on trust: every block also returns the state of each of its
recurrences where its own rows begin and where they end.  A block whose beginning differs from its
predecessor's end (a price that never moves, a trend that never flips) is folded again from that
end state, which replaces the warm-up, and so are its successors for as long as the end changes.  Seams are compared on a
table of one row per block; a repair folds runs of neighbouring blocks in one go and writes the repaired blocks alone.
``fold_columns`` is the only way to these columns, so no unchecked block can be read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.operators.blocks import BLOCK_ROWS, to_blocks
from tickloom.session import materialise

WARMUP = 4096
INPUTS = ("open", "high", "low", "close", "volume")
#: Earlier values of each recurrence that a state carries: as many as the longest window or lag over one.
TAIL = 24
#: A gap of more rows than this leaves no trace of an exponential mean in double precision.
LONGEST_GAP = 4096
#: Pieces that a repair folds in one task, one after another, and the rows of neighbouring blocks that make a piece.
CHAIN = 16
PIECE_ROWS = BLOCK_ROWS
#: Relative difference up to which two states are the same.
TOLERANCE = 1e-12


def gap_if_zero(x: pd.Series) -> pd.Series:
    return x.mask(x == 0)


class BlockFold:
    """Lazily computed recursive indicators of one block; shared parts are computed once.

    ``first`` is the number of rows before the block's own ones.  With a ``seed`` (the state
    with which the predecessor ended, by recurrence) those rows are only context: recurrences start
    at ``first`` from the seed, and their earlier values are the seed's.
    """

    def __init__(self, bars: pd.DataFrame, first: int = 0, seed: dict[str, list[float]] | None = None, marks: tuple[int, ...] = ()):
        self.bars, self.first, self.seed, self.marks = bars, first, seed, marks
        self.close, self.high, self.low = bars["close"], bars["high"], bars["low"]
        self._memo: dict[str, pd.Series] = {}
        self.states: dict[int, dict[str, list[float]]] = {m: {} for m in marks}

    def __getitem__(self, name: str) -> pd.Series:
        if name not in self._memo:
            self._memo[name] = getattr(self, "_" + name)()
        return self._memo[name]

    def _after_tail(self, tail: list[float], own: np.ndarray) -> pd.Series:
        """Values of a recurrence on all rows: the seed's before the own rows, then the folded ones."""
        before = np.r_[np.full(max(0, self.first - TAIL), np.nan), tail][-self.first:] if self.first else []
        return pd.Series(np.r_[before, own], index=self.bars.index, dtype="float64")

    def _tail(self, y: np.ndarray, mark: int) -> list[float]:
        got = y[max(0, mark - TAIL + 1): mark + 1]
        return [*[np.nan] * (TAIL - len(got)), *got]

    def mean(self, name: str, x: pd.Series, alpha: float) -> pd.Series:
        """Exponential mean y += alpha*(x-y), started at the first value; a gap lowers the weight of what came before."""
        gap, own = 0, x
        if self.seed is None:
            y = x.ewm(alpha=alpha, adjust=False).mean()
        else:
            gap, *tail = self.seed[name]
            gap, own = int(gap), x.iloc[self.first:]
            if np.isnan(tail[-1]):
                folded = own.ewm(alpha=alpha, adjust=False).mean().to_numpy()
            else:  # the old mean stands for all earlier values, followed by its gap
                start = np.r_[tail[-1], np.full(min(gap, LONGEST_GAP), np.nan)]
                folded = pd.Series(np.r_[start, own]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(start):]
            y = self._after_tail(tail, folded)
        skipped, values = len(x) - len(own), y.to_numpy()
        seen = np.flatnonzero(own.notna().to_numpy())
        for mark in self.marks:
            n = int(np.searchsorted(seen, mark - skipped, side="right"))
            since = mark - skipped - seen[n - 1] if n else gap + max(0, mark + 1 - skipped)
            self.states[mark][name] = [float(since), *self._tail(values, mark)]
        return y

    def wilder(self, name: str, x: pd.Series, n: int) -> pd.Series:
        return self.mean(name, x, 1.0 / n)

    def span(self, name: str, x: pd.Series, n: int) -> pd.Series:
        return self.mean(name, x, 2.0 / (n + 1))

    def walk(self, name: str, step: Callable, start: tuple[float, ...], inputs: list[pd.Series], width: int) -> list[pd.Series]:
        """Fold rows one by one: ``step(state, *row)`` gives the next state and ``width`` values."""
        state, skipped, tails = start, 0, None
        if self.seed is not None:
            held = self.seed[name]
            state, skipped = tuple(held[: len(start)]), self.first
            tails = [held[len(start) + k * TAIL: len(start) + (k + 1) * TAIL] for k in range(width)]
        made, kept, marks = [], {}, set(self.marks)
        for i, row in enumerate(zip(*[x.iloc[skipped:].tolist() for x in inputs]), skipped):
            state, values = step(state, *row)
            made.append(values)
            if i in marks:
                kept[i] = state
        columns = list(zip(*made)) if made else [()] * width
        if tails is None:
            out = [pd.Series(c, index=self.bars.index, dtype="float64") for c in columns]
        else:
            out = [self._after_tail(t, np.asarray(c, float)) for t, c in zip(tails, columns)]
        values = [y.to_numpy() for y in out]
        for mark, state in kept.items():
            self.states[mark][name] = [*map(float, state), *[v for y in values for v in self._tail(y, mark)]]
        return out

    # shared inputs
    def _tr(self):
        prev = self.close.shift()
        spread = np.fmax(
            (self.high - self.low).to_numpy(),
            np.fmax((self.high - prev).abs().to_numpy(), (self.low - prev).abs().to_numpy()),
        )
        return pd.Series(spread, index=self.bars.index)

    def _typical(self):
        return (self.high + self.low + self.close) / 3

    # D2, D3
    def _rsi(self):
        step = self.close.diff()
        gain, loss = self.wilder("rsi.gain", step.clip(lower=0), 14), self.wilder("rsi.loss", (-step).clip(lower=0), 14)
        return 100 - 100 / (1 + gain / gap_if_zero(loss))

    def _atr(self):
        return self.wilder("atr", self["tr"], 14)

    def _atr_ma(self):
        return self["atr"].rolling(20).mean()

    # D4
    def _dm(self):
        up, down = self.high.diff(), -self.low.diff()
        plus = up.where((up > down) & (up > 0), 0.0)
        minus = down.where((down > up) & (down > 0), 0.0)
        return plus, minus

    def _di_plus(self):
        return 100 * self.wilder("dm.plus", self["dm"][0], 14) / self["atr"]

    def _di_minus(self):
        return 100 * self.wilder("dm.minus", self["dm"][1], 14) / self["atr"]

    def _adx(self):
        p, m = self["di_plus"], self["di_minus"]
        return self.wilder("adx", 100 * (p - m).abs() / gap_if_zero(p + m), 14)

    # D5
    def _macd(self):
        return self.span("macd.fast", self.close, 12) - self.span("macd.slow", self.close, 26)

    def _macd_signal(self):
        return self.span("macd.signal", self["macd"], 9)

    # D6
    def _demarker(self):
        up = self.high.diff().clip(lower=0)
        down = (-self.low.diff()).clip(lower=0)
        return self.wilder("demarker.up", up, 14) / self.wilder("demarker.both", gap_if_zero(up + down), 14)

    # D7
    def _keltner_width(self):
        return 1.5 * self.wilder("keltner.range", self["tr"], 20)

    def _keltner_mid(self):
        return self.span("keltner.mid", self.close, 20)

    def _keltner_upper(self):
        return self["keltner_mid"] + self["keltner_width"]

    def _keltner_lower(self):
        return self["keltner_mid"] - self["keltner_width"]

    # D8
    def _wave_trend(self):
        off = self["typical"] - self.span("wave.mid", self["typical"], 10)
        return self.span("wave", off / (0.015 * gap_if_zero(self.span("wave.off", off.abs(), 10))), 21)

    def _wave_trend_ma(self):
        return self["wave_trend"].rolling(4).mean()

    # D9
    def _schaff(self):
        line = self.span("schaff.fast", self.close, 23) - self.span("schaff.slow", self.close, 50)
        floor, top = line.rolling(10).min(), line.rolling(10).max()
        scaled = (100 * (line - floor) / gap_if_zero(top - floor)).fillna(50.0)
        return self.span("schaff.outer", self.span("schaff.inner", scaled, 3), 3)

    # D10
    def _qqe(self):
        return self.span("qqe", self["rsi"], 5)

    def _qqe_band(self):
        return 4.236 * self.span("qqe.band", self["qqe"].diff().abs(), 14)

    def _qqe_upper(self):
        return self["qqe"] + self["qqe_band"]

    def _qqe_lower(self):
        return self["qqe"] - self["qqe_band"]

    # D11: ratcheting bands; +1 while the close holds above the lower one
    def _bands(self):
        mid, width = (self.high + self.low) / 2, 3.0 * self.wilder("bands.range", self["tr"], 10)
        return self.walk("bands", _band_step, (np.nan, np.nan, np.nan, 1.0), [mid + width, mid - width, self.close], 3)

    def _supertrend(self):
        return self["bands"][0]

    def _supertrend_top(self):
        return self["bands"][1]

    def _supertrend_bottom(self):
        return self["bands"][2]

    # D12
    def _psar(self):
        return self.walk("psar", _psar_step, (1.0, 0.02, np.nan, np.nan), [self.high, self.low], 1)[0]

    # D13
    def _laguerre(self):
        return self.walk("laguerre", _laguerre_step, (0.0, 0.0, 0.0, 0.0, np.nan, 0.0), [self.close], 1)[0]


def _band_step(state, upper, lower, close):
    """Ratcheting bands.  State: upper band, lower band, previous close, trend.

    A band only moves towards the price until the previous close has passed it; the trend turns when
    the close passes the band of the bar before.
    """
    top, bottom, before, trend = state
    if not np.isnan(before):
        if close > top:
            trend = 1.0
        elif close < bottom:
            trend = -1.0
    if np.isnan(before):
        top, bottom = np.nan, np.nan
    else:
        top = top if upper >= top and before <= top else upper
        bottom = bottom if lower <= bottom and before >= bottom else lower
    return (top, bottom, close, trend), (trend, top, bottom)


def _psar_step(state, high, low, step: float = 0.02, limit: float = 0.2):
    """Parabolic stop.  State: rising (1 or 0), speed, stop, extreme price of the trend."""
    rising, speed, stop, extreme = state
    if np.isnan(stop):
        return (rising, speed, low, high), (np.nan,)
    stop += speed * (extreme - stop)
    adverse, favourable = (low, high) if rising else (high, low)
    side = 1 if rising else -1
    if side * (adverse - stop) < 0:  # crossed: turn around at the extreme
        rising = 1.0 - rising
        stop, extreme, speed = extreme, adverse, step
    elif side * (favourable - extreme) > 0:
        extreme, speed = favourable, min(speed + step, limit)
    return (rising, speed, stop, extreme), (stop,)


def _laguerre_step(state, x, gamma: float = 0.7):
    """Four-stage filter.  State: the stages, the last decided value, rows seen (0 or 1).

    The value is 100 while the stages fall from first to last, 0 while they rise, else the last one.
    """
    *stages, last, started = state
    if started:
        carry, new = x, []
        for k, old in enumerate(stages):
            now = (1 - gamma) * carry + gamma * old if k == 0 else carry[0] - gamma * carry[1] + gamma * old
            carry = (old, now)
            new.append(now)
        stages = new
        steps = np.diff(stages)
        last = 100.0 if (steps < 0).all() else 0.0 if (steps > 0).all() else last
    return (*stages, last, 1.0), (last,)


RECURSIVE = (
    "rsi", "atr", "atr_ma", "di_plus", "di_minus", "adx", "macd", "macd_signal", "demarker",
    "keltner_upper", "keltner_lower", "wave_trend", "wave_trend_ma", "schaff",
    "qqe", "qqe_upper", "qqe_lower", "supertrend", "psar", "laguerre",
)


def _flat(states: dict[str, list[float]]) -> list[float | None]:
    """All states in the order of their names; a missing value is null."""
    return [None if np.isnan(v) else v for k in sorted(states) for v in states[k]]


@lru_cache(8)
def _state_shape(wanted: tuple[str, ...]) -> dict[str, int]:
    """Length of the state of each recurrence that the columns need."""
    rows = 3 * TAIL
    block = BlockFold(pd.DataFrame({c: np.arange(1.0, rows + 1) for c in INPUTS}), marks=(rows - 1,))
    for c in wanted:
        block[c]
    return {k: len(v) for k, v in block.states[rows - 1].items()}


def _named(flat: Iterable[float | None], shape: dict[str, int]) -> dict[str, list[float]]:
    values, out, at = [np.nan if v is None else float(v) for v in flat], {}, 0
    for k in sorted(shape):
        out[k] = values[at: at + shape[k]]
        at += shape[k]
    return out


def _changed(a: Iterable[float | None], b: Iterable[float | None]) -> bool:
    """``_differs`` of two states at hand."""
    x, y = (np.array([np.nan if v is None else v for v in s], float) for s in (a, b))
    near = np.abs(x - y) <= TOLERANCE * np.fmax(np.abs(x), np.abs(y))
    return not (near | (np.isnan(x) & np.isnan(y))).all()


def _differs(a: Column, b: Column) -> Column:
    def other(x: Column, y: Column) -> Column:
        near = F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y))
        return ~F.coalesce(near, x.isNull() & y.isNull())

    return F.exists(F.zip_with(a, b, other), lambda v: v)


def fold_columns(
    blocked: DataFrame,
    columns: Iterable[str] = RECURSIVE,
    lags: Iterable[tuple[str, int]] = (),
    keep: Iterable[str] = (),
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Recursive indicator columns of blocked bars (own rows only), stored, with every seam settled.

    ``lags`` adds earlier values as ``<name>_lag<k>``; ``keep`` names the input
    columns to pass through besides series_id, blk, bar_idx.  Blocks of ``size`` rows must start at least ``TAIL`` rows early.
    """
    piece = max(1, PIECE_ROWS // size)
    columns, lags = list(columns), list(lags)
    wanted = tuple(dict.fromkeys([*columns, *[c for c, _ in lags]]))
    keep = [c for c in keep if c not in ("series_id", "blk", "bar_idx", "own")]
    fields = [blocked.schema[c] for c in ("series_id", "blk", "bar_idx", *keep)]
    new = columns + [f"{c}_lag{k}" for c, k in lags]
    state = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_start", "_end")]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in new] + state)
    passed = ["series_id", "blk", "bar_idx", *keep]

    def fold(pdf: pd.DataFrame, seed: list[float] | None = None) -> pd.DataFrame:
        """Own rows; the first one of each block carries the block's states.  With a seed there may be several neighbouring blocks."""
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        mine = np.flatnonzero(pdf["own"].to_numpy())
        if not len(mine):
            return pd.DataFrame(columns=schema.names)
        first = int(mine[0])
        if seed is not None:
            cut = max(0, first - TAIL)
            pdf, mine, first = pdf.iloc[cut:].reset_index(drop=True), mine - cut, first - cut
        blks = pdf["blk"].to_numpy()[mine]
        last = np.r_[np.flatnonzero(blks[1:] != blks[:-1]), len(mine) - 1]  # of each block, among the own rows
        ends = [int(mine[k]) for k in last]
        marks = (first - 1, *ends) if first and seed is None else tuple(ends)
        block = BlockFold(pdf, first, None if seed is None else _named(seed, _state_shape(wanted)), marks)
        made = {c: block[c] for c in columns}
        made |= {f"{c}_lag{k}": block[c].shift(k) for c, k in lags}
        out = pd.concat([pdf[passed], pd.DataFrame(made)], axis=1)[pdf["own"]].reset_index(drop=True)
        begin = seed if seed is not None else _flat(block.states[first - 1]) if first else None
        starts, stops = np.full(len(out), None, object), np.full(len(out), None, object)
        for at, k, end in zip([0, *(last[:-1] + 1)], last, ends):
            starts[at], stops[at] = begin, _flat(block.states[end])
            begin = stops[at]
        out["_start"], out["_end"] = pd.Series(starts, dtype=object), pd.Series(stops, dtype=object)
        return out

    def again(_key, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Fold a chain of blocks again, a piece at a time, from its first wrong beginning on.

        After a piece whose end is what it was, the next one with a wrong beginning follows.
        """
        if not len(pdf) or not len(known):
            return pd.DataFrame(columns=schema.names)
        known = known.sort_values("blk", ignore_index=True)
        blks, rows = known["blk"].tolist(), dict(list(pdf.groupby("blk")))
        at, before, moved, made = 0, None, False, []
        while at < len(blks):
            follows = at > 0 and blks[at] == blks[at - 1] + 1
            seed = before if follows and before is not None else known["seed"].iat[at]
            if seed is None or not (known["seed"].iat[at] is not None or (follows and moved)):
                at, before, moved = at + 1, None, False
                continue
            n = 1
            while n < piece and at + n < len(blks) and blks[at + n] == blks[at] + n:
                n += 1
            later = [rows[b] for b in blks[at + 1: at + n]]
            own = rows[blks[at]]
            own = own[own["bar_idx"] <= own.loc[own["own"], "bar_idx"].max()]
            run = pd.concat([own, *[r[r["own"]] for r in later]], ignore_index=True)
            made.append(fold(run, [None if v is None or np.isnan(v) else float(v) for v in seed]))
            before = next(e for e in reversed(made[-1]["_end"].tolist()) if e is not None)
            moved = _changed(before, known["_end"].iat[at + n - 1])
            at += n
        return pd.concat(made, ignore_index=True)

    needed = list(dict.fromkeys([*passed, "own", *INPUTS]))
    slim, key = blocked.select(*needed), ["series_id", "blk"]

    def states_of(folded: DataFrame) -> DataFrame:
        return folded.filter("_end IS NOT NULL").select(*key, "_start", "_end")

    parts = [materialise(slim.groupBy(*key).applyInPandas(lambda pdf: fold(pdf), schema))]
    states = materialise(states_of(parts[0]))  # one row per block
    together, chain = ["series_id", "_chain"], F.expr(f"blk div {CHAIN * piece}").alias("_chain")
    while True:
        ends = states.select("series_id", (F.col("blk") + 1).alias("blk"), F.col("_end").alias("seed"))
        bad = materialise(states.filter("blk > 0").join(ends, key).filter(_differs(F.col("_start"), F.col("seed"))).select(*key, "seed"))
        if bad.isEmpty():
            break
        # of a chain, blocks from the first wrong one on are read again; those folded again are left out of what was written before, by key
        wrong = bad.select("series_id", chain, "blk").groupBy(*together).agg(F.min("blk").alias("_from"))
        known = states.select(*key, chain, "_end").join(wrong, together).filter("blk >= _from").join(bad, key, "left")
        rows = slim.select("*", chain).join(wrong, together).filter("blk >= _from").drop("_from")
        redone = materialise(rows.groupBy(*together).cogroup(known.groupBy(*together)).applyInPandas(again, schema))
        new_states = materialise(states_of(redone))
        parts = [*[p.join(new_states.select(*key), key, "left_anti") for p in parts], redone]
        states = materialise(states.join(new_states.select(*key), key, "left_anti").unionByName(new_states))
    return reduce(DataFrame.unionByName, parts).select(*passed, *new)


def recursive_indicators(
    bars: DataFrame,
    columns: Iterable[str] = RECURSIVE,
    size: int = BLOCK_ROWS,
    warmup: int = WARMUP,
    keep: Iterable[str] = ("ts",),
) -> DataFrame:
    """Recursive indicators of indexed bars: one shuffle, one grouped-map call, seams settled."""
    return fold_columns(to_blocks(bars, back=max(warmup, TAIL), size=size), columns, keep=keep, size=size).drop("blk")
