"""Cutting a series into blocks must never change a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bar_helpers import frame, path_outcome, same, walk
from tickloom.functions.conditions import signal_bits
from tickloom.functions.indicators import LOOKBACK, with_window_indicators
from tickloom.functions.recursive import recursive_indicators
from tickloom.operators import levels, mining, regimes, screen
from tickloom.operators.blocks import (
    exact_quantiles, index_bars, index_bars_with_vwap, merge_tree, own_rows, path_stats, to_blocks,
)
from tickloom.operators.outcomes import MATRIX_RULES, SCHEMES, ExitRule, PriceSide, _rule_results, one_at_a_time, outcome_columns
from tickloom.session import materialise

SMALL = {"size": 150, "warmup": 900}


def test_positions(bars):
    got = frame(index_bars(bars), "series_id", "ts")
    for _, g in got.groupby("series_id"):
        assert list(g["bar_idx"]) == list(range(len(g)))
        assert set(g["n_bars"]) == {len(g)}


@pytest.mark.parametrize("segment", ["month", "year"])
def test_positions_do_not_depend_on_the_segment(bars, segment):
    same(index_bars(bars), index_bars(bars, segment), "series_id", "ts")


def test_blocks_hold_their_halo(bars):
    blocked = frame(to_blocks(index_bars(bars), back=40, ahead=7, size=100), "series_id", "blk", "bar_idx")
    for (_, blk), g in blocked.groupby(["series_id", "blk"]):
        n = g["n_bars"].iloc[0]
        lo, hi = max(blk * 100 - 40, 0), min(blk * 100 + 99 + 7, n - 1)
        assert list(g["bar_idx"]) == list(range(lo, hi + 1))
        assert (g["own"] == (g["bar_idx"] // 100 == blk)).all()


def test_window_indicators(bars):
    ix = index_bars_with_vwap(bars)
    whole = own_rows(with_window_indicators(to_blocks(ix, back=LOOKBACK))).drop("blk")
    cut = own_rows(with_window_indicators(to_blocks(ix, back=LOOKBACK, size=130))).drop("blk")
    got = same(whole, cut, "series_id", "bar_idx")
    assert got["bandwidth_ma"].notna().sum() > 1000


def test_recursive_indicators(bars):
    ix = index_bars(bars)
    same(recursive_indicators(ix), recursive_indicators(ix, size=150, warmup=1400), "series_id", "bar_idx", tol=1e-7)


@pytest.mark.parametrize("kind", ["flat", "halted", "steady"])
def test_short_warm_up_is_settled(spark, kind):
    """Blocks whose warm-up cannot reach the state are folded from their predecessor's end."""
    pdf = walk(900, 9)
    if kind == "flat":  # rises, falls, then never moves again
        pdf.loc[300:, ["open", "high", "low", "close"]] = pdf.loc[299, "close"]
    elif kind == "halted":
        for c in ("open", "high", "low", "close"):
            pdf.loc[200:650, c] = pdf.loc[199, "close"]
    else:
        for c in ("open", "high", "low", "close"):
            pdf[c] = np.linspace(2000, 1000, len(pdf)) + {"high": 1.0, "low": -1.0}.get(c, 0.0)
    ix = materialise(index_bars(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
    whole = recursive_indicators(ix)
    same(whole, recursive_indicators(ix, size=100, warmup=24), "series_id", "bar_idx", tol=1e-7)
    same(whole, recursive_indicators(ix, size=64, warmup=200), "series_id", "bar_idx", tol=1e-7)


@pytest.mark.parametrize("piece", [None, 60])
def test_a_state_that_is_never_forgotten_takes_few_repairs(spark, monkeypatch, piece):
    """Bars so wide that no close leaves its band: the band holds the series' extreme, which passes every seam."""
    from tickloom.functions import recursive

    pdf = walk(3000, 5)
    pdf["high"], pdf["low"] = pdf["close"] + 900 - np.arange(3000) % 7, pdf["close"] - 900
    ix = materialise(index_bars(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
    whole = recursive_indicators(ix)
    stored = []
    monkeypatch.setattr(recursive, "materialise", lambda df, *by: stored.append(1) or materialise(df, *by))
    if piece:  # several pieces and chains
        monkeypatch.setattr(recursive, "PIECE_ROWS", piece)
        monkeypatch.setattr(recursive, "CHAIN", 10)
    cut = recursive_indicators(ix, size=20, warmup=24)
    got = same(whole, cut, "series_id", "bar_idx", tol=1e-7)
    assert got["supertrend"].iloc[20:].nunique() == 1
    assert piece or len(stored) <= 8  # a round stores three tables


def test_signal_bits(bars):
    whole, cut = signal_bits(bars), signal_bits(bars, size=160, warmup=1400)
    same(whole.drop("blk"), cut.drop("blk"), "series_id", "bar_idx")


def test_screen_merges_blocks(bars):
    whole = screen.screen(bars, None, min_n=20)
    cut = screen.screen(bars, None, min_n=20, size=120, warmup=1400)
    got = same(whole, cut, "series_id", "signal", "horizon", tol=1e-6)
    assert len(got) > 150


def test_outcomes(bars):
    ix = index_bars(bars)
    entries = recursive_indicators(ix, ["atr"], keep=("close",)).select(
        "series_id", F.col("bar_idx").alias("entry_idx"), F.col("close").alias("entry_price"), "atr")
    rules = [*MATRIX_RULES, *SCHEMES]
    same(outcome_columns(ix, entries, rules), outcome_columns(ix, entries, rules, size=50), "series_id", "entry_idx")


def test_matrix(bars):
    whole = mining.mine(bars, min_n=5)
    cut = mining.mine(bars, min_n=5, size=150, warmup=1400)
    got = same(whole, cut, "series_id", "level", "trigger")
    assert len(got) > 20


def test_regimes_and_breaks(spark):
    pdf = pd.concat([walk(900, 5, "A", freq="1D"), walk(400, 6, "B", freq="1D")])
    pdf["close"] *= 1 + 0.1 * np.sin(np.arange(len(pdf)) / 40) * np.random.default_rng(1).normal(size=len(pdf))
    ix = index_bars(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "year")
    got = same(regimes.regimes(ix), regimes.regimes(ix, size=70), "series_id", "start")
    assert len(got) > 3
    same(regimes.structural_breaks(ix), regimes.structural_breaks(ix, size=140), "series_id", "rank")


def test_path_stats_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i * step, float(x)) for k, n, step in (("a", 5000, 1), ("b", 7, 1), ("c", 1, 1), ("sparse", 400, 50_000)) for i, x in enumerate(rng.normal(0, 1, n))]
    df = spark.createDataFrame(rows, "k string, i long, r double")
    got = frame(path_stats(df, ["k"], "i", "r", chunk=64), "k")
    for k, g in pd.DataFrame(rows, columns=["k", "i", "r"]).groupby("k"):
        eq = np.r_[0.0, np.cumsum(g["r"])]
        row = got[got["k"] == k].iloc[0]
        assert np.isclose(row["total"], eq[-1]) and np.isclose(row["low"], eq.min())
        assert np.isclose(row["max_dd"], (eq - np.maximum.accumulate(eq)).min())


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.where(np.arange(4000) % 5 == 0, "x", "hot"), "v": np.round(rng.normal(0, 100, 4000), 1)})
    df = spark.createDataFrame(pdf)
    got = frame(exact_quantiles(df, ["g"], "v", {"q1": 0.01, "q25": 0.25, "q50": 0.5, "q95": 0.95}, accuracy), "g")
    floor = frame(exact_quantiles(df, ["g"], "v", {"f25": 0.25, "f75": 0.75}, accuracy, rank="floor"), "g")
    top = frame(exact_quantiles(df, ["g"], "v", {"t": 0.95}, accuracy, rank="top"), "g")
    for i, (g, part) in enumerate(pdf.groupby("g")):
        v = np.sort(part["v"])
        for name, p in (("q1", 0.01), ("q25", 0.25), ("q50", 0.5), ("q95", 0.95)):
            assert np.isclose(got[name][i], np.quantile(v, p)), (g, name)
        assert floor["f25"][i] == v[min(int(0.25 * len(v)), len(v) - 1)]
        assert floor["f75"][i] == v[min(int(0.75 * len(v)), len(v) - 1)]
        assert top["t"][i] == v[len(v) - max(1, len(v) // 20)]


@pytest.mark.parametrize("size", [10, 33, 1000])
def test_one_position_at_a_time(spark, size):
    rng = np.random.default_rng(7)
    idx = {s: np.flatnonzero(rng.random(600) < p) for s, p in (("dense", 0.7), ("sparse", 0.03))}
    df = spark.createDataFrame([(s, int(i)) for s, a in idx.items() for i in a], "series_id string, entry_idx long")
    got = frame(one_at_a_time(df, [], hold=24, size=max(size, 25)), "series_id", "entry_idx")
    for s, a in idx.items():
        want, busy = [], -1
        for i in a:
            if i > busy:
                want.append(i)
                busy = i + 24
        assert list(got[got["series_id"] == s]["entry_idx"]) == want


@pytest.mark.parametrize("fan_in", [2, 3])
def test_positions_are_handed_down_a_tree(spark, fan_in):
    rng = np.random.default_rng(8)
    idx = {s: np.flatnonzero(rng.random(4000) < p) for s, p in (("dense", 0.6), ("sparse", 0.004), ("late", 0.01))}
    idx["late"] = idx["late"][idx["late"] > 2500]
    df = spark.createDataFrame([(s, int(i)) for s, a in idx.items() for i in a], "series_id string, entry_idx long")
    got = frame(one_at_a_time(df, [], hold=37, size=50, fan_in=fan_in), "series_id", "entry_idx")
    for s, a in idx.items():
        want, busy = [], -1
        for i in a:
            if i > busy:
                want.append(i)
                busy = i + 37
        assert list(got[got["series_id"] == s]["entry_idx"]) == want


def test_ten_thousand_summaries_of_one_series(spark):
    """No merge sees more than 64 blocks, and the result is that of the whole sequence."""
    rng = np.random.default_rng(9)
    x, lag = rng.normal(0.1, 1, 40_000), 3
    rows = [("s", 0, b, lag + 1, "all", lag, *screen.summarise(x[4 * b: 4 * b + 4], lag)) for b in range(10_000)]
    got = screen.merge_summaries(spark.createDataFrame(rows, screen.SUMMARY_SCHEMA)).collect()
    mean, t = screen.t_of_summary(*screen.summarise(x, lag), lag)
    assert [(r.n, round(r.mean, 10), round(r.t_stat, 8)) for r in got] == [(40_000, round(mean, 10), round(t, 8))]
    sizes = []

    def count(table):
        sizes.append(table.num_rows)
        return table.slice(0, 1)

    assert [d.count() for d in merge_tree(spark.createDataFrame(rows[:300], screen.SUMMARY_SCHEMA), ["series_id"], count, 8)] == [300, 38, 5]


@pytest.mark.parametrize("hold", [1, 2, 7, 5000])
def test_first_hits_by_descent(hold):
    """The first bar that meets a level, and the level, equal those of whole paths; equal prices and gaps too."""
    rng = np.random.default_rng(hold)
    n = 7000
    close = np.round(100 + np.cumsum(rng.normal(0, 1, n)))
    high, low = close + rng.integers(0, 3, n), close - rng.integers(0, 3, n)
    at = np.r_[np.sort(rng.choice(n, 150, replace=False)), n - 1]
    atr = rng.choice([0.5, 1.0, 4.0, 8.0], len(at))  # exact quotients: ties stay ties
    for long in (True, False):
        for stop, target, trail in ((2.0, None, None), (1.0, 2.0, None), (2.0, None, 1.0), (3.0, 4.0, 0.5), (50.0, None, 20.0)):
            rule = ExitRule("r", long, stop, target, trail, hold)
            got = _rule_results(PriceSide(low, high, close, long, hold), rule, at, close[at], atr)
            want = [path_outcome(i, close, high, low, a, rule) if i < n - 1 else 0.0 for i, a in zip(at, atr)]
            np.testing.assert_allclose(got, want, atol=1e-9)


def test_levels_use_no_later_bars(spark, bars):
    """Appending bars never changes a level that was already known."""
    full = levels.level_rows(levels.prepare(bars))
    for cut in (300, 700, 1100):
        head = index_bars(bars).filter(F.col("bar_idx") < cut).drop("bar_idx", "n_bars")
        same(full.filter(F.col("bar_idx") < cut), levels.level_rows(levels.prepare(head)), "series_id", "bar_idx", "level")


def test_long_and_short_mirror_each_other(bars):
    """With prices reflected around zero a long trade is the mirrored short trade."""
    ix = index_bars(bars)
    entries = recursive_indicators(ix, ["atr"], keep=("close",)).select(
        "series_id", F.col("bar_idx").alias("entry_idx"), F.col("close").alias("entry_price"), "atr")
    flipped = ix.withColumns({"high": -F.col("low"), "low": -F.col("high"), "close": -F.col("close")})
    mirrored = entries.withColumn("entry_price", -F.col("entry_price"))
    short, long = ExitRule("r", trail=1.5, target=2.0), ExitRule("r", long=True, trail=1.5, target=2.0)
    same(outcome_columns(ix, entries, [short]), outcome_columns(flipped, mirrored, [long]), "series_id", "entry_idx")
