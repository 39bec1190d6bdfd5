"""Hand-checked values and comparisons with definitions."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bar_helpers import frame, path_outcome, walk
from tickloom.functions.columns import norm_symbol, number_of, text_of, two_sided_p, wilson_bounds
from tickloom.functions.conditions import condition_names
from tickloom.functions.indicators import with_window_indicators
from tickloom.functions.recursive import recursive_indicators
from tickloom.operators import bootstrap, configs, costs, levels, mining, results, screen, trades
from tickloom.operators.blocks import index_bars, own_rows, to_blocks
from tickloom.operators.outcomes import ExitRule, outcome_columns
from tickloom.operators.splits import quantile_cut


def outcome_of(spark, close, rule, high=None, low=None, atr=10.0, at=0):
    n = len(close)
    high = high if high is not None else [c + 0.5 for c in close]
    low = low if low is not None else [c - 0.5 for c in close]
    ix = spark.createDataFrame(
        [("A", i, n, float(high[i]), float(low[i]), float(close[i])) for i in range(n)],
        "series_id string, bar_idx long, n_bars long, high double, low double, close double")
    e = spark.createDataFrame([("A", at, float(close[at]), atr)], "series_id string, entry_idx long, entry_price double, atr double")
    got = outcome_columns(ix, e, [rule]).collect()
    return got[0][rule.name] if got else None


def test_time_out_marks_to_market(spark):
    assert outcome_of(spark, [100, 99, 98, 97, 96], ExitRule("r", hold=4)) == pytest.approx(0.4)


def test_stop_and_target(spark):
    assert outcome_of(spark, [100, 110, 120, 130], ExitRule("r")) == pytest.approx(-2.0)
    assert outcome_of(spark, [100, 95, 90], ExitRule("r", target=2.0), low=[99, 94, 75]) == pytest.approx(2.0)


def test_stop_is_checked_before_target(spark):
    assert outcome_of(spark, [100, 100], ExitRule("r", target=2.0), high=[100, 125], low=[100, 75]) == pytest.approx(-2.0)


def test_trailing_stop_can_exit_in_profit(spark):
    close = [100, 90, 80, 70, 85, 90]
    assert outcome_of(spark, close, ExitRule("r", trail=1.0)) > 0


def test_entry_on_the_last_bar_is_zero(spark):
    assert outcome_of(spark, [100, 101, 102], ExitRule("r"), at=2) == 0.0


def test_entry_without_atr_is_skipped(spark):
    assert outcome_of(spark, [100, 101, 102], ExitRule("r"), atr=0.0) is None


def test_outcomes_match_whole_paths(spark, bars):
    rules = [ExitRule(f"r{k}", *spec) for k, spec in enumerate([
        (False, 2.0, None, 1.5, 24), (True, 2.0, None, 1.0, 24), (False, 1.0, 1.0, None, 5), (True, 1.5, 2.0, 0.5, 12), (False, 2.0, 2.0, None, 24),
    ])]
    ix = index_bars(bars)
    e = recursive_indicators(ix, ["atr"], keep=("close",)).select(
        "series_id", F.col("bar_idx").alias("entry_idx"), F.col("close").alias("entry_price"), "atr")
    got, raw, atrs = frame(outcome_columns(ix, e, rules), "series_id", "entry_idx"), frame(ix, "series_id", "bar_idx"), frame(e, "series_id", "entry_idx")
    for s, g in got.groupby("series_id"):
        b = raw[raw["series_id"] == s]
        c, h, lo = (b[x].to_numpy() for x in ("close", "high", "low"))
        a = atrs[atrs["series_id"] == s]["atr"].to_numpy()
        for rule in rules:
            want = [path_outcome(i, c, h, lo, a[i], rule) for i in g["entry_idx"]]
            np.testing.assert_allclose(g[rule.name], want, atol=1e-9)


def test_symmetric_rules_are_unbiased_in_direction(bars):
    """Without a trail and with equal stop and target, short is exactly minus long unless both levels are hit in one bar."""
    ix = index_bars(bars)
    e = recursive_indicators(ix, ["atr"], keep=("close",)).select(
        "series_id", F.col("bar_idx").alias("entry_idx"), F.col("close").alias("entry_price"), "atr")
    got = frame(outcome_columns(ix, e, [ExitRule("s", stop=4.0, target=4.0), ExitRule("l", True, stop=4.0, target=4.0)]), "series_id", "entry_idx")
    assert np.isclose(got["s"], -got["l"]).mean() > 0.99


R = [1.0, -1.0, 2.0, -0.5, 3.0]


def trade_frame(spark, r=R, years=None):
    years = years or [2020] * len(r)
    return spark.createDataFrame(
        [("c", i, datetime.datetime(y, 1 + i, 1), x) for i, (x, y) in enumerate(zip(r, years))], "cell string, entry_idx long, entry_ts timestamp, r double")


def test_trade_stats(spark):
    row = trades.trade_stats(trade_frame(spark), ["cell"]).first()
    assert (row.n, row.win_pct, row.best, row.worst, row.max_dd) == (5, 60.0, 3.0, -1.0, -1.0)
    assert row.r_per_trade == pytest.approx(0.9) and row.r_total == pytest.approx(4.5) and row.r_median == 1.0
    assert row.recovery_factor == pytest.approx(4.5)


def test_years(spark):
    t = trade_frame(spark, [2.0, 2.0, -1.0, 2.0, -0.5], [2020, 2020, 2021, 2021, 2022])
    row = trades.year_stats(t, ["cell"]).first()
    assert (row.positive_years, row.years, row.yearly) == (2, 3, {2020: 4.0, 2021: 1.0, 2022: -0.5})


def test_wilson(spark):
    df = spark.createDataFrame([(260, 400), (5, 8), (0, 0), (8, 8), (0, 8)], "w long, n long")
    lo, hi = wilson_bounds(F.col("w").cast("double"), F.col("n"))
    b = [tuple(x) for x in df.select(lo, hi).collect()]
    assert 0.60 < b[0][0] < b[0][1] < 0.70 and b[1][1] - b[1][0] > 0.3
    assert b[2] == (0.0, 0.0) and b[3][1] <= 1 and b[4][0] == 0.0


def test_concentration_uses_whole_groups(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0.5, 1, 333)
    t = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(r)], "cell string, entry_idx long, r double")
    row = trades.concentration(t, ["cell"]).first()
    s = np.sort(r)[::-1]
    assert row.top5_share_pct == pytest.approx(100 * s[:5].sum() / r.sum())
    assert row.top5pct_share_pct == pytest.approx(100 * s[:333 // 20].sum() / r.sum())


def test_p_value(spark):
    xs = [0.0, 0.5, 1.96, 3.0, 6.0]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in xs], "t double").select(two_sided_p(F.col("t"))).collect()]
    np.testing.assert_allclose(got, [math.erfc(abs(x) / math.sqrt(2)) for x in xs], rtol=2e-7)


def bartlett_t(x, lag):
    """Mean over its standard error; the long-run variance is a quadratic form with Bartlett weights."""
    at = np.arange(len(x))
    weights = np.clip(1 - np.abs(at[:, None] - at[None, :]) / (lag + 1), 0, None)
    centred = x - x.mean()
    return x.mean() / np.sqrt(centred @ weights @ centred) * len(x)


@pytest.mark.parametrize("cuts", [[], [1], [3, 4, 9], [50, 60, 61, 62, 200]])
def test_summaries_merge_to_the_whole_statistic(cuts):
    rng = np.random.default_rng(1)
    x = np.convolve(rng.normal(0.1, 1, 320), np.ones(6), "valid")
    for lag in (0, 3, 7, 23):
        n, s1, s2, cross, head, tail = 0, 0.0, 0.0, 0.0, np.empty(0), np.empty(0)
        for part in np.split(x, cuts):
            m, a, b, c, h, t = screen.summarise(part, lag)
            h, t = np.asarray(h), np.asarray(t)
            cross += c + (screen.seam_products(tail, h, lag) if n and lag else 0)
            n, s1, s2 = n + m, s1 + a, s2 + b
            head = np.concatenate([head, h])[:lag]
            both = np.concatenate([tail, t])
            tail = both[len(both) - min(lag, len(both)):]
        mean, t = screen.t_of_summary(n, s1, s2, cross, head, tail, lag)
        assert mean == pytest.approx(x.mean()) and t == pytest.approx(bartlett_t(x, lag))


def test_newey_west_degenerate():
    assert screen.t_of_summary(*screen.summarise(np.zeros(9), 3), 3)[1] == 0.0
    assert screen.t_of_summary(*screen.summarise(np.ones(2), 3), 3)[1] == 0.0
    assert screen.t_of_summary(*screen.summarise(np.full(50, 0.1), 3), 3)[1] == 0.0


def test_screen_guards(bars):
    with pytest.raises(ValueError):
        screen.screen(bars, direction="up")
    with pytest.raises(ValueError):
        quantile_cut(index_bars(bars), 0.99)


def test_screen_finds_a_planted_edge_and_flips_with_direction(spark):
    """Up-runs are followed by falls: the three-up-bars condition must show a short edge."""
    pdf = walk(1200, 9)
    ret = np.random.default_rng(9).normal(0, 0.002, len(pdf))
    for i in range(4, len(ret) - 4):
        if ret[i - 1] > 0 and ret[i - 2] > 0 and ret[i - 3] > 0:
            ret[i] -= 0.004
    close = 1000 * np.cumprod(1 + ret)
    pdf["close"], pdf["open"] = close, np.r_[close[0], close[:-1]]
    pdf["high"], pdf["low"] = pdf[["open", "close"]].max(axis=1) * 1.0005, pdf[["open", "close"]].min(axis=1) * 0.9995
    m = screen.signal_moments(spark.createDataFrame(pdf), None, (4,)).cache()
    short, long = (frame(screen.screen_from_moments(m, d, 20), "signal") for d in ("short", "long"))
    row = short[short["signal"] == "three_up_bars"].iloc[0]
    assert row["edge_pct"] > 0 and row["significant"]
    np.testing.assert_allclose(short["edge_pct"], -long["edge_pct"])
    assert len(screen.screen_from_moments(m, "short", 10_000).collect()) == 0


def test_catalogue_has_61_conditions_in_9_families():
    names = condition_names()
    assert len(names) == len({s for _, s in names}) == 61
    sizes = pd.Series([f for f, _ in names]).value_counts().to_dict()
    assert sizes == {"trend": 8, "strength": 7, "momentum": 14, "volatility": 6, "volume": 3, "vwap": 3, "candles": 5, "extension": 13, "channels": 2}


def test_bounded_oscillators(bars):
    ix = index_bars(bars)
    r = frame(recursive_indicators(ix, ["rsi", "atr", "adx", "laguerre"]), "series_id", "bar_idx")
    assert r["rsi"].dropna().between(0, 100).all() and (r["atr"] > 0).all() and r["adx"].dropna().between(0, 100).all()
    w = frame(own_rows(with_window_indicators(to_blocks(ix.withColumn("vwap", F.lit(None).cast("double")), back=128))), "series_id", "bar_idx").dropna(subset=["bb_upper"])
    assert ((w["bb_lower"] <= w["sma20"]) & (w["sma20"] <= w["bb_upper"])).all()
    assert w["stoch_k"].dropna().between(-1e-9, 100 + 1e-9).all()


def test_entries_are_one_per_day_and_hours_sum_up(bars):
    p = levels.prepare(bars)
    e = frame(mining.cell_entries(p, None), "series_id", "level", "trigger", "entry_idx")
    days = e["entry_ts"].dt.date
    assert not e.assign(d=days).duplicated(["series_id", "level", "trigger", "d"]).any()
    t = mining.cell_entries(p, None).withColumn("r", F.lit(1.0))
    hours = frame(trades.entry_hours(t, mining.CELL), "series_id", "level", "trigger", "hour")
    assert hours["n"].sum() == len(e)


def test_missing_level_never_triggers(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)], "close double, close_lag1 double, lv double")
    for k in (1, 2, 3):
        df = df.withColumn(f"high_lag{k}", F.lit(3.0)).withColumn(f"close_lag{k}", F.lit(2.0))
    for kind in (*levels.TRIGGERS, "close_above", "cross_above"):
        assert df.select(levels.trigger(F.col("lv"), kind)).first()[0] is False


def test_gates_fail_on_missing(spark):
    schema = "n long, excess double, excess_is double, excess_oos double, trails_positive int, mirror_vs_base double"
    df = spark.createDataFrame([(120, 0.1, 0.1, 0.1, 4, -0.1), (120, 0.1, None, 0.1, 2, None)], schema)
    got = [tuple(r.gates) for r in mining.apply_gates(df).collect()]
    assert got == [("sample", "beats_naive", "both_halves", "stable", "directional"), ("sample", "beats_naive")]


def test_bootstrap_runs_do_not_depend_on_the_size_of_a_group(spark, monkeypatch):
    t = spark.createDataFrame([(c, i, float(np.sin(i * (3 if c == "a" else 5)))) for c, n in (("a", 40), ("b", 9), ("c", 1)) for i in range(n)],
                              "series_id string, entry_idx long, r double")
    numbered = bootstrap.number_trades(t, ["series_id"])
    walked = frame(bootstrap.all_runs(numbered, ["series_id"], 50, 3), "series_id", "run")
    monkeypatch.setattr(bootstrap, "GATHERED", 9)
    mixed = frame(bootstrap.all_runs(numbered, ["series_id"], 50, 3), "series_id", "run")
    pd.testing.assert_frame_equal(walked, mixed, atol=1e-9, check_dtype=False)
    assert len(walked) == 150 and (walked["max_dd"] <= 0).all() and set(walked["n"]) == {40, 9, 1}


def test_bootstrap_properties(spark):
    def report(r, **kw):
        t = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(r)], "series_id string, entry_idx long, r double")
        return bootstrap.bootstrap(t, n_runs=200, **kw).first()

    bad = report([-1] * 50 + [0.2, -0.8, float("nan"), float("inf")])
    good = report([1, 1.5, -0.5] * 40)
    assert bad.profit_rate < 30 and bad.n_trades == 52 and good.profit_rate > 70
    assert report([-1] * 5 + [3] * 2, ruin_level=-5.0).bust_rate > 0
    assert report([1, -1, 2, -0.5], seed=3) == report([1, -1, 2, -0.5], seed=3)
    assert good.dd_worst <= good.dd_p05 <= good.dd_p50 <= good.dd_p95 <= 0


def test_symbols_and_numbers(spark):
    s = spark.createDataFrame([("USTECm",), ("USTEC_exness",), ("USTECm_exness",), ("US30m_exness",)], "s string")
    assert [r[0] for r in s.select(norm_symbol("s")).collect()] == ["USTEC", "USTEC", "USTEC", "US30"]
    n = spark.createDataFrame([("1,500.5",), ("8.2%",), ("$900",), ("-",), ("",), ("N/A",), ("S1",), ("1,50",)], "s string")
    got = n.select(number_of("s"), text_of("s")).collect()
    assert [r[0] for r in got] == [1500.5, 8.2, 900.0, None, None, None, None, None]
    assert [r[1] for r in got] == [None] * 6 + ["S1", "1,50"]


SPECS = [
    ("USTEC", "USTECm", 2, 0.01, 112, 1.0, 0.01, 1.0, -0.8, -0.7),
    ("US30", "US30m", 2, 0.01, 40, 1.0, 0.01, 1.0, 0.5, -0.3),
    ("XAUUSD", "XAUUSDm", 2, 0.01, 180, 0.01, 0.01, 100.0, -1.0, 0.2),
]
SPEC_SCHEMA = (
    "symbol string, name string, digits int, point double, spread int, tick_value double, tick_size double, contract double, "
    "swap_long double, swap_short double"
)


def test_swap_costs(spark):
    specs = spark.createDataFrame(SPECS, SPEC_SCHEMA).withColumn("price", F.lit(20000.0))
    one = {r.symbol: r for r in costs.swap_costs(specs).collect()}
    two = {r.symbol: r for r in costs.swap_costs(specs, lots=2.0).collect()}
    u = one["USTEC"]
    assert u.point_value == 1.0 and u.swap_per_night == -0.7 and two["USTEC"].swap_per_night == -1.4
    assert u.notional == 20000 and u.pct_night == pytest.approx(-0.0035) and u.pct_year == pytest.approx(-1.26)
    d = spark.createDataFrame([(-0.7, 4.0, 100, 1000.0), (-0.7, 4.0, 100, 0.0)], "swap_per_night double, avg_nights double, n_trades int, gross_profit double")
    assert [(r.total_swap, r.swap_share_pct) for r in costs.with_swap_drag(d).collect()] == [(-280.0, 28.0), (-280.0, 0.0)]


@pytest.mark.parametrize("target,severity", [(200, "ok"), (140, "warning"), (100, "error")])
def test_target_vs_spread(spark, target, severity):
    specs = spark.createDataFrame(SPECS, SPEC_SCHEMA)
    t = spark.createDataFrame([("USTEC", float(target))], "symbol string, min_target double")
    assert costs.check_target_vs_spread(t, specs).first().severity == severity


def test_sessions(spark):
    from tickloom.sources.broker import clean_sessions

    raw = [("A", d, "00:00", "21:00") for d in ("Mon", "Tue", "Wed", "Thu")] + [("A", d, "22:00", "00:00") for d in ("Mon", "Tue", "Wed", "Thu")]
    raw += [("A", "Fri", "00:00", "20:55"), ("B", "NO_EXISTE", "", ""), ("C", "Sun", "00:00", "10:00")]
    s = clean_sessions(spark.createDataFrame(raw, "symbol string, day string, session_from string, session_to string"))
    assert s.filter("to_min = 1440").count() == 4

    def check(a, b, symbol="A"):
        w = spark.createDataFrame([(symbol, a, b)], "symbol string, window_from long, window_to long")
        return costs.check_window_in_session(w, s).collect()

    assert check(43200, 72000)[0].severity == "ok"
    assert check(43200, 75400)[0].value == 1  # 20:56 misses Friday
    assert check(75600, 80000)[0].value == 5
    assert check(1200, 1330)[0].severity == "ok"  # HHMM
    assert check(43200, 72000, "Z") == [] and check(43200, 72000, "C")[0].value == 5


def test_result_profiles(spark):
    rows = spark.createDataFrame([("S1", 1500.0, 1.85, 1.72, 410.0), ("S2", 900.0, 1.52, 1.38, 320.0)],
                                 "strategyname string, netprofit double, profitfactor double, winlossratio double, numberoftrades double")
    thr = spark.createDataFrame([("numberoftrades", ">=", 300.0), ("profitfactor", ">=", 1.3)], "metric string, comparator string, threshold double")
    m = {r.metric: (r.n_tight, r.n) for r in results.margins(rows, thr).collect()}
    assert m == {"numberoftrades": (1, 2), "profitfactor": (0, 2)}
    f = spark.createDataFrame([(1, "a")] * 100 + [(2, "b")] * 40, "stage_no int, stage string")
    got = sorted(tuple(r) for r in results.funnel(f).collect())
    assert got == [(1, "a", 100, None, None), (2, "b", 40, 60, 60.0)]


def test_name_suggestions_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(configs, "NAME_BUCKET", 3)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcde"), rng.integers(3, 9))) for _ in range(60)]
    known, asked = words[:40], words[30:] + [w + "a" for w in words[:20]]
    cat = spark.createDataFrame([("c", w) for w in known], "category string, name string")
    got = {r.name: r.suggestion for r in configs.name_suggestions(spark.createDataFrame([("c", w) for w in asked], "category string, name string"), cat).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for name in set(asked) - set(known):
        sim, best = max((1 - distance(name, k) / max(len(name), len(k)), k) for k in known)
        assert got[name] == (best if sim >= 0.6 else None)
    assert set(got) == set(asked) - set(known)
