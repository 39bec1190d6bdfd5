"""Bar series and table comparison for the tests."""

import numpy as np
import pandas as pd


def walk(n: int, seed: int, series: str = "A", start: str = "2024-01-01", freq: str = "1h") -> pd.DataFrame:
    """A random-walk bar series with gaps on weekends."""
    rng = np.random.default_rng(seed)
    ts = pd.date_range(start, periods=n * 2, freq=freq)
    ts = ts[ts.dayofweek < 5][:n]
    close = 1000 + np.cumsum(rng.normal(0, 3, n))
    open_ = np.r_[close[0], close[:-1]] + rng.normal(0, 1, n)
    return pd.DataFrame({
        "series_id": series, "ts": ts, "open": open_, "high": np.maximum(open_, close) + np.abs(rng.normal(0, 2, n)),
        "low": np.minimum(open_, close) - np.abs(rng.normal(0, 2, n)), "close": close,
        "volume": rng.integers(0, 50, n).astype(float),
    })


def frame(df, *keys):
    out = df.toPandas()
    out = out[sorted(out.columns)]
    return out.sort_values(list(keys), ignore_index=True)


def same(left, right, *keys, tol=1e-8):
    """Equal tables up to row order and rounding."""
    a, b = frame(left, *keys), frame(right, *keys)
    pd.testing.assert_frame_equal(a, b, rtol=tol, atol=tol, check_dtype=False)
    return a


def path_outcome(i, close, high, low, atr, rule):
    """The outcome from whole paths, in units of ATR: the stop level of each bar, then the first bar that meets a level."""
    side = 1.0 if rule.long else -1.0
    path = slice(i + 1, min(i + rule.hold, len(close) - 1) + 1)
    good, bad = (high, low) if rule.long else (low, high)
    favourable, adverse = (side * (x[path] - close[i]) / atr for x in (good, bad))
    levels = np.full(len(adverse), -rule.stop)
    if rule.trail is not None and len(levels) > 1:
        best = np.maximum.accumulate(np.maximum(favourable, 0.0))
        levels[1:] = np.maximum(levels[1:], best[:-1] - rule.trail)
    stopped = adverse <= levels
    reached = favourable >= rule.target if rule.target is not None else np.zeros(len(levels), bool)
    if not (stopped | reached).any():
        return side * (close[path.stop - 1] - close[i]) / atr
    first = int((stopped | reached).argmax())
    return levels[first] if stopped[first] else rule.target
