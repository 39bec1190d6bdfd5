"""Oracle SQL of levels, triggers, entries and outcomes."""

from __future__ import annotations

from tickloom.plans.common import bars_sql, lag, roll
from tickloom.plans.oracle_indicators import PREPARED, Recurrence, _alpha

LEVELS = (
    "orb_low", "orb_high", "session_open", "ib_low", "ib_high", "overnight_low", "overnight_high", "vwap",
    "vwap_minus_sd", "vwap_plus_sd", "prev_day_low", "prev_day_high", "prev_day_close", "prev_week_low", "prev_week_high",
)


def atr_sql(name: str = "ra", source: str = "pre") -> str:
    r = Recurrence(name, source)
    r.ewm("atr", "p.tr", "p.tr", _alpha(14))
    return r.sql()


LEVEL_CTES = f"""{bars_sql()},
{PREPARED},
{atr_sql()},
b0 AS (SELECT pre.*, ra.atr, (ts + INTERVAL 4 HOUR)::DATE AS skey,
    {roll('stddev_samp', 'close', 20).replace('series_id', 'pre.series_id').replace('bar_idx', 'pre.bar_idx')} AS sd
  FROM pre JOIN ra ON ra.series_id = pre.series_id AND ra.bar_idx = pre.bar_idx),
b1 AS (SELECT *, {lag('sd')} AS sd1, {lag('vwap', 3)} AS vwap3,
    {', '.join(f'{lag(c, k)} AS {c[0]}{k}' for c in ('close', 'high') for k in (1, 2, 3))} FROM b0),
sess AS (SELECT series_id, skey, min(low) FILTER (hr = 13) AS orb_low, max(high) FILTER (hr = 13) AS orb_high,
    min(low) FILTER (hr IN (13, 14)) AS ib_low, max(high) FILTER (hr IN (13, 14)) AS ib_high,
    min(low) FILTER (hr >= 20 OR hr <= 12) AS ovl, max(high) FILTER (hr >= 20 OR hr <= 12) AS ovh,
    max(open) FILTER (hr = 13) AS so FROM idx_key GROUP BY 1, 2),
idx_key AS (SELECT *, (ts + INTERVAL 4 HOUR)::DATE AS skey FROM idx),
d1 AS (SELECT series_id, day, min(low) AS l, max(high) AS h, arg_max(close, ts) AS c FROM idx GROUP BY 1, 2),
d2 AS (SELECT *, lag(l) OVER d AS pdl, lag(h) OVER d AS pdh, lag(c) OVER d AS pdc,
    count(*) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 AND
    h - l <= min(h - l) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS narrow
  FROM d1 WINDOW d AS (PARTITION BY series_id ORDER BY day)),
d3 AS (SELECT *, coalesce(lag(narrow) OVER (PARTITION BY series_id ORDER BY day), false) AS nr7 FROM d2),
w1 AS (SELECT series_id, date_trunc('week', day)::DATE AS wk, min(low) AS l, max(high) AS h FROM idx GROUP BY 1, 2),
w2 AS (SELECT series_id, wk, lag(l) OVER w AS pwl, lag(h) OVER w AS pwh FROM w1 WINDOW w AS (PARTITION BY series_id ORDER BY wk)),
o13 AS (SELECT series_id, day, arg_max(low, ts) AS rl, arg_max(high, ts) AS rh FROM idx WHERE hr = 13 GROUP BY 1, 2),
lv AS (SELECT b1.*, nr7,
    CASE WHEN hr BETWEEN 14 AND 19 THEN s.orb_low END AS orb_low, CASE WHEN hr BETWEEN 14 AND 19 THEN s.orb_high END AS orb_high,
    CASE WHEN hr BETWEEN 14 AND 19 THEN so END AS session_open,
    CASE WHEN hr BETWEEN 15 AND 19 THEN s.ib_low END AS ib_low, CASE WHEN hr BETWEEN 15 AND 19 THEN s.ib_high END AS ib_high,
    CASE WHEN hr BETWEEN 13 AND 19 THEN ovl END AS overnight_low, CASE WHEN hr BETWEEN 13 AND 19 THEN ovh END AS overnight_high,
    CASE WHEN hr >= 13 THEN vwap END AS vwap_lv, CASE WHEN hr >= 13 THEN vwap - sd1 END AS vwap_minus_sd,
    CASE WHEN hr >= 13 THEN vwap + sd1 END AS vwap_plus_sd,
    pdl AS prev_day_low, pdh AS prev_day_high, pdc AS prev_day_close, pwl AS prev_week_low, pwh AS prev_week_high,
    CASE WHEN hr >= 13 THEN rl END AS range_low, CASE WHEN hr >= 13 THEN rh END AS range_high,
    (vwap - vwap3) / nullif(atr, 0) AS vwap_slope
  FROM b1 LEFT JOIN sess s ON s.series_id = b1.series_id AND s.skey = b1.skey
  LEFT JOIN d3 ON d3.series_id = b1.series_id AND d3.day = b1.day
  LEFT JOIN w2 ON w2.series_id = b1.series_id AND w2.wk = date_trunc('week', b1.day)::DATE
  LEFT JOIN o13 ON o13.series_id = b1.series_id AND o13.day = b1.day),
lvl AS (SELECT * EXCLUDE s, s.level AS level, s.value AS value FROM (SELECT *, unnest([{', '.join(
    f"{{'level': '{n}', 'value': {'vwap_lv' if n == 'vwap' else n}}}" for n in LEVELS)}]) AS s FROM lv)
  WHERE s.value IS NOT NULL),
trg AS (
  SELECT *, 'close_below' AS trigger FROM lvl WHERE close < value
  UNION ALL SELECT *, 'cross_below' FROM lvl WHERE c1 >= value AND close < value
  UNION ALL SELECT *, 'retest_reject' FROM lvl WHERE close < value AND
    (coalesce(h1 >= value AND c1 < value, false) OR coalesce(h2 >= value AND c2 < value, false)
     OR coalesce(h3 >= value AND c3 < value, false)))"""
LEVEL_CTES = LEVEL_CTES.replace(
    "sess AS (SELECT", "idx_key AS (SELECT *, (ts + INTERVAL 4 HOUR)::DATE AS skey FROM idx),\nsess AS (SELECT", 1
).replace("\nidx_key AS (SELECT *, (ts + INTERVAL 4 HOUR)::DATE AS skey FROM idx),\nd1", "\nd1")


def entries_sql(name: str, source: str, keys: str, where: str = "true", atr_test: str = "atr > 0", split="floor(n_bars * 0.6)") -> str:
    """First firing bar per day and key."""
    return f"""{name} AS (SELECT series_id, {keys + ', ' if keys else ''}bar_idx AS entry_idx, ts AS entry_ts,
    close AS entry_price, atr, bar_idx <= {split} AS is_sample, n_bars FROM {source} WHERE {where} AND {atr_test}
  QUALIFY row_number() OVER (PARTITION BY series_id, {keys + ', ' if keys else ''}day ORDER BY bar_idx) = 1)"""


def outcome_sql(name: str, entries: str, rules, bars: str = "idx") -> str:
    """R per distinct entry bar, one column per exit rule."""
    cols = []
    for r in rules:
        s = "1" if r.long else "-1"
        worst, best = ("low", "high") if r.long else ("-high", "-low")
        seen = "top" if r.long else "-bot"
        stop = f"({s} * e - {r.stop} * a)"
        if r.trail is not None:
            stop = f"(CASE WHEN {seen} IS NULL THEN {stop} ELSE greatest({stop}, greatest({s} * e, {seen}) - {r.trail} * a) END)"
        x = f"CASE WHEN {worst} <= {stop} THEN ({stop} - {s} * e) / a"
        hit = f"{worst} <= {stop}"
        if r.target is not None:
            x += f" WHEN {best} >= {s} * e + {r.target} * a THEN {r.target}::DOUBLE"
            hit = f"({hit} OR {best} >= {s} * e + {r.target} * a)"
        cols.append(f"""coalesce(arg_min({x} END, step) FILTER ({hit} AND step <= {r.hold}),
      arg_max(({s} * close - {s} * e) / a, step) FILTER (step <= {r.hold}), 0.0) AS {r.name}""")
    hold = max(r.hold for r in rules)
    return f"""{name}_p AS (SELECT e.series_id, e.entry_idx, e.entry_price AS e, e.atr AS a, f.bar_idx - e.entry_idx AS step,
    f.high, f.low, f.close FROM (SELECT DISTINCT series_id, entry_idx, entry_price, atr FROM {entries} WHERE atr > 1e-9) e
  LEFT JOIN {bars} f ON f.series_id = e.series_id AND f.bar_idx BETWEEN e.entry_idx + 1 AND e.entry_idx + {hold}),
{name}_q AS (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bot FROM {name}_p
  WINDOW w AS (PARTITION BY series_id, entry_idx ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT series_id, entry_idx, {', '.join(cols)} FROM {name}_q GROUP BY 1, 2)"""
