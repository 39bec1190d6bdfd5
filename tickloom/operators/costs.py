"""Cost audits: swaps, spreads, sessions, break-even rates and specification differences.

Checks return findings rows (check, severity, symbol, value, limit); severities are
error, warning, info and ok.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.columns import no_zero, norm_symbol

SEVERITIES = ("error", "warning", "info", "ok")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri")
WEEKEND = ("Sat", "Sun")


def point_value() -> Column:
    """Account value of one point for one lot; 0 where the broker quotes no tick."""
    usable = (F.col("tick_size") > 0) & (F.col("tick_value") != 0)
    return F.coalesce(
        F.when(usable, F.col("tick_value") * (F.col("point") / no_zero("tick_size"))), F.lit(0.0)
    )


def swap_points(direction: str | Column) -> Column:
    d = F.lit(direction) if isinstance(direction, str) else direction
    return F.when(d == "long", F.col("swap_long")).otherwise(F.col("swap_short"))


def swap_costs(specs: DataFrame, direction: str = "short", lots: float = 1.0, price: Column | str = "price",
               annual_days: int = 360) -> DataFrame:
    """Point value, swap per night, notional, nightly and annualised percent."""
    p = F.coalesce(F.col(price) if isinstance(price, str) else price, F.lit(0.0))
    night = swap_points(direction) * point_value() * lots
    notional = p * F.col("contract") * lots
    pct = F.when(notional > 0, night / no_zero(notional) * 100).otherwise(F.lit(0.0))
    return specs.withColumns({
        "point_value": point_value(), "swap_per_night": night, "notional": notional,
        "pct_night": pct, "pct_year": pct * annual_days,
        "mode": F.when(point_value() == 0, F.lit("unknown")).otherwise(F.lit("points")),
    })


def with_swap_drag(df: DataFrame) -> DataFrame:
    """Total swap of a strategy and its share of gross profit (0 without gross profit).

    Needs swap_per_night, avg_nights, n_trades, gross_profit.
    """
    total = F.col("swap_per_night") * F.col("avg_nights") * F.col("n_trades")
    share = F.coalesce(F.abs(100 * total / no_zero("gross_profit")), F.lit(0.0))
    return df.withColumns({"total_swap": total, "swap_share_pct": share})


def swap_audit(requests: DataFrame, costs: DataFrame) -> DataFrame:
    """Costs of requested symbols; a symbol without a specification is reported as an error."""
    wanted = requests.withColumn("symbol", norm_symbol("requested"))
    found = F.col("s.symbol").isNotNull()
    return wanted.alias("r").join(costs.alias("s"), "symbol", "left").select(
        F.col("r.requested"), "symbol", "swap_per_night", "pct_year", "notional", "point_value", "mode",
        F.when(found, F.lit("ok")).otherwise(F.lit("error")).alias("severity"),
    )


def finding(df: DataFrame, check: str, severity: Column, value: Column, limit: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), severity.alias("severity"), F.col("symbol").cast("string").alias("symbol"),
        value.cast("double").alias("value"), limit.cast("double").alias("limit"),
    )


def check_target_vs_spread(targets: DataFrame, specs: DataFrame) -> DataFrame:
    """Minimum target against the live spread: under 1.2 error, under 1.5 warning; no spread is info."""
    j = targets.filter(F.col("min_target").isNotNull()).join(specs.select("symbol", "spread"), "symbol")
    ratio = F.col("min_target") / F.nullif(F.col("spread").cast("double"), F.lit(0.0))
    severity = (
        F.when(F.col("spread") <= 0, F.lit("info")).when(ratio < 1.2, F.lit("error"))
        .when(ratio < 1.5, F.lit("warning")).otherwise(F.lit("ok"))
    )
    return finding(j, "target_vs_spread", severity, F.col("min_target"), F.col("spread"))


def clock_minutes(value: Column) -> Column:
    """Seconds from midnight, or HHMM for values under 1440."""
    v = value.cast("bigint")
    return F.when(v >= 1440, F.floor(v / 60)).otherwise(F.floor(v / 100) * 60 + v % 100)


def day_coverage(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per window and day: whether the symbol has a session that day, and one that holds the window.

    One equi join on (symbol, day); the containment test is an aggregate over the
    day's sessions.
    """
    days = F.explode(F.array(*[F.lit(d) for d in (*WEEKDAYS, *WEEKEND)]))
    judged = windows.select(
        "symbol", clock_minutes(F.col("window_from")).alias("a"), clock_minutes(F.col("window_to")).alias("b"), days.alias("day")
    )
    daily = judged.join(sessions.select("symbol", "day", "from_min", "to_min"), ["symbol", "day"], "left")
    holds = (F.col("from_min") <= F.col("a")) & (F.col("b") <= F.col("to_min"))
    return daily.groupBy("symbol", "a", "b", "day").agg(
        F.max(F.col("from_min").isNotNull()).alias("has_session"), F.max(F.coalesce(holds, F.lit(False))).alias("covered"))


def uncovered_days(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Monday-Friday days on which no single session holds the entry window.

    Windows of symbols without any session are not judged.
    """
    bad = F.array_sort(F.collect_list(F.when(~F.col("covered") & F.col("day").isin(*WEEKDAYS), F.col("day"))))
    per = day_coverage(windows, sessions).groupBy("symbol", "a", "b").agg(
        F.max("has_session").alias("known"), bad.alias("days"))
    return per.filter("known").select("symbol", "a", "b", F.explode("days").alias("day"))


def check_window_in_session(windows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Error with the number of uncovered weekdays, or ok."""
    per = day_coverage(windows, sessions).groupBy("symbol", "a", "b").agg(
        F.max("has_session").alias("known"),
        F.sum((~F.col("covered") & F.col("day").isin(*WEEKDAYS)).cast("bigint")).alias("bad_days"))
    severity = F.when(F.col("bad_days") > 0, F.lit("error")).otherwise(F.lit("ok"))
    return finding(per.filter("known"), "window_in_session", severity, F.col("bad_days"), F.lit(0))


WEEK = 7 * 1440


def open_spans(sessions: DataFrame) -> DataFrame:
    """(symbol, opens, closes): when a symbol trades without a break, in minutes from Monday 00:00 over two weeks.

    Sessions that touch or overlap are one span, over midnight and from Sunday to Monday too; the second week
    gives every minute of the first a next close.  One window over a symbol's sessions of a week.
    """
    number = F.create_map(*[F.lit(x) for k, d in enumerate((*WEEKDAYS, *WEEKEND)) for x in (d, k)])
    start = F.element_at(number, F.col("day")) * 1440
    week = sessions.filter(F.col("day").isin(*WEEKDAYS, *WEEKEND) & (F.col("to_min") > F.col("from_min"))).select(
        "symbol", (start + F.col("from_min")).alias("opens"), (start + F.col("to_min")).alias("closes")).distinct()
    both = week.select("symbol", F.explode(F.array(F.lit(0), F.lit(WEEK))).alias("shift"), "opens", "closes").select(
        "symbol", (F.col("opens") + F.col("shift")).alias("opens"), (F.col("closes") + F.col("shift")).alias("closes"))
    w = Window.partitionBy("symbol").orderBy("opens", "closes")
    before = F.max("closes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.withColumn("new", F.coalesce(F.col("opens") > before, F.lit(True)).cast("int"))
    return marked.withColumn("span", F.sum("new").over(w)).groupBy("symbol", "span").agg(
        F.min("opens").alias("opens"), F.max("closes").alias("closes")).drop("span")


def time_stop_reach(windows: DataFrame, sessions: DataFrame, bar_minutes: int = 60) -> DataFrame:
    """Per symbol and weekday: how many bars after the end of the entry window the symbol still trades.

    ``bars_left`` is null on days on which the window's end lies in no session.  An equi-join by symbol with
    its few spans; the span that holds the end is found by aggregation.
    """
    days = F.explode(F.array(*[F.struct(F.lit(d).alias("day"), F.lit(k * 1440).alias("start")) for k, d in enumerate(WEEKDAYS)]))
    ends = windows.select("symbol", clock_minutes(F.col("window_to")).alias("window_end"), days.alias("d"))
    judged = ends.select("symbol", "window_end", "d.day", (F.col("d.start") + F.col("window_end")).alias("at")).join(open_spans(sessions), "symbol")
    holds = (F.col("opens") <= F.col("at")) & (F.col("at") < F.col("closes"))
    left = F.floor((F.col("closes") - F.col("at")) / bar_minutes).cast("int")
    return judged.groupBy("symbol", "window_end", "day").agg(F.max(F.when(holds, left)).alias("bars_left"))


def notice_time_stop(exits: DataFrame, windows: DataFrame | None = None, sessions: DataFrame | None = None, bar_minutes: int = 60) -> DataFrame:
    """Info for every symbol with a time stop (``max_exit_bars``); the limit is unknown without sessions.

    With windows and sessions only symbols that have sessions are judged; the limit is the number of bars that are left before the
    next close on the worst weekday, and a longer stop reaches over a close.
    """
    stops = exits.filter(F.col("max_exit_bars") > 0)
    if windows is None or sessions is None:
        return finding(stops, "time_stop", F.lit("info"), F.col("max_exit_bars"), F.lit(None))
    reach = time_stop_reach(windows, sessions, bar_minutes).groupBy("symbol").agg(F.min("bars_left").alias("bars_left"))
    known = sessions.select("symbol").distinct()
    judged = stops.join(known, "symbol").join(reach, "symbol", "left")
    return finding(judged, "time_stop", F.lit("info"), F.col("max_exit_bars"), F.col("bars_left"))


def check_swap_direction(specs: DataFrame, direction: str = "short") -> DataFrame:
    """Warning where holding overnight costs; direction "both" judges each side."""
    sides = ("long", "short") if direction == "both" else (direction,)
    parts = []
    for side in sides:
        points = swap_points(side)
        severity = F.when(points < 0, F.lit("warning")).otherwise(F.lit("ok"))
        parts.append(finding(specs, f"swap_{side}", severity, points, F.lit(0)))
    return reduce(DataFrame.unionByName, parts)


def break_even(ratios: DataFrame, specs: DataFrame) -> DataFrame:
    """Break-even win rates of a reward/risk range (percent), and the extra the spread adds."""
    j = ratios.join(specs.filter(F.col("spread") > 0).select("symbol", "spread"), "symbol").filter(
        F.col("rrr_from").isNotNull() & F.col("rrr_to").isNotNull()
    )
    return j.select(
        "symbol", "rrr_from", "rrr_to", "spread",
        (1 / (1 + F.col("rrr_to") / 100)).alias("best_rate"), (1 / (1 + F.col("rrr_from") / 100)).alias("worst_rate"),
        (F.col("spread") / F.greatest(F.col("rrr_to"), F.lit(1e-9))).alias("spread_extra"),
    )


def notice_break_even(ratios: DataFrame, specs: DataFrame) -> DataFrame:
    return finding(break_even(ratios, specs), "break_even", F.lit("info"), F.col("worst_rate"), F.col("best_rate"))


def check_stress_spread(stress: DataFrame, specs: DataFrame) -> DataFrame:
    """Stress-test spread range against the live spread; an unquoted symbol uses the first quoted one by name."""
    fallback = specs.filter(F.col("spread") > 0).agg(F.min_by("spread", "symbol").alias("any_spread"))
    live = F.coalesce(F.nullif(F.col("spread"), F.lit(0)), fallback.scalar(), F.lit(0))
    j = stress.join(specs.select("symbol", "spread"), "symbol", "left").withColumn("live", live)
    severity = (
        F.when(F.col("live") == 0, F.lit("info")).when(F.col("stress_max") < F.col("live"), F.lit("error")).otherwise(F.lit("ok"))
    )
    factor = F.col("live") / F.greatest(F.col("stress_max"), F.lit(1e-9))
    return j.select(
        F.lit("stress_spread").alias("check"), severity.alias("severity"), F.col("symbol").cast("string").alias("symbol"),
        F.col("live").cast("double").alias("value"), F.col("stress_max").cast("double").alias("limit"),
        F.when(severity == "error", factor).alias("factor"),
    )


def all_findings(*parts: DataFrame) -> DataFrame:
    cols = ["check", "severity", "symbol", "value", "limit"]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def registry_differences(registry: DataFrame, specs: DataFrame) -> DataFrame:
    """Fields in which a registry disagrees with the live specification.

    Tolerances: 1e-9 for tick size and decimals, 0.51 points for swaps, 1 % for the
    point value (only where the broker quotes a tick).  A missing symbol is one row.
    """
    reg = registry.withColumn("symbol", norm_symbol("instrument"))
    live = specs.select("symbol", *[F.col(c).cast("double").alias(f"live_{c}") for c in
                                    ("point", "digits", "swap_long", "swap_short", "tick_value", "tick_size")])
    j = reg.join(live, "symbol", "left")
    gone = F.col("live_point").isNull()
    quoted = (F.col("live_tick_value") != 0) & (F.col("live_tick_size") != 0)
    real_pv = F.when(quoted, F.col("live_tick_value") / no_zero("live_tick_size"))

    def pair(field: str, mine: str, theirs: Column, differs: Column) -> Column:
        return F.when(~gone & differs, F.struct(
            F.lit(field).alias("field"), F.col(mine).cast("double").alias("registry"), theirs.alias("live")))

    def off(mine: str, theirs: str, tol: float) -> Column:
        return F.abs(F.coalesce(F.col(mine), F.lit(0.0)) - F.col(theirs)) > tol

    pv_off = F.abs(F.coalesce(F.col("point_value"), F.lit(0.0)) - real_pv) / F.greatest(real_pv, F.lit(1e-9)) > 0.01
    nothing = F.lit(None).cast("double")
    rows = F.array_compact(F.array(
        F.when(gone, F.struct(F.lit("existence").alias("field"), nothing.alias("registry"), nothing.alias("live"))),
        pair("tick_size", "tick_size", F.col("live_point"), off("tick_size", "live_point", 1e-9)),
        pair("decimals", "decimals", F.col("live_digits"), off("decimals", "live_digits", 1e-9)),
        pair("swap_long", "swap_long", F.col("live_swap_long"), off("swap_long", "live_swap_long", 0.51)),
        pair("swap_short", "swap_short", F.col("live_swap_short"), off("swap_short", "live_swap_short", 0.51)),
        pair("point_value", "point_value", F.round(real_pv, 4), pv_off),
    ))
    return j.select("instrument", F.explode(rows).alias("d")).select("instrument", "d.*")


def fill_from_registry(specs: DataFrame, registry: DataFrame) -> DataFrame:
    """Live values, with spread, point value and triple-swap day taken from the registry where the broker gives none."""
    prev = registry.select(
        norm_symbol("instrument").alias("symbol"), F.col("spread").alias("_spread"),
        F.col("point_value").alias("_pv"), F.col("triple_day").alias("_day"),
    )
    # several instruments of one symbol: the greatest values decide
    prev = prev.groupBy("symbol").agg(F.max("_spread").alias("_spread"), F.max("_pv").alias("_pv"), F.max("_day").alias("_day"))
    metal_or_oil = F.col("symbol").rlike("^(X|USOIL|UKOIL)")
    quoted = (F.col("tick_size") != 0) & (F.col("tick_value") != 0)
    live_pv = F.when(quoted, F.col("tick_value") / no_zero("tick_size"))
    j = specs.join(prev, "symbol", "left")
    return j.select(
        "symbol", "name",
        F.coalesce(F.when(F.col("spread") > 0, F.col("spread").cast("double")), F.col("_spread"), F.lit(0.0)).alias("spread"),
        F.coalesce(live_pv, F.col("_pv"), F.lit(0.0)).alias("point_value"),
        F.coalesce("_day", F.when(metal_or_oil, F.lit("WEDNESDAY")).otherwise(F.lit("FRIDAY"))).alias("triple_day"),
    )


def resolve_symbols(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Broker name for each requested symbol: itself, then base plus _exness, m, c, then the bare base.

    The first candidate that exists wins; otherwise the request is kept.
    """
    base = F.regexp_replace("requested", r"(_exness|[mc])$", "")
    cands = F.array(F.col("requested"), F.concat(base, F.lit("_exness")), F.concat(base, F.lit("m")), F.concat(base, F.lit("c")), base)
    tried = requests.select("requested", base.alias("base")).distinct().select(
        "requested", "base", F.posexplode(cands).alias("priority", "name"))
    hits = tried.join(names.select("name").distinct(), "name").groupBy("requested").agg(
        F.min_by("name", "priority").alias("resolved"))
    out = requests.select("requested", base.alias("base")).distinct().join(hits, "requested", "left")
    name = F.coalesce("resolved", "requested")
    suffix = F.when(F.col("resolved").isNotNull(), F.expr("substring(resolved, length(base) + 1)")).otherwise(F.lit(""))
    return out.select("requested", name.alias("resolved"), F.col("resolved").isNotNull().alias("exists"), suffix.alias("suffix"))


def detected_suffix(resolved: DataFrame) -> DataFrame:
    """The broker's suffix: _exness if any name carries it, else the first non-empty one by request."""
    any_long = F.max(F.when(F.col("suffix") == "_exness", F.lit("_exness")))
    first = F.min_by("suffix", F.when(F.col("suffix") != "", F.col("requested")))
    return resolved.agg(F.coalesce(any_long, first, F.lit("")).alias("suffix"))
