"""Audits over collections of strategy configurations (normalised tables).

Comparisons tag each configuration with the role it plays in a pair or triple,
join its rows once on config_id, and aggregate per (comparison, key): no
configuration is joined with another row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickloom.sources.strategies import _CANONICAL

NAME_BUCKET = 256
# Sentinel parameter limits that mean "unset".
UNSET = ("null", "-1000001", "-1000002", "-1000003", "-1000004")
DRIFT_TRADING_KEYS = (
    "LimitTimeRange", "SignalTimeRangeFrom", "SignalTimeRangeTo", "MaxTradesPerDay", "DontTradeOnWeekends", "ExitOnFriday",
    "FridayExitTime", "PickerMaxOpenPositionsShort", "PickerMaxOpenPositionsLong", "RealisticGapsHandling",
)
DRIFT_SLPT_KEYS = (
    "LimitSLPTRRR", "LimitSLPTRRRFrom", "LimitSLPTRRRTo", "MinSLATRMultiple", "MaxSLATRMultiple",
    "MinPTATRMultiple", "MaxPTATRMultiple", "MinSLInPips", "MinPTInPips",
)


def active_blocks(blocks: DataFrame, category: str | None = None, active_only: bool = True) -> DataFrame:
    out = blocks.filter("use") if active_only else blocks
    return out.filter(F.col("category") == category) if category is not None else out


def category_counts(blocks: DataFrame) -> DataFrame:
    """Active blocks per configuration and category, with their sorted keys."""
    return active_blocks(blocks).groupBy("config_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("key")).alias("keys")
    )


def distinct_indicators(blocks: DataFrame, params: DataFrame) -> DataFrame:
    """First active block of each key, with its set parameters as (key, name, value)."""
    first = active_blocks(blocks).groupBy("config_id", "key").agg(
        F.min("block_idx").alias("block_idx"), F.min_by("category", "block_idx").alias("category"))
    known = params.filter(
        (F.coalesce("param_type", F.lit("")) != "null") & F.col("value").isNotNull() & (F.col("value") != "")
    ).select("config_id", "block_idx", "param_idx", F.col("key").alias("p_key"), "name", "value")
    entry = F.when(F.col("p_key").isNotNull(), F.struct("param_idx", F.col("p_key").alias("key"), "name", "value"))
    return first.join(known, ["config_id", "block_idx"], "left").groupBy("config_id", "key", "category").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda p: F.struct(p["key"], p["name"], p["value"])).alias("params"))


def _roles(comparisons: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(comparison_id, role, config_id) from one row per comparison with a column per role."""
    return comparisons.unpivot(["comparison_id"], list(roles), "role", "config_id")


def _side(role: str, value: Column) -> Column:
    return F.max(F.when(F.col("role") == role, value))


def block_differences(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Active keys only in a, only in b, or in both.  ``pairs``: comparison_id, a, b."""
    items = active_blocks(blocks).select("config_id", "key").join(_roles(pairs, ("a", "b")), "config_id")
    g = items.groupBy("comparison_id", "key").agg(
        _side("a", F.lit(True)).alias("_a"), _side("b", F.lit(True)).alias("_b"))
    where = F.when(F.col("_b").isNull(), F.lit("only_a")).when(F.col("_a").isNull(), F.lit("only_b")).otherwise(F.lit("both"))
    return g.select("comparison_id", "key", where.alias("where"))


def category_differences(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Categories whose active counts differ."""
    items = active_blocks(blocks).select("config_id", "category").join(_roles(pairs, ("a", "b")), "config_id")
    g = items.groupBy("comparison_id", "category").agg(
        F.sum((F.col("role") == "a").cast("bigint")).alias("n_a"), F.sum((F.col("role") == "b").cast("bigint")).alias("n_b"))
    return g.filter("n_a <> n_b").withColumn("difference", F.col("n_a") - F.col("n_b"))


def value_differences(options: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys whose values differ; a missing key differs from any value."""
    items = options.select("config_id", "key", "value").join(_roles(pairs, ("a", "b")), "config_id")
    g = items.groupBy("comparison_id", "key").agg(
        _side("a", F.struct("value")).alias("_a"), _side("b", F.struct("value")).alias("_b"))
    return g.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        "comparison_id", "key", F.col("_a.value").alias("value_a"), F.col("_b.value").alias("value_b"))


def pair_summary(configs: DataFrame, blocks: DataFrame, setups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether type and version agree, and how many blocks (all, active, active in both) and setups each side has."""
    roles = _roles(pairs, ("a", "b"))
    building = blocks.groupBy("config_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.when(F.col("use"), F.col("key"))).alias("active"))
    n_setups = setups.groupBy("config_id").agg(F.count(F.lit(1)).alias("setups"))
    per = roles.join(configs.select("config_id", "type", "version"), "config_id", "left").join(building, "config_id", "left").join(n_setups, "config_id", "left")
    counts = ("total", "active", "setups")
    wide = per.groupBy("comparison_id").agg(
        *[_side(r, F.col(c)).alias(f"{c}_{r}") for c in ("type", "version") for r in ("a", "b")],
        *[F.coalesce(_side(r, F.col(c)), F.lit(0)).alias(f"{c}_{r}") for c in counts for r in ("a", "b")])
    shared = block_differences(blocks, pairs).filter(F.col("where") == "both").groupBy("comparison_id").agg(F.count(F.lit(1)).alias("common"))
    return wide.join(shared, "comparison_id", "left").select(
        "comparison_id", F.col("type_a").eqNullSafe(F.col("type_b")).alias("type_match"), F.col("version_a").eqNullSafe(F.col("version_b")).alias("version_match"),
        *[f"{c}_{r}" for c in ("type", *counts) for r in ("a", "b")], F.coalesce("common", F.lit(0)).alias("common"))


def chart_lists(setups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether both configurations chart the same symbols in the same order."""
    per = setups.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("setup_idx", "symbols"))).alias("_s"))
    per = per.select("config_id", F.flatten(F.transform("_s", lambda s: s["symbols"])).alias("charts"))
    g = _roles(pairs, ("a", "b")).join(per, "config_id", "left").groupBy("comparison_id").agg(
        _side("a", F.col("charts")).alias("charts_a"), _side("b", F.col("charts")).alias("charts_b"))
    return g.withColumn("charts_match", F.col("charts_a").eqNullSafe(F.col("charts_b")))


def drift(items: DataFrame, triples: DataFrame, missing_is_reverted: bool = False) -> DataFrame:
    """Settings that did not survive saving: same, reverted to the base, or changed.

    ``items``: config_id, key, value; ``triples``: comparison_id, base, generated,
    saved.  Only keys of the generated or saved configuration are judged.  With
    ``missing_is_reverted`` a key absent after saving counts as reverted.
    """
    roles = ("base", "generated", "saved")
    g = items.select("config_id", "key", "value").join(_roles(triples, roles), "config_id").groupBy(
        "comparison_id", "key").agg(*[_side(r, F.struct("value")).alias(f"_{r}") for r in roles])
    gen, saved, base = F.col("_generated"), F.col("_saved"), F.col("_base")
    reverted = saved.eqNullSafe(base)
    if missing_is_reverted:
        reverted = reverted | saved.isNull()
    status = F.when(gen.eqNullSafe(saved), F.lit("same")).when(reverted, F.lit("reverted")).otherwise(F.lit("changed"))
    return g.filter(gen.isNotNull() | saved.isNotNull()).select(
        "comparison_id", "key", status.alias("status"), F.col("_base.value").alias("base"),
        F.col("_generated.value").alias("generated"), F.col("_saved.value").alias("saved"))


def drift_summary(drifts: DataFrame) -> DataFrame:
    return drifts.groupBy("comparison_id").agg(*[
        F.sum((F.col("status") == s).cast("bigint")).alias(s) for s in ("same", "reverted", "changed")])


def trading_items(options: DataFrame) -> DataFrame:
    return options.filter(F.col("key").isin(*DRIFT_TRADING_KEYS)).select("config_id", F.concat(F.lit("trading."), "key").alias("key"), "value")


def slpt_items(slpt: DataFrame) -> DataFrame:
    return slpt.filter(F.col("key").isin(*DRIFT_SLPT_KEYS)).select("config_id", F.concat(F.lit("slpt."), "key").alias("key"), "value")


def fitness_items(fitness: DataFrame) -> DataFrame:
    """The ranking of a configuration as one setting."""
    return fitness.select("config_id", F.lit("fitness").alias("key"), F.concat_ws("/", "method", "use_by_index", "type").alias("value"))


def ranking_items(conditions: DataFrame) -> DataFrame:
    kept = conditions.filter("use AND column IS NOT NULL AND numeric IS NOT NULL")
    return kept.select("config_id", F.concat_ws(" ", "column", "comparator").alias("key"), F.col("numeric").alias("value"))


def exit_items(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("container") == "exit").select(
        "config_id", F.concat(F.lit("exit."), "key").alias("key"),
        F.concat_ws("/", F.col("use").cast("string"), F.coalesce("probability", F.lit(""))).alias("value"))


def date_audit(setups: DataFrame, ranges: DataFrame) -> DataFrame:
    """Length of the in-sample span, coverage and count of the out-of-sample ranges, one row per configuration."""
    span = setups.groupBy("config_id").agg(
        F.min_by("date_from", "setup_idx").alias("is_from"), F.min_by("date_to", "setup_idx").alias("is_to"))
    r = ranges.filter("date_from IS NOT NULL AND date_to IS NOT NULL")
    oos = r.groupBy("config_id").agg(
        F.sum(F.datediff("date_to", "date_from")).alias("oos_days"), F.count(F.lit(1)).alias("n_ranges"),
        F.min("date_from").alias("oos_from"), F.max("date_to").alias("oos_to"))
    j = span.join(oos, "config_id", "left").withColumn("is_days", F.datediff("is_to", "is_from"))
    years = F.col("is_days") / 365.25
    length = F.when(years < 3, F.lit("short")).when(years < 5, F.lit("acceptable")).otherwise(F.lit("good"))
    return j.select(
        "config_id", "is_days", F.round(years, 2).alias("is_years"), length.alias("is_length"),
        F.coalesce("n_ranges", F.lit(0).cast("bigint")).alias("n_ranges"), "oos_days",
        F.round(100 * F.col("oos_days") / F.nullif(F.col("is_days"), F.lit(0)), 1).alias("coverage_pct"),
        "is_from", "is_to", "oos_from", "oos_to")


def date_findings(setups: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rule violations of in-sample and out-of-sample dates: (config_id, code, severity, days)."""
    a = date_audit(setups, ranges)
    none = F.lit(None).cast("int")

    def hit(cond: Column, code: str, severity: str, days: Column = none) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), days.cast("int").alias("days")))

    one = F.col("n_ranges") == 1
    cover = F.col("oos_days") / F.nullif(F.col("is_days"), F.lit(0))
    whole = F.abs(F.datediff("oos_to", "oos_from") - F.col("is_days")) <= 30
    outside = (F.datediff("oos_from", "is_from") < -30) | (F.datediff("oos_to", "is_to") > 30)
    dated = F.col("is_days").isNotNull()
    config_level = a.select("config_id", F.explode(F.array_compact(F.array(
        hit(~dated, "in_sample_missing", "error"),
        hit(dated & (F.col("is_length") == "short"), "in_sample_short", "error", F.col("is_days")),
        hit(dated & (F.col("is_length") == "acceptable"), "in_sample_acceptable", "warning", F.col("is_days")),
        hit(dated & (F.col("is_length") == "good"), "in_sample_good", "info", F.col("is_days")),
        hit(dated & (F.col("n_ranges") == 0), "no_out_of_sample", "error"),
        hit(one & (cover < 0.3), "coverage_very_low", "error", F.col("oos_days")),
        hit(one & (cover >= 0.3) & (cover < 0.5), "coverage_moderate", "warning", F.col("oos_days")),
        hit(one & (cover >= 0.5), "coverage_good", "info", F.col("oos_days")),
        hit((F.col("n_ranges") > 0) & outside, "ranges_outside_in_sample", "error"),
        hit(one & whole, "single_range_covers_all", "warning"),
        hit(one & ~whole, "single_range_inside", "info"),
        hit(one, "single_range", "warning"),
        hit(F.col("n_ranges") > 1, "walk_forward_ranges", "info"),
        hit(F.col("n_ranges") >= 3, "many_ranges", "info"),
    ))).alias("f")).select("config_id", "f.*")
    r = ranges.filter("date_from IS NOT NULL AND date_to IS NOT NULL").join(a.select("config_id", "is_from", "is_to"), "config_id")
    early, late = F.datediff("is_from", "date_from"), F.datediff("date_to", "is_to")
    days = F.datediff("date_to", "date_from")
    # ranges of one configuration: a handful per key
    gap = F.datediff(F.lead("date_from").over(Window.partitionBy("config_id").orderBy("date_from", "range_idx")), "date_to")
    range_level = r.withColumn("_gap", gap).select("config_id", F.explode(F.array_compact(F.array(
        hit(early > 30, "range_starts_before", "error", early), hit(late > 30, "range_ends_after", "error", late),
        hit(F.col("_gap") > 30, "gap_between_ranges", "warning", F.col("_gap")),
        hit(days / 365.25 < 0.25, "range_very_short", "warning", days),
    ))).alias("f")).select("config_id", "f.*")
    broken = ranges.filter("date_from IS NULL OR date_to IS NULL").select(
        "config_id", F.lit("range_dates_invalid").alias("code"), F.lit("error").alias("severity"), none.alias("days"))
    return config_level.unionByName(range_level).unionByName(broken)


def option_findings(options: DataFrame) -> DataFrame:
    """Rule violations (warning) and notes (info) on trading options; absent options take their defaults."""
    def raw(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value")))

    flags = ("LimitTimeRange", "ExitOnFriday", "DontTradeOnWeekends", "RealisticGapsHandling", "ExitAtEndOfDay")
    numbers = ("SignalTimeRangeFrom", "SignalTimeRangeTo", "FridayExitTime", "MaxTradesPerDay", "MinimumSL", "MaximumSL",
               "MinimumPT", "MaximumPT", "PickerMaxOpenPositionsShort", "PickerMaxOpenPositionsLong")
    wide = options.groupBy("config_id").agg(
        *[F.coalesce(F.lower(raw(k)) == "true", F.lit(False)).alias(k) for k in flags],
        *[F.coalesce(raw(k).try_cast("double"), F.lit(0.0)).alias(k) for k in numbers],
        (F.coalesce(raw("Session"), F.lit("No Session")) == "No Session").alias("_no_session"))
    limited, hours = F.col("LimitTimeRange"), (F.col("SignalTimeRangeTo") - F.col("SignalTimeRangeFrom")) / 3600
    unlimited = reduce(lambda a, b: a & b, [F.col(k) == 0 for k in ("MinimumSL", "MaximumSL", "MinimumPT", "MaximumPT")])
    rules = {
        "time_range_short": limited & (hours < 4),
        "time_range_long": limited & (hours > 12),
        "time_range_ignored": ~limited & ((F.col("SignalTimeRangeFrom") != 0) | (F.col("SignalTimeRangeTo") != 0)),
        "friday_exit_late": F.col("ExitOnFriday") & (F.col("FridayExitTime") > 72000),
        "weekend_trading": ~F.col("DontTradeOnWeekends"),
        "trades_unlimited": F.col("MaxTradesPerDay") == 0,
        "trades_many": F.col("MaxTradesPerDay") > 10,
        "no_stop_target_limits": unlimited,
        "many_short_positions": F.col("PickerMaxOpenPositionsShort") > 5,
        "many_long_positions": F.col("PickerMaxOpenPositionsLong") > 5,
        "gaps_not_realistic": ~F.col("RealisticGapsHandling"),
    }
    start, end = F.col("SignalTimeRangeFrom"), F.col("SignalTimeRangeTo")
    notes = {
        "covers_london_open": limited & (start <= 28800) & (end >= 32400),
        "covers_new_york_open": limited & (start <= 46800) & (end >= 50400),
        "friday_exit_off": ~F.col("ExitOnFriday"),
        "end_of_day_exit_off": ~F.col("ExitAtEndOfDay"),
        "trades_all_day": ~limited & F.col("_no_session"),
    }

    def entry(code: str, severity: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    hits = F.array_compact(F.array(
        *[F.when(c, entry(n, "warning")) for n, c in rules.items()], *[F.when(c, entry(n, "info")) for n, c in notes.items()]))
    return wide.select("config_id", F.explode(hits).alias("f")).select("config_id", "f.*")


def plain_name(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"[\s._%#/]", "")


def ranking_thresholds(conditions: DataFrame) -> DataFrame:
    """Active numeric filters under their canonical metric names; the last one of a metric wins."""
    names = F.create_map(*[x for k, v in _CANONICAL.items() for x in (F.lit(k), F.lit(v))])
    value = F.col("numeric").try_cast("double")
    c = conditions.filter("use").withColumns({
        "metric": F.try_element_at(names, plain_name(F.col("column"))), "threshold": value,
        "comparator": F.coalesce("comparator", F.lit(">="))})
    kept = c.filter(F.col("metric").isNotNull() & F.col("comparator").isin(">=", "<=", ">", "<") & F.col("threshold").isNotNull())
    return kept.groupBy("config_id", "metric").agg(
        F.max_by("comparator", "condition_idx").alias("comparator"), F.max_by("threshold", "condition_idx").alias("threshold"))


def _by_project(tasks: DataFrame, databanks: DataFrame, ranges: DataFrame, options: DataFrame) -> DataFrame:
    """One row per project with its tasks in order; every task carries its databanks, ranges and window options.

    The four tables meet in one aggregate: a project has some tens of tasks, so a row is small.
    """
    kinds = {
        "task": (tasks, ("type", "name", "active", "template_file", "goto", "cross_check")), "bank": (databanks, ("role", "databank")),
        "range": (ranges, ("range_idx", "date_from", "date_to")),
        "option": (options.filter(F.col("key").isin("LimitTimeRange", "SignalTimeRangeFrom", "SignalTimeRangeTo")), ("key", "value")),
    }
    parts = []
    for kind, (df, fields) in kinds.items():
        empty = [F.lit(None).cast(T.StructType([other.schema[f] for f in names])).alias(k) for k, (other, names) in kinds.items() if k != kind]
        parts.append(df.select("project_id", "task_idx", F.struct(*fields).alias(kind), *empty).select("project_id", "task_idx", *kinds))
    rows = reduce(DataFrame.unionByName, parts)
    entries = rows.groupBy("project_id").agg(F.collect_list(F.struct("task_idx", *kinds)).alias("all"))

    def of(kind: str, task: Column) -> Column:
        return F.transform(F.filter("all", lambda x: (x["task_idx"] == task) & x[kind].isNotNull()), lambda x: x[kind])

    def whole(t: Column) -> Column:
        return F.struct(t["task_idx"].alias("idx"), *[t["task"][f].alias(f) for f in kinds["task"][1]],
                        *[of(k, t["task_idx"]).alias(f"{k}s") for k in ("bank", "range", "option")])

    ordered = F.array_sort(F.transform(F.filter("all", lambda x: x["task"].isNotNull()), lambda x: F.struct(x["task_idx"].alias("task_idx"), x["task"].alias("task"))))
    return entries.select("project_id", F.transform(ordered, whole).alias("tasks"))


def workflow_findings(tasks: DataFrame, databanks: DataFrame, ranges: DataFrame, options: DataFrame) -> DataFrame:
    """Rule violations of workflows: (project_id, task_idx, severity, code, n).

    ``n`` counts the offending partners (databanks, ranges, options) of a task.  One shuffle: the rules are expressions over a
    project's array of tasks.
    """
    projects = _by_project(tasks, databanks, ranges, options)
    every = F.col("tasks")
    active = F.filter(every, lambda t: F.coalesce(t["active"], F.lit(False)))
    one = F.lit(1).cast("bigint")

    def of_type(array: Column, kind: str) -> Column:
        return F.filter(array, lambda t: t["type"] == kind)

    def found(t: Column, severity: str, code: Column | str, n: Column = one) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        return F.struct(t["idx"].alias("task_idx"), F.lit(severity).alias("severity"), code.alias("code"), n.cast("bigint").alias("n"))

    def each(array: Column, severity: str, code: Column | str) -> Column:
        return F.transform(array, lambda t: found(t, severity, code))

    def counted(array: Column, severity: str, code: str, n) -> Column:
        return F.filter(F.transform(array, lambda t: found(t, severity, code, n(t))), lambda f: f["n"] > 0)

    # working arrays as columns: they are evaluated once
    projects = projects.select("project_id", every.alias("tasks"), active.alias("active")).withColumns({
        "builds": of_type(F.col("active"), "Build"), "retests": of_type(F.col("active"), "Retest"),
        "gotos": F.filter("tasks", lambda t: (t["type"] == "GoToTask") & (F.coalesce(t["goto"], F.lit("")) != "")),
        "clears": of_type(F.col("tasks"), "ClearDatabanks")})
    builds, retests, gotos = F.col("builds"), F.col("retests"), F.col("gotos")

    unfiltered = F.filter(retests, lambda r: r["cross_check"] & ~F.exists(
        F.col("active"), lambda t: (t["idx"] == r["idx"] + 1) & (t["type"] == "Filtering")))

    def target(t: Column) -> Column:
        """The first task of that name."""
        return F.get(F.filter("tasks", lambda o: o["name"] == t["goto"]), 0)

    missing = F.filter(gotos, lambda t: t["active"] & target(t).isNull())
    inactive = F.filter(gotos, lambda t: t["active"] & ~target(t)["active"])
    loops = F.when(F.exists(F.col("clears"), lambda t: t["active"]), F.filter(gotos, lambda t: F.lit(False))).otherwise(
        F.filter(gotos, lambda t: target(t)["type"] == "Build"))
    uncleared = F.when(F.size("clears") > 0, F.lit("clear_step_inactive")).otherwise(F.lit("clear_step_missing"))

    def banks(t: Column, role: str) -> Column:
        return F.transform(F.filter(t["banks"], lambda b: (b["role"] == role) & (F.coalesce(b["databank"], F.lit("")) != "")), lambda b: b["databank"])

    read = F.flatten(F.transform(retests, lambda r: banks(r, "input")))
    off = F.flatten(F.transform(builds, lambda b: F.transform(
        banks(b, "output"), lambda o: found(b, "info", "databank_mismatch", F.size(F.filter(read, lambda i: i != o))))))

    last, first = F.get(builds, F.size(builds) - 1), F.get(builds, F.lit(0))
    moved = F.when(F.size(builds) > 0, counted(retests, "info", "ranges_mismatch", lambda r: F.size(F.flatten(F.transform(
        r["ranges"], lambda x: F.filter(last["ranges"], lambda y: (y["range_idx"] == x["range_idx"]) & ~(
            x["date_from"].eqNullSafe(y["date_from"]) & x["date_to"].eqNullSafe(y["date_to"]))))))))
    shifted = F.when(F.size(builds) > 0, counted(retests, "warning", "window_mismatch", lambda r: F.size(F.flatten(F.transform(
        r["options"], lambda x: F.filter(first["options"], lambda y: (y["key"] == x["key"]) & (x["value"] != y["value"])))))))
    nothing = F.array().cast("array<struct<task_idx:{},severity:string,code:string,n:bigint>>".format(tasks.schema["task_idx"].dataType.simpleString()))
    rules = (
        each(unfiltered, "warning", "retest_without_filter"), each(missing, "error", "goto_missing"), each(inactive, "error", "goto_inactive"),
        each(loops, "warning", uncleared), F.filter(off, lambda f: f["n"] > 0), moved, shifted,
        each(F.filter(builds, lambda b: F.coalesce(b["template_file"], F.lit("")) == ""), "info", "template_missing"))
    return projects.select("project_id", F.explode(F.concat(*[F.coalesce(r, nothing) for r in rules])).alias("f")).select("project_id", "f.*")


def workflow_digest(tasks: DataFrame) -> DataFrame:
    """One row per project: task counts and the steps in order."""
    step = F.struct("task_idx", "type", "title", "active")
    return tasks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum(F.col("active").cast("bigint")).alias("n_active"),
        F.transform(F.array_sort(F.collect_list(step)), lambda s: F.concat_ws(
            ":", s["task_idx"].cast("string"), s["type"], s["title"], F.when(s["active"], F.lit("on")).otherwise(F.lit("off")))
        ).alias("steps"))


def enabled_checks(checks: DataFrame, ids: tuple[str, ...] = ("config_id",)) -> DataFrame:
    return checks.filter("use").groupBy(*ids).agg(F.array_sort(F.collect_list("check")).alias("checks"))


def enabled_types(blocks: DataFrame) -> DataFrame:
    """Active order and exit types per configuration, exits with their probability."""
    on = blocks.filter(F.col("use") & F.col("container").isin("order", "exit"))
    label = F.when(F.col("probability").isNotNull(), F.concat_ws("@", "key", "probability")).otherwise(F.col("key"))
    return on.groupBy("config_id", "container").agg(F.array_sort(F.collect_list(label)).alias("types"))


def name_suggestions(names: DataFrame, catalogue: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """Names missing from the catalogue, with the closest known name of their category.

    Similarity is 1 - edit distance / longer length, so only names whose lengths differ by at most
    (1 - cutoff) of the longer one can be close: those lengths are an equi-join key.  Known names travel
    as arrays of at most a few hundred, so no name pair becomes a row and a large category is
    spread over many arrays.  ``names`` and ``catalogue``: category, name.
    """
    known = catalogue.select("category", "name").distinct()
    unknown = names.select("category", "name").distinct().join(known, ["category", "name"], "left_anti")
    known = known.withColumn("_len", F.length("name"))
    sizes = known.groupBy("category", "_len").agg(F.ceil(F.count(F.lit(1)) / NAME_BUCKET).alias("_b"))
    arrays = known.join(sizes, ["category", "_len"]).groupBy("category", "_len", F.pmod(F.xxhash64("name"), "_b").alias("_bucket")).agg(
        F.collect_list("name").alias("_known"))
    # a hair wider than the cut-off, which is applied to the similarity itself below
    near = F.sequence(F.floor(F.length("name") * F.lit(cutoff) - 1e-9).cast("int"), F.ceil(F.length("name") / F.lit(cutoff) + 1e-9).cast("int"))
    unknown = unknown.withColumn("_len", F.explode(near))

    def score(k: Column) -> Column:
        longer = F.greatest(F.length(k), F.length("name"))
        return F.struct((1 - F.levenshtein(k, F.col("name")) / longer).alias("sim"), k.alias("to"))

    best = F.array_max(F.transform("_known", score))
    scored = unknown.join(arrays, ["category", "_len"], "left").select("category", "name", best.alias("_m"))
    top = scored.groupBy("category", "name").agg(F.max("_m").alias("_m"))
    close = F.col("_m.sim") >= cutoff
    return top.select("category", "name", F.when(close, F.col("_m.to")).alias("suggestion"),
                      F.when(close, F.col("_m.sim")).alias("similarity"))


def catalogue_listing(params: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block with its parameter signature and effective values.

    The effective value is the default, else the value list, else min..max unless
    the minimum is a sentinel.
    """
    span = F.when(~F.col("min").isin(*UNSET), F.concat(F.col("min"), F.lit(".."), F.coalesce("max", F.lit("?"))))
    value = F.coalesce("default", F.nullif(F.col("values"), F.lit("")), span)
    signature = F.concat(F.col("p_key"), F.lit(":"), F.coalesce("type", F.lit("")), F.lit("="), F.coalesce(value, F.lit("")))
    p = params.select("config_id", "container", "block_idx", "param_idx", F.col("key").alias("p_key"), "type", "min", "max", "values", "default")
    entry = F.when(F.col("p_key").isNotNull(), F.struct("param_idx", signature.alias("s")))
    return blocks.join(p, ["config_id", "container", "block_idx"], "left").groupBy("config_id", "container", "block_idx", "category", "key").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["s"]).alias("params"))
