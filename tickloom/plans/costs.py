"""Registered queries: cost audits over specifications, sessions and strategies derived from parts and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.columns import norm_symbol, number_of, once, text_of
from tickloom.operators import costs as ops
from tickloom.plans.common import r6, rnd, rounded, table
from tickloom.sources.broker import clean_sessions, clean_specs, one_spec_per_symbol

SUFFIX = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN 'c' ELSE '_exness' END"


def raw_specs(spark, sf):
    """Broker export lines (all text), one per part."""
    return table(spark, sf, "part").selectExpr(
        f"concat('P', p_partkey, {SUFFIX}) AS name",
        "CASE WHEN p_size = 49 THEN 'NO_EXISTE' ELSE p_name END AS description", "p_type AS path",
        "CASE WHEN p_size = 50 THEN '' ELSE cast(p_size % 6 AS string) END AS digits", "'0.01' AS point",
        "CASE WHEN p_size < 5 THEN '0' ELSE cast(p_size * 3 AS string) END AS spread", "'0' AS stops_level",
        "CASE WHEN p_size = 7 THEN '0' ELSE cast(p_retailprice / 1000 AS string) END AS tick_value", "'0.01' AS tick_size",
        "cast(p_size AS string) AS contract", "cast((p_retailprice - 1000) / 100 AS string) AS swap_long",
        "CASE WHEN p_size = 8 THEN 'n/a' ELSE cast((950 - p_retailprice) / 100 AS string) END AS swap_short",
    )


def specs(spark, sf):
    return one_spec_per_symbol(clean_specs(raw_specs(spark, sf)))


def registry(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "concat('P', p_partkey, '_exness') AS instrument", "CASE WHEN p_size = 9 THEN 0.02D ELSE 0.01D END AS tick_size",
        "cast(p_size % 6 + int(p_size = 10) AS double) AS decimals",
        "(p_retailprice - 1000) / 100 + (p_size % 3) * 0.4D AS swap_long",
        "CASE WHEN p_size = 8 THEN 0D ELSE (950 - p_retailprice) / 100 END AS swap_short",
        "p_retailprice / 10 * (1 + (p_size % 5) * 0.004D) AS point_value", "cast(10 + p_size AS double) AS spread",
        "CASE WHEN p_size % 2 = 0 THEN 'WEDNESDAY' END AS triple_day")
    gone = table(spark, sf, "supplier").selectExpr(
        "concat('X', s_suppkey, 'm') AS instrument", "0.01D AS tick_size", "2D AS decimals", "0D AS swap_long",
        "0D AS swap_short", "1D AS point_value", "5D AS spread", "'FRIDAY' AS triple_day")
    return parts.unionByName(gone)


def strategies(spark, sf):
    """Round trips per part: count, mean nights, gross profit."""
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey")).alias("symbol")).agg(
        F.count(F.lit(1)).alias("n_trades"), (F.avg("l_quantity") / 10).alias("avg_nights"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("gross_profit"),
        F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"),
        F.min("l_discount").alias("min_d"), F.max("l_discount").alias("max_d"))


def targets(spark, sf):
    return strategies(spark, sf).select("symbol", (F.col("min_q") * 30).alias("min_target"))


def ratios(spark, sf):
    return strategies(spark, sf).select(
        "symbol", (F.col("min_d") * 1000 + 20).alias("rrr_from"), (F.col("max_d") * 1000 + 40).alias("rrr_to"))


def stress(spark, sf):
    s = strategies(spark, sf).select("symbol", (F.col("max_q") * 2).alias("stress_max"))
    other = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), (F.col("s_acctbal") / 100).alias("stress_max"))
    return s.unionByName(other)


def sessions(spark, sf):
    to = F.col("l_linenumber") * 2 + F.floor(F.col("l_quantity") / 3)
    hour = F.lpad(F.when(to >= 24, 0).otherwise(to).cast("string"), 2, "0")
    raw = once(
        table(spark, sf, "lineitem"), F.concat(F.lit("P"), F.col("l_partkey")).alias("symbol"), F.date_format("l_shipdate", "E").alias("day"),
        F.format_string("%02d:30", (F.col("l_linenumber") * 2).cast("int")).alias("session_from"),
        F.concat(hour, F.when(to >= 24, F.lit(":00")).otherwise(F.lit(":45"))).alias("session_to"))
    return clean_sessions(raw)


def windows(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('P', p_partkey) AS symbol",
        "CASE WHEN p_size < 20 THEN 900 + p_size ELSE 28800 + p_size * 60 END AS window_from",
        "CASE WHEN p_size < 20 THEN 1130 ELSE 36000 + p_size * 60 END AS window_to")


def exits(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "concat('P', p_partkey) AS symbol", "CASE WHEN p_size > 25 THEN p_size END AS max_exit_bars")


def broker_specs(spark, sf):
    return rounded(specs(spark, sf))


def tolerant_numbers(spark, sf):
    """Order totals and customer fields written the way exports write them, parsed back."""
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).when(
        F.col("o_orderstatus") == "O", F.concat(F.col("o_orderkey").cast("string"), F.lit(" %"))).when(
        F.col("o_orderpriority") == "5-LOW", F.lit("N/A")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", number_of(raw).alias("number"), text_of(raw).alias("text"))


def symbol_names(spark, sf):
    s = table(spark, sf, "part").selectExpr(f"concat(p_name, {SUFFIX}, {SUFFIX}) AS name")
    return s.select("name", norm_symbol("name").alias("symbol")).groupBy("name", "symbol").agg(F.count(F.lit(1)).alias("n"))


def swap_costs(spark, sf):
    s = specs(spark, sf).withColumn("price", F.col("contract") * 20)
    c = ops.swap_costs(s, "short", lots=2.0)
    return rounded(c.select("symbol", "point_value", "swap_per_night", "notional", "pct_night", "pct_year", "mode"), 10)


def swap_drag(spark, sf):
    c = ops.swap_costs(specs(spark, sf).withColumn("price", F.col("contract") * 20), "long")
    j = strategies(spark, sf).join(c.select("symbol", "swap_per_night"), "symbol")
    return ops.with_swap_drag(j).select(
        "symbol", "n_trades", r6("total_swap", 9).alias("total_swap"), r6("gross_profit", 4).alias("gross_profit"),
        r6("swap_share_pct", 6).alias("swap_share_pct"))


def swap_audit(spark, sf):
    req = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey") + F.col("l_linenumber") * 300, F.lit("m_exness")).alias("requested")).distinct()
    costs = ops.swap_costs(specs(spark, sf).withColumn("price", F.col("contract") * 20))
    return rounded(ops.swap_audit(req, costs), 10)


def target_vs_spread(spark, sf):
    return rounded(ops.check_target_vs_spread(targets(spark, sf), specs(spark, sf)))


def session_windows(spark, sf):
    return ops.check_window_in_session(windows(spark, sf), sessions(spark, sf))


def uncovered_days(spark, sf):
    return ops.uncovered_days(windows(spark, sf), sessions(spark, sf))


def break_even(spark, sf):
    return rounded(ops.break_even(ratios(spark, sf), specs(spark, sf)))


def swap_direction(spark, sf):
    return rounded(ops.check_swap_direction(specs(spark, sf), "both"))


def findings_by_severity(spark, sf):
    sp = specs(spark, sf)
    return ops.severity_counts(ops.all_findings(
        ops.check_target_vs_spread(targets(spark, sf), sp), ops.check_window_in_session(windows(spark, sf), sessions(spark, sf)),
        ops.check_swap_direction(sp, "short"), ops.notice_break_even(ratios(spark, sf), sp),
        ops.notice_time_stop(exits(spark, sf)), ops.check_stress_spread(stress(spark, sf), sp)))


def registry_differences(spark, sf):
    return rounded(ops.registry_differences(registry(spark, sf), specs(spark, sf)))


def registry_fill(spark, sf):
    return rounded(ops.fill_from_registry(specs(spark, sf), registry(spark, sf)))


def _requests(spark, sf):
    ending = F.when(F.col("l_returnflag") == "A", F.lit("m")).when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.lit("_exness"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey") + F.col("l_linenumber") * 100, ending).alias("requested")).distinct()


def symbol_resolution(spark, sf):
    return ops.resolve_symbols(_requests(spark, sf), clean_specs(raw_specs(spark, sf)))


def detected_suffix(spark, sf):
    return ops.detected_suffix(symbol_resolution(spark, sf))


_SPEC = f"""sp AS (SELECT 'P' || p_partkey AS symbol, 'P' || p_partkey || {SUFFIX} AS name, p_name AS description, p_type AS path,
  p_size % 6 AS digits, 0.01::DOUBLE AS point, CASE WHEN p_size < 5 THEN 0 ELSE p_size * 3 END AS spread, 0 AS stops_level,
  CASE WHEN p_size = 7 THEN 0 ELSE p_retailprice / 1000 END AS tick_value, 0.01::DOUBLE AS tick_size, p_size::DOUBLE AS contract,
  (p_retailprice - 1000) / 100 AS swap_long, CASE WHEN p_size = 8 THEN 0 ELSE (950 - p_retailprice) / 100 END AS swap_short
  FROM part WHERE p_size NOT IN (49, 50))"""
_COST = f"""{_SPEC},
pv AS (SELECT *, CASE WHEN tick_size > 0 AND tick_value <> 0 THEN tick_value * (point / tick_size) ELSE 0 END AS pv, contract * 20 AS price FROM sp)"""
_STRAT = """st AS (SELECT 'P' || l_partkey AS symbol, count(*) AS n_trades, avg(l_quantity) / 10 AS avg_nights,
  sum(l_extendedprice * l_discount) AS gross_profit, min(l_quantity) AS min_q, max(l_quantity) AS max_q,
  min(l_discount) AS min_d, max(l_discount) AS max_d FROM lineitem GROUP BY 1)"""
_REG = """reg AS (SELECT 'P' || p_partkey AS symbol, 'P' || p_partkey || '_exness' AS instrument,
    CASE WHEN p_size = 9 THEN 0.02 ELSE 0.01 END::DOUBLE AS tick_size, (p_size % 6 + (p_size = 10)::INT)::DOUBLE AS decimals,
    (p_retailprice - 1000) / 100 + (p_size % 3) * 0.4::DOUBLE AS swap_long,
    CASE WHEN p_size = 8 THEN 0 ELSE (950 - p_retailprice) / 100 END AS swap_short,
    p_retailprice / 10 * (1 + (p_size % 5) * 0.004::DOUBLE) AS point_value, (10 + p_size)::DOUBLE AS spread,
    CASE WHEN p_size % 2 = 0 THEN 'WEDNESDAY' END AS triple_day FROM part
  UNION ALL SELECT 'X' || s_suppkey, 'X' || s_suppkey || 'm', 0.01, 2, 0, 0, 1, 5, 'FRIDAY' FROM supplier)"""
_TARGET = """f1 AS (SELECT 'target_vs_spread' AS "check", CASE WHEN spread <= 0 THEN 'info' WHEN min_q * 30 / spread < 1.2 THEN 'error'
    WHEN min_q * 30 / spread < 1.5 THEN 'warning' ELSE 'ok' END AS severity, st.symbol, min_q * 30 AS value, spread::DOUBLE AS "limit"
  FROM st JOIN sp ON sp.symbol = st.symbol)"""
_SESS = """ses AS (SELECT 'P' || l_partkey AS symbol, strftime(l_shipdate, '%a') AS day, l_linenumber * 120 + 30 AS a,
    CASE WHEN l_linenumber * 2 + floor(l_quantity / 3) >= 24 THEN 1440 ELSE (l_linenumber * 2 + floor(l_quantity / 3)) * 60 + 45 END AS z FROM lineitem),
wi AS (SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size < 20 THEN 540 + p_size ELSE 480 + p_size END AS a,
    CASE WHEN p_size < 20 THEN 690 ELSE 600 + p_size END AS b FROM part WHERE 'P' || p_partkey IN (SELECT symbol FROM ses)),
un AS (SELECT wi.symbol, wi.a, wi.b, d.day FROM wi, (SELECT unnest(['Mon', 'Tue', 'Wed', 'Thu', 'Fri']) AS day) d
  WHERE NOT EXISTS (SELECT 1 FROM ses WHERE ses.symbol = wi.symbol AND ses.day = d.day AND ses.a <= wi.a AND wi.b <= ses.z)),
f2 AS (SELECT 'window_in_session' AS "check", CASE WHEN count(un.day) > 0 THEN 'error' ELSE 'ok' END AS severity, wi.symbol,
    count(un.day)::DOUBLE AS value, 0::DOUBLE AS "limit" FROM wi LEFT JOIN un ON un.symbol = wi.symbol GROUP BY wi.symbol)"""
_STRESS = """strs AS (SELECT symbol, max_q * 2 AS stress_max FROM st UNION ALL SELECT 'S' || s_suppkey, s_acctbal / 100 FROM supplier),
f6 AS (SELECT 'stress_spread' AS "check", CASE WHEN live = 0 THEN 'info' WHEN stress_max < live THEN 'error' ELSE 'ok' END AS severity,
    symbol, live::DOUBLE AS value, stress_max AS "limit", CASE WHEN live <> 0 AND stress_max < live THEN live / greatest(stress_max, 1e-9) END AS factor
  FROM (SELECT strs.symbol, stress_max, coalesce(nullif(spread, 0), (SELECT arg_min(spread, symbol) FROM sp WHERE spread > 0), 0) AS live
        FROM strs LEFT JOIN sp ON sp.symbol = strs.symbol))"""
_SWAPDIR = """SELECT 'swap_{0}' AS "check", CASE WHEN swap_{0} < 0 THEN 'warning' ELSE 'ok' END AS severity, symbol,
  round(swap_{0}, 6) + 0.0 AS value, 0::DOUBLE AS "limit" FROM sp"""
_BREAK = """be AS (SELECT st.symbol, min_d * 1000 + 20 AS rrr_from, max_d * 1000 + 40 AS rrr_to, spread FROM st JOIN sp ON sp.symbol = st.symbol WHERE spread > 0)"""
_RESOLVE = f"""nm AS (SELECT 'P' || p_partkey || {SUFFIX} AS name FROM part WHERE p_size NOT IN (49, 50)),
rq AS (SELECT DISTINCT 'P' || (l_partkey + l_linenumber * 100) AS base, 'P' || (l_partkey + l_linenumber * 100)
  || CASE l_returnflag WHEN 'A' THEN 'm' WHEN 'N' THEN '' ELSE '_exness' END AS requested FROM lineitem),
cd AS (SELECT requested, base, unnest([requested, base || '_exness', base || 'm', base || 'c', base]) AS name, unnest([0, 1, 2, 3, 4]) AS p FROM rq),
ht AS (SELECT requested, arg_min(cd.name, p) AS resolved FROM cd JOIN nm ON nm.name = cd.name GROUP BY 1),
rs AS (SELECT rq.requested, coalesce(resolved, rq.requested) AS resolved, resolved IS NOT NULL AS "exists",
  CASE WHEN resolved IS NULL THEN '' ELSE substr(resolved, length(base) + 1) END AS suffix FROM rq LEFT JOIN ht ON ht.requested = rq.requested)"""

STRESS_SQL = f"""WITH {_SPEC}, {_STRAT}, {_STRESS}
SELECT * REPLACE ({rnd('value')} AS value, {rnd('"limit"')} AS "limit", {rnd('factor')} AS factor) FROM f6"""

QUERIES = {
    "broker_specs": (broker_specs, f"""WITH {_SPEC}
SELECT symbol, name, description, path, digits, point, spread, stops_level, {rnd('tick_value')} AS tick_value, tick_size, contract,
  {rnd('swap_long')} AS swap_long, {rnd('swap_short')} AS swap_short FROM sp"""),
    "tolerant_numbers": (tolerant_numbers, """SELECT o_orderkey,
  CASE o_orderstatus WHEN 'F' THEN round(o_totalprice, 2) WHEN 'O' THEN o_orderkey::DOUBLE END AS number,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderpriority <> '5-LOW' THEN o_orderpriority END AS text FROM orders"""),
    "symbol_names": (symbol_names, f"""SELECT p_name || {SUFFIX} || {SUFFIX} AS name,
  regexp_replace(p_name || {SUFFIX} || {SUFFIX}, '(_exness|[mc])+$', '') AS symbol, count(*) AS n FROM part GROUP BY 1, 2"""),
    "swap_costs": (swap_costs, f"""WITH {_COST}
SELECT symbol, {rnd('pv', 10)} AS point_value, {rnd('swap_short * pv * 2', 10)} AS swap_per_night, {rnd('price * contract * 2', 10)} AS notional,
  {rnd('swap_short * pv * 2 / (price * contract * 2) * 100', 10)} AS pct_night, {rnd('swap_short * pv * 2 / (price * contract * 2) * 100 * 360', 10)} AS pct_year,
  CASE WHEN pv = 0 THEN 'unknown' ELSE 'points' END AS mode FROM pv"""),
    "swap_drag": (swap_drag, f"""WITH {_COST}, {_STRAT}
SELECT st.symbol, n_trades, {rnd('swap_long * pv * avg_nights * n_trades', 9)} AS total_swap, {rnd('gross_profit', 4)} AS gross_profit,
  {rnd('coalesce(abs(100 * swap_long * pv * avg_nights * n_trades / nullif(gross_profit, 0)), 0)', 6)} AS swap_share_pct
FROM st JOIN pv ON pv.symbol = st.symbol"""),
    "swap_audit": (swap_audit, f"""WITH {_COST},
rq AS (SELECT DISTINCT 'P' || (l_partkey + l_linenumber * 300) AS symbol FROM lineitem)
SELECT rq.symbol || 'm_exness' AS requested, rq.symbol, {rnd('swap_short * pv', 10)} AS swap_per_night,
  {rnd('swap_short * pv / (price * contract) * 100 * 360', 10)} AS pct_year, {rnd('price * contract', 10)} AS notional, {rnd('pv', 10)} AS point_value,
  CASE WHEN pv.symbol IS NULL THEN NULL WHEN pv = 0 THEN 'unknown' ELSE 'points' END AS mode,
  CASE WHEN pv.symbol IS NULL THEN 'error' ELSE 'ok' END AS severity FROM rq LEFT JOIN pv ON pv.symbol = rq.symbol"""),
    "target_vs_spread": (target_vs_spread, f"WITH {_SPEC}, {_STRAT}, {_TARGET} SELECT * FROM f1"),
    "session_windows": (session_windows, f"WITH {_SESS} SELECT * FROM f2"),
    "uncovered_days": (uncovered_days, f"WITH {_SESS} SELECT symbol, a, b, day FROM un"),
    "break_even": (break_even, f"""WITH {_SPEC}, {_STRAT}, {_BREAK}
SELECT symbol, {rnd('rrr_from')} AS rrr_from, {rnd('rrr_to')} AS rrr_to, spread, {rnd('1 / (1 + rrr_to / 100)')} AS best_rate,
  {rnd('1 / (1 + rrr_from / 100)')} AS worst_rate, {rnd('spread / greatest(rrr_to, 1e-9)')} AS spread_extra FROM be"""),
    "swap_direction": (swap_direction, f"WITH {_SPEC} {_SWAPDIR.format('long')} UNION ALL {_SWAPDIR.format('short')}"),
    "findings_by_severity": (findings_by_severity, f"""WITH {_SPEC}, {_STRAT}, {_TARGET}, {_SESS}, {_BREAK}, {_STRESS},
af AS (SELECT severity FROM f1 UNION ALL SELECT severity FROM f2 UNION ALL SELECT severity FROM ({_SWAPDIR.format('short')})
  UNION ALL SELECT 'info' FROM be UNION ALL SELECT 'info' FROM part WHERE p_size > 25 UNION ALL SELECT severity FROM f6)
SELECT severity, count(*) AS n FROM af GROUP BY 1"""),
    "registry_differences": (registry_differences, f"""WITH {_SPEC}, {_REG},
j AS (SELECT reg.*, sp.symbol IS NULL AS gone, sp.point AS lp, sp.digits AS ld, sp.swap_long AS ll, sp.swap_short AS ls,
  CASE WHEN sp.tick_value <> 0 THEN sp.tick_value / sp.tick_size END AS lpv FROM reg LEFT JOIN sp ON sp.symbol = reg.symbol)
SELECT instrument, 'existence' AS field, NULL::DOUBLE AS registry, NULL::DOUBLE AS live FROM j WHERE gone
UNION ALL SELECT instrument, 'tick_size', {rnd('tick_size')}, {rnd('lp')} FROM j WHERE abs(tick_size - lp) > 1e-9
UNION ALL SELECT instrument, 'decimals', decimals, ld FROM j WHERE decimals <> ld
UNION ALL SELECT instrument, 'swap_long', {rnd('swap_long')}, {rnd('ll')} FROM j WHERE abs(swap_long - ll) > 0.51
UNION ALL SELECT instrument, 'swap_short', {rnd('swap_short')}, {rnd('ls')} FROM j WHERE abs(swap_short - ls) > 0.51
UNION ALL SELECT instrument, 'point_value', {rnd('point_value')}, round(lpv, 4) FROM j WHERE abs(point_value - lpv) / greatest(lpv, 1e-9) > 0.01"""),
    "registry_fill": (registry_fill, f"""WITH {_SPEC}, {_REG}
SELECT sp.symbol, name, coalesce(nullif(sp.spread, 0)::DOUBLE, reg.spread, 0) AS spread,
  {rnd('coalesce(CASE WHEN sp.tick_value <> 0 THEN sp.tick_value / sp.tick_size END, point_value, 0)')} AS point_value,
  coalesce(triple_day, 'FRIDAY') AS triple_day FROM sp LEFT JOIN reg ON reg.symbol = sp.symbol"""),
    "symbol_resolution": (symbol_resolution, f"WITH {_RESOLVE} SELECT * FROM rs"),
    "detected_suffix": (detected_suffix, f"""WITH {_RESOLVE}
SELECT coalesce(max(CASE WHEN suffix = '_exness' THEN suffix END), arg_min(suffix, requested) FILTER (suffix <> ''), '') AS suffix FROM rs"""),
}
