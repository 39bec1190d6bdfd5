"""Registered queries: documents and files derived from the test tables, read back through the readers.

Section documents hold one configuration per supplier, audit documents one per part; methods and limits come from the lines.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import norm_symbol
from tickloom.operators import costs
from tickloom.operators.blocks import spread
from tickloom.plans import costs as cost_plans
from tickloom.plans.common import rounded, table, work_folder
from tickloom.session import materialise
from tickloom.sources import archives as ar, bars as bar_files, broker, elements as el

#: One row per supplier and return flag, in both dialects.
METHODS = """SELECT l_suppkey AS config_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, count(*) AS n,
  max(l_linenumber) AS k, avg(l_tax) > 0.04 AS on_ FROM {lineitem} GROUP BY l_suppkey, l_returnflag"""


def tag(name: str, attributes: dict[str, Column | str], *body: Column) -> Column:
    """An element as text; values are given escaped."""
    shown = [F.concat(F.lit(f' {k}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"')) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *shown, F.lit(">"), *body, F.lit(f"</{name}>"))


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def section_documents(spark, sf) -> DataFrame:
    """(config_id, xml): a builder document per supplier with all sections besides the blocks, and one that no table knows."""
    m = spark.sql(METHODS, lineitem=table(spark, sf, "lineitem"))
    method = tag("Method", {"type": F.concat(F.lit("M"), _text("flag")), "use": _text("on_")},
                 tag("Params", {}, tag("Param", {"key": "Size", "name": "Lots"}, _text("n"))), tag("Parameter", {"key": "Risk"}, _text("k")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flag", method.alias("x")))), lambda s: s["x"]), "\n")
    s = table(spark, sf, "supplier").join(m.groupBy(F.col("config_id").alias("s_suppkey")).agg(listed.alias("methods")), "s_suppkey", "left")
    key, odd = _text("s_suppkey"), _text(F.col("s_suppkey") % 2 == 1)
    banks = F.concat(*[tag("Databank", {"label": f"L{k}", "name": n, "value": F.concat(F.lit(f"D{k}-"), key)}) for k, n in enumerate(("Input", "Output"))])
    settings = tag(
        "Settings", {},
        tag("WhatToBuild", {}, tag("BuildMode", {"generationType": F.when(F.col("s_suppkey") % 3 == 0, "random").otherwise("genetic")},
                                   tag("PopulationSize", {}, key), tag("EvoRestartOnStagnation", {"status": odd, "generations": key}))),
        tag("RiskMoneyManagement", {}, tag("MoneyManagement", {}, F.coalesce("methods", F.lit("")), tag("InitialCapital", {}, _text(F.col("s_nationkey") * 1000))),
            tag("RiskManagement", {"maxDrawdown": _text(F.col("s_suppkey") % 30)}, tag("Method", {"type": "Stop", "use": odd}))),
        tag("Rankings", {"type": "x"}, tag("FitnessCriteria", {"method": F.concat(F.lit("F"), _text(F.col("s_suppkey") % 3)), "useFitnessByIndex": odd},
                                          tag("Settings", {}, tag("Ranking", {"type": "first"}), tag("Ranking", {"type": key})))),
        tag("PartsToImprove", {"improveATM": "false"}, tag("ExitRules", {"symmetry": odd}, tag("LongImprovement", {"use": odd, "action": "add"}),
                                                           tag("ShortImprovement", {"use": "true", "action": "replace"}))),
        tag("ATMs", {"enable": odd}, tag("GenerateConfig", {}, tag("Types", {}, tag("Fixed", {"min": key, "max": "9"})))),
        tag("Notes", {}, F.concat(F.lit("\n  made by &lt;"), F.col("s_name"), F.lit("&gt; &amp; co "))),
        tag("Databanks", {"retestSelected": odd}, banks),
        tag("Resources", {}, tag("Symbols", {}, tag("Symbol", {"name": F.concat(F.lit("S"), key)}, tag("InstrumentInfo", {"tickSize": "0.01"}))),
            tag("Brokers", {}, tag("Broker", {"id": key, "timezone": "UTC"}))),
        tag("CrossChecks", {"use": "true"}, tag("WhatIf", {"use": odd}, tag("Settings", {}, tag("Days", {"mode": "skip"}, _text(F.col("s_suppkey") % 5))))),
        tag("Extras", {"mode": key}, F.lit("before"), tag("Item", {}, key), F.lit("between"), tag("Item", {"n": "2"}), F.lit("after")),
    )
    xml = F.concat(F.lit('<?xml version="1.0" encoding="utf-16"?><!-- made -->'), tag("Task", {"type": "Build", "version": "1"}, settings))
    return s.select(F.col("s_suppkey").alias("config_id"), xml.alias("xml"))


def section_elements(spark, sf) -> DataFrame:
    """Stored elements of the section documents: several tables are read from them."""
    return materialise(el.element_table(spread(section_documents(spark, sf), "config_id")))


def element_census(spark, sf):
    """Elements, attributes and text of every document, by place: nothing is lost."""
    return el.census(section_elements(spark, sf)).select(
        "config_id", F.coalesce("place", F.lit("")).alias("place"), "tag", "n", "n_attributes", "n_chars")


def ingest_sections(spark, sf):
    """All typed section tables of all documents, as (section, key, value) rows."""
    e = section_elements(spark, sf)

    def rows(section: str, df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
        return df.select("config_id", F.lit(section).alias("section"), _text(key).alias("key"), _text(value).alias("value"))

    def joined(*columns: str) -> Column:
        return F.concat_ws("/", *[_text(c) for c in columns])

    parts = [
        rows("money", el.money_methods(e), joined("method_idx", "key", "name"), joined("type", "use", "value", "inferred_type")),
        rows("risk", el.risk_settings(e), "key", "value"), rows("build_mode", el.build_mode(e), "key", "value"),
        rows("improve", el.parts_to_improve(e), joined("part", "side"), joined("symmetry", "use", "action")),
        rows("management", el.trade_management(e), "key", "value"), rows("notes", el.notes(e), F.lit(""), "notes"),
        rows("databank", el.databanks(e), joined("databank_idx", "label", "name"), joined("value", "retest_selected")),
        rows("resource", el.resources(e), joined("kind", "resource_idx", "attribute"), "value"),
        rows("fitness", el.fitness(e), F.lit(""), joined("method", "use_by_index", "type")),
        rows("check", el.check_settings(e), joined("check", "part", "place", "key"), "value"),
        rows("raw", el.raw_sections(e), joined("section", "place"), F.concat_ws("|", F.to_json("attributes"), "text", "tail")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def zip_ingest(spark, sf):
    """Section documents packed into archives, some of them damaged, and unpacked by the archive reader."""
    docs = section_documents(spark, sf).select(F.format_string("c%08d.cfx", F.col("config_id").cast("long")).alias("path"), F.col("config_id"), "xml")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, number, xml in zip(batch["path"], batch["config_id"], batch["xml"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("readme.txt" if number % 7 == 3 else "config.xml", xml.encode("utf-16"))
                made.append((path, held.getvalue()[: 20 if number % 7 == 5 else None]))
            yield pd.DataFrame(made, columns=["path", "content"])

    members = materialise(ar.unpacked(docs.mapInPandas(pack, "path string, content binary")))
    kinds = ar.archive_kinds(members)
    e = el.element_table(members.select("path", "xml"), ids=("path",))
    counts = e.groupBy("path").agg(F.count(F.lit(1)).alias("n_elements"), F.max(F.when(F.col("place") == "Notes", el.text())).alias("notes"))
    return kinds.join(counts, "path", "left").select("path", "kind", "type", "error", F.coalesce("n_elements", F.lit(0)).alias("n_elements"), "notes")


def workflow_ingest(spark, sf):
    """A workflow archive per order, with a document for every line's task, read back by the project reader."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), _text("l_orderkey")).alias("path"), F.col("l_linenumber").cast("int").alias("k"), "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    name = F.concat(F.lit("t"), _text("k"))
    kind = F.when(F.col("l_suppkey") % 3 == 0, "Build").when(F.col("l_suppkey") % 3 == 1, "Retest").otherwise("GoToTask")
    body = F.concat(
        tag("Databanks", {}, tag("Databank", {"name": "Input", "value": F.concat(F.lit("D"), _text(F.col("l_partkey") % 3))})),
        tag("CrossChecks", {}, tag("WhatIf", {"use": _text(F.col("l_quantity") > 25)})),
        F.when(kind == "GoToTask", tag("GoToTask", {"task": "t1"})).otherwise(F.lit("")))
    settings = tag("Settings", {}, body)
    task = tag("Task", {"type": kind, "name": name, "active": _text(F.col("l_discount") > 0.02), "taskXMLFile": F.concat(name, F.lit(".xml"))})
    # equal line numbers of an order are one task: the first by its other fields
    one = lines.groupBy("path", "k").agg(F.min(F.struct("l_suppkey", "l_partkey", "l_quantity", "l_discount")).alias("l")).select("path", "k", "l.*")
    docs = one.select("path", F.concat(name, F.lit(".xml")).alias("member"), F.when(F.col("k") % 2 == 0, settings).otherwise(tag("T", {}, settings)).alias("xml"),
                      F.struct("k", task.alias("x")).alias("t"))
    manifest = docs.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]), "").alias("x")).select(
        "path", F.lit("config.xml").alias("member"), tag("Project", {"name": "p", "version": "1"}, tag("Tasks", {}, F.col("x"))).alias("xml"))
    members = materialise(docs.select("path", "member", "xml").unionByName(manifest))
    made = ar.project_tables(members)
    banks = made["task_databank"].select("project_id", "task_idx", F.concat_ws("=", "role", "databank").alias("databank")).hint("merge")
    return made["task"].join(banks, ["project_id", "task_idx"], "left").select(
        "project_id", F.col("task_idx").cast("int").alias("task_idx"), "type", "name", "title", "active", "goto", "cross_check", "databank")


def _audit_documents(spark, sf) -> DataFrame:
    """(doc_id, xml): a retest document per part and supplier with its chart, stress test and time stop."""
    limit = cost_plans.stress(spark, sf).join(cost_plans.exits(spark, sf), "symbol", "left")
    number = F.xxhash64("symbol") % 3

    def method(kind: str, use: str, low: str, high: Column) -> Column:
        return tag("Method", {"type": kind, "use": use}, tag("Params", {}, tag("Param", {"key": "Min"}, F.lit(low)), tag("Param", {"key": "Max"}, high)))

    real, unused = method("RandomizeSpread", "true", "0.5", _text("stress_max")), method("RandomizeSpread", "false", "1", F.lit("999999"))
    test = tag("MonteCarloRetest", {"use": "true"}, tag("Settings", {}, tag("Methods", {}, unused, method("RandomizeSlippage", "true", "1", F.lit("5")), real)))
    off = tag("MonteCarloRetest", {"use": "false"}, tag("Settings", {}, method("RandomizeSpread", "true", "1", F.lit("888888"))))
    stop = F.when(F.col("max_exit_bars").isNotNull(), tag("Param", {
        "key": "#ExitAfterBars.ExitAfterBars#", "minValue": "1", "maxValue": _text("max_exit_bars")})).otherwise(F.lit(""))
    blocks = tag("Blocks", {}, tag("ExitTypes", {}, tag("Block", {"key": "ExitAfterBars"}, tag("Generated", {}, stop))))
    xml = tag("Task", {"type": "Retester"}, tag(
        "Settings", {}, tag("Data", {}, tag("Setups", {}, tag("Setup", {}, tag("Chart", {"symbol": F.concat("symbol", F.lit("m_exness"))}), tag("Chart", {"symbol": "other"})))),
        tag("CrossChecks", {"use": "true"}, F.when(number == 0, off).otherwise(F.lit("")), test), blocks))
    return limit.select(F.col("symbol").alias("doc_id"), xml.alias("xml"))


def audit_elements(spark, sf) -> DataFrame:
    return materialise(el.element_table(_audit_documents(spark, sf), ids=("doc_id",)))


def document_limits(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Stress ranges and time stops of the audit documents, by normalised chart symbol."""
    e = audit_elements(spark, sf)
    symbol = el.chart_symbols(e).select("doc_id", norm_symbol("symbol").alias("symbol"))
    return el.stress_ranges(e).join(symbol, "doc_id"), el.exit_bars(e).join(symbol, "doc_id")


def stress_spread(spark, sf):
    """Stress-test spreads that documents set, against the live ones."""
    stress, _ = document_limits(spark, sf)
    return rounded(costs.check_stress_spread(stress, cost_plans.specs(spark, sf)))


def time_stops(spark, sf):
    """Time stops that documents set, against the next close after the entry window."""
    _, stops = document_limits(spark, sf)
    return costs.notice_time_stop(stops, cost_plans.windows(spark, sf), cost_plans.sessions(spark, sf))


def session_reach(spark, sf):
    """Bars that are left before the next close, by symbol and weekday."""
    return costs.time_stop_reach(cost_plans.windows(spark, sf), cost_plans.sessions(spark, sf))


def spec_file(spark, sf):
    """Broker specifications written as the broker exports them and scanned."""
    path = f"{work_folder(spark)}/specs"
    cost_plans.raw_specs(spark, sf).write.option("header", True).option("sep", ";").option("emptyValue", "").csv(path)
    return rounded(broker.one_spec_per_symbol(broker.read_specs(spark, path)))


def session_file(spark, sf):
    """Sessions written as the broker exports them and scanned."""
    path = f"{work_folder(spark)}/sessions"
    li = table(spark, sf, "lineitem")
    gone = F.col("l_linenumber") == 7
    raw = li.select(
        F.concat(F.lit("P"), _text("l_partkey")).alias("symbol"), F.when(gone, "NO_EXISTE").otherwise(F.date_format("l_shipdate", "E")).alias("day"),
        F.when(F.col("l_linenumber") == 6, "").otherwise(F.format_string("%02d:30", (F.col("l_linenumber") * 2).cast("int"))).alias("session_from"),
        F.when(F.col("l_quantity") > 40, "00:00").otherwise("23:45").alias("session_to"))
    raw.write.option("header", True).option("sep", ";").csv(path)
    return broker.read_sessions(spark, path).groupBy("symbol", "day", "from_min", "to_min").agg(F.count(F.lit(1)).alias("n"))


def trade_series_file(spark, sf):
    """Order totals written as a trade report of several files, read back in the order of files and lines."""
    path = f"{work_folder(spark)}/trades"
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.concat(F.lit("$"), _text("o_totalprice"))).alias("My Profit"))
    o.repartitionByRange(4, "id").sortWithinPartitions("id").write.option("header", True).option("sep", ";").csv(path)
    return bar_files.read_trade_numbers(spark, path)


def result_sinks(spark, sf):
    """A result written in every format of the sink and read back."""
    path, out = work_folder(spark), None
    result = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    for fmt in ("json", "csv", "parquet"):
        bar_files.write_report(result, f"{path}/{fmt}", fmt)
        read = spark.read.schema("k long, n_name string").option("header", True).format(fmt).load(f"{path}/{fmt}").select(F.lit(fmt).alias("fmt"), "k", "n_name")
        out = read if out is None else out.unionByName(read)
    return out


def tidy_bars(spark, sf):
    """Vendor bars with untidy headers, stored and scanned."""
    path = f"{work_folder(spark)}/vendor"
    o = table(spark, sf, "orders")
    o.select(F.col("o_orderdate").alias("Datetime"), *[F.col("o_totalprice").cast("float").alias(c) for c in (" Open", "High", "LOW", "Close ")],
             F.col("o_orderkey").alias("Volume"), F.col("o_orderpriority").alias("Series ID")).write.parquet(path)
    return rounded(bar_files.read_bars(spark, path).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last"), F.sum("volume").alias("volume"),
        F.max(F.col("high") - F.col("low")).alias("spread")))


_M = METHODS.replace("{lineitem}", "lineitem")
_ODD = "(s_suppkey % 2 = 1)::VARCHAR"
_CENSUS = f"""WITH m AS ({_M}), s AS (SELECT *, s_suppkey::VARCHAR AS key, length(s_suppkey::VARCHAR) AS len FROM supplier),
fixed AS (
  SELECT s_suppkey AS config_id, unnest([
    row('..', 'Task', 1, 2, 0), row('', 'Settings', 1, 0, 0), row('WhatToBuild', 'WhatToBuild', 1, 0, 0),
    row('WhatToBuild/BuildMode', 'BuildMode', 1, 1, 0), row('WhatToBuild/BuildMode/PopulationSize', 'PopulationSize', 1, 0, len),
    row('WhatToBuild/BuildMode/EvoRestartOnStagnation', 'EvoRestartOnStagnation', 1, 2, 0), row('RiskMoneyManagement', 'RiskMoneyManagement', 1, 0, 0),
    row('RiskMoneyManagement/MoneyManagement', 'MoneyManagement', 1, 0, 0),
    row('RiskMoneyManagement/MoneyManagement/InitialCapital', 'InitialCapital', 1, 0, length((s_nationkey * 1000)::VARCHAR)),
    row('RiskMoneyManagement/RiskManagement', 'RiskManagement', 1, 1, 0), row('RiskMoneyManagement/RiskManagement/Method', 'Method', 1, 2, 0),
    row('Rankings', 'Rankings', 1, 1, 0), row('Rankings/FitnessCriteria', 'FitnessCriteria', 1, 2, 0), row('Rankings/FitnessCriteria/Settings', 'Settings', 1, 0, 0),
    row('Rankings/FitnessCriteria/Settings/Ranking', 'Ranking', 2, 2, 0), row('PartsToImprove', 'PartsToImprove', 1, 1, 0),
    row('PartsToImprove/ExitRules', 'ExitRules', 1, 1, 0), row('PartsToImprove/ExitRules/LongImprovement', 'LongImprovement', 1, 2, 0),
    row('PartsToImprove/ExitRules/ShortImprovement', 'ShortImprovement', 1, 2, 0), row('ATMs', 'ATMs', 1, 1, 0),
    row('ATMs/GenerateConfig', 'GenerateConfig', 1, 0, 0), row('ATMs/GenerateConfig/Types', 'Types', 1, 0, 0), row('ATMs/GenerateConfig/Types/Fixed', 'Fixed', 1, 2, 0),
    row('Notes', 'Notes', 1, 0, length('made by <' || s_name || '> & co')), row('Databanks', 'Databanks', 1, 1, 0), row('Databanks/Databank', 'Databank', 2, 6, 0),
    row('Resources', 'Resources', 1, 0, 0), row('Resources/Symbols', 'Symbols', 1, 0, 0), row('Resources/Symbols/Symbol', 'Symbol', 1, 1, 0),
    row('Resources/Symbols/Symbol/InstrumentInfo', 'InstrumentInfo', 1, 1, 0), row('Resources/Brokers', 'Brokers', 1, 0, 0),
    row('Resources/Brokers/Broker', 'Broker', 1, 2, 0), row('CrossChecks', 'CrossChecks', 1, 1, 0), row('CrossChecks/WhatIf', 'WhatIf', 1, 1, 0),
    row('CrossChecks/WhatIf/Settings', 'Settings', 1, 0, 0), row('CrossChecks/WhatIf/Settings/Days', 'Days', 1, 1, 1), row('Extras', 'Extras', 1, 1, 6),
    row('Extras/Item', 'Item', 2, 1, len)]) AS r FROM s),
listed AS (
  SELECT config_id, unnest([row('', 'Method', 1, 2, 0), row('/Params', 'Params', 1, 0, 0), row('/Params/Param', 'Param', 1, 2, length(n::VARCHAR)),
    row('/Parameter', 'Parameter', 1, 1, length(k::VARCHAR))]) AS r FROM m)
SELECT config_id, struct_extract(r, 1) AS place, struct_extract(r, 2) AS tag, struct_extract(r, 3)::BIGINT AS n, struct_extract(r, 4)::BIGINT AS n_attributes,
  struct_extract(r, 5)::BIGINT AS n_chars FROM fixed
UNION ALL SELECT config_id, 'RiskMoneyManagement/MoneyManagement/Method' || struct_extract(r, 1), struct_extract(r, 2), sum(struct_extract(r, 3))::BIGINT,
  sum(struct_extract(r, 4))::BIGINT, sum(struct_extract(r, 5))::BIGINT FROM listed GROUP BY 1, 2, 3"""
_SECTIONS = f"""WITH m AS ({_M}), numbered AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY flag) - 1 AS i FROM m),
s AS (SELECT *, s_suppkey::VARCHAR AS key, {_ODD} AS odd FROM supplier),
rows AS (SELECT s_suppkey AS config_id, unnest([
  row('risk', 'initial_capital', (s_nationkey * 1000)::VARCHAR), row('risk', 'max_drawdown', (s_suppkey % 30)::VARCHAR), row('risk', 'method', 'Stop/' || odd),
  row('build_mode', 'generationType', CASE WHEN s_suppkey % 3 = 0 THEN 'random' ELSE 'genetic' END), row('build_mode', 'PopulationSize', key),
  row('build_mode', 'EvoRestartOnStagnation.status', odd), row('build_mode', 'EvoRestartOnStagnation.generations', key),
  row('improve', 'ExitRules/long', odd || '/' || odd || '/add'), row('improve', 'ExitRules/short', odd || '/true/replace'),
  row('management', 'enable', odd), row('management', 'GenerateConfig/Types/Fixed.min', key), row('management', 'GenerateConfig/Types/Fixed.max', '9'),
  row('notes', '', 'made by <' || s_name || '> & co'), row('databank', '0/L0/Input', 'D0-' || key || '/' || odd), row('databank', '1/L1/Output', 'D1-' || key || '/' || odd),
  row('resource', 'symbol/0/name', 'S' || key), row('resource', 'symbol_instrument/0/tickSize', '0.01'), row('resource', 'broker/0/id', key),
  row('resource', 'broker/0/timezone', 'UTC'), row('fitness', '', 'F' || (s_suppkey % 3)::VARCHAR || '/' || odd || '/' || key),
  row('check', 'WhatIf/Settings/Days/mode', 'skip'), row('check', 'WhatIf/Settings/Days/', (s_suppkey % 5)::VARCHAR),
  row('raw', 'Extras/Extras', '{{"mode":"' || key || '"}}|before'), row('raw', 'Extras/Extras/Item', '{{}}|' || key || '|between'),
  row('raw', 'Extras/Extras/Item', '{{"n":"2"}}|after')]) AS r FROM s)
SELECT config_id, struct_extract(r, 1) AS section, struct_extract(r, 2) AS key, struct_extract(r, 3) AS value FROM rows
UNION ALL SELECT config_id, 'money', i || '/Size/Lots', 'M' || flag || '/' || on_::VARCHAR || '/' || n || '/int' FROM numbered
UNION ALL SELECT config_id, 'money', i || '/Risk/Risk', 'M' || flag || '/' || on_::VARCHAR || '/' || k || '/int' FROM numbered"""
_SPANS = cost_plans._SESS.split("wi AS")[0] + """
wk AS (SELECT DISTINCT symbol, d * 1440 + a AS o, d * 1440 + z AS c FROM (
  SELECT *, list_position(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'], day) - 1 AS d FROM ses) WHERE z > a),
tw AS (SELECT symbol, o, c FROM wk UNION ALL SELECT symbol, o + 10080, c + 10080 FROM wk),
mk AS (SELECT *, max(c) OVER (PARTITION BY symbol ORDER BY o, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tw),
ga AS (SELECT *, sum((before IS NULL OR o > before)::INT) OVER (PARTITION BY symbol ORDER BY o, c) AS g FROM mk),
sp2 AS (SELECT symbol, min(o) AS o, max(c) AS c FROM ga GROUP BY symbol, g),
en AS (SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size < 20 THEN 690 ELSE 600 + p_size END AS b, unnest([0, 1, 2, 3, 4]) AS d FROM part),
re AS (SELECT en.symbol, b::BIGINT AS window_end, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri'][d + 1] AS day,
  max(CASE WHEN o <= d * 1440 + b AND d * 1440 + b < c THEN floor((c - d * 1440 - b) / 60) END)::INTEGER AS bars_left
  FROM en JOIN sp2 ON sp2.symbol = en.symbol GROUP BY 1, 2, 3)"""

QUERIES = {
    "element_census": (element_census, _CENSUS),
    "ingest_sections": (ingest_sections, _SECTIONS),
    "zip_ingest": (zip_ingest, """SELECT 'c' || lpad(s_suppkey::VARCHAR, 8, '0') || '.cfx' AS path,
  CASE WHEN s_suppkey % 7 IN (3, 5) THEN 'unknown' ELSE 'builder' END AS kind, CASE WHEN s_suppkey % 7 NOT IN (3, 5) THEN 'build' END AS type,
  CASE s_suppkey % 7 WHEN 3 THEN 'no XML member' WHEN 5 THEN 'not a ZIP archive' END AS error,
  CASE WHEN s_suppkey % 7 IN (3, 5) THEN 0 ELSE 41 + 4 * coalesce(n, 0) END::BIGINT AS n_elements,
  CASE WHEN s_suppkey % 7 NOT IN (3, 5) THEN 'made by <' || s_name || '> & co' END AS notes
FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey"""),
    "workflow_ingest": (workflow_ingest, """WITH one AS (SELECT l_orderkey, l_linenumber AS k, min(row(l_suppkey, l_partkey, l_quantity, l_discount)) AS l FROM lineitem GROUP BY 1, 2),
x AS (SELECT l_orderkey, k, struct_extract(l, 1) AS s, struct_extract(l, 2) AS p, struct_extract(l, 3) AS q, struct_extract(l, 4) AS d FROM one)
SELECT 'p' || l_orderkey AS project_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY k)::INTEGER AS task_idx,
  CASE s % 3 WHEN 0 THEN 'Build' WHEN 1 THEN 'Retest' ELSE 'GoToTask' END AS type, 't' || k AS name, 't' || k AS title, d > 0.02 AS active,
  CASE WHEN s % 3 = 2 THEN 't1' END AS goto, q > 25 AS cross_check, 'input=D' || (p % 3) AS databank FROM x"""),
    "stress_spread": (stress_spread, cost_plans.STRESS_SQL),
    "time_stops": (time_stops, f"""WITH {_SPANS}
SELECT 'time_stop' AS "check", 'info' AS severity, 'P' || p_partkey AS symbol, p_size::DOUBLE AS value, min(bars_left)::DOUBLE AS "limit"
FROM part LEFT JOIN re ON re.symbol = 'P' || p_partkey
WHERE p_size > 25 AND 'P' || p_partkey IN (SELECT symbol FROM ses) AND 'P' || p_partkey IN (SELECT 'P' || l_partkey FROM lineitem) GROUP BY p_partkey, p_size"""),
    "session_reach": (session_reach, f"WITH {_SPANS} SELECT * FROM re"),
    "spec_file": (spec_file, cost_plans.QUERIES["broker_specs"][1]),
    "session_file": (session_file, """SELECT 'P' || l_partkey AS symbol, strftime(l_shipdate, '%a') AS day, (l_linenumber * 120 + 30)::INTEGER AS from_min,
  CASE WHEN l_quantity > 40 THEN 1440 ELSE 1425 END AS to_min, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (6, 7) GROUP BY ALL"""),
    "trade_series_file": (trade_series_file, """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_totalprice AS r
FROM orders WHERE o_orderkey % 10 <> 0"""),
    "result_sinks": (result_sinks, """SELECT unnest(['json', 'csv', 'parquet']) AS fmt, n_nationkey::BIGINT AS k, n_name FROM nation"""),
    "tidy_bars": (tidy_bars, """SELECT o_orderpriority AS series_id, count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last,
  sum(o_orderkey)::DOUBLE AS volume, 0::DOUBLE AS spread FROM orders GROUP BY 1"""),
}
