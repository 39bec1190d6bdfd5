"""Configuration archives: many ZIP files to normalised tables.

Archives are unpacked where their bytes are read (one small file per row), and
the XML is parsed by Spark's own ``from_xml`` into typed structs, from which every
table is a plain select and explode.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.columns import once
from tickloom.session import materialise

MEMBER_SCHEMA = "path string, member string, xml string, error string"

_PARAMS = "array<struct<_key:string,_name:string,_className:string,_VALUE:string>>"
_SIDE = "struct<_valueType:string,`Column-Value`:struct<_column:string>,`Numeric-Value`:struct<_value:string>>"
_CONDITIONS = (
    "struct<Condition:array<struct<_use:string,`Left-Side`:" + _SIDE
    + ",Comparator:struct<_value:string>,`Right-Side`:" + _SIDE + ">>>"
)
_BLOCK_PARAMS = (
    "array<struct<_key:string,_name:string,_type:string,_paramType:string,_generation:string,_minValue:string,"
    "_maxValue:string,_step:string,_values:string,_defaultValue:string,_VALUE:string>>"
)
_BLOCKS = (
    "struct<Block:array<struct<_key:string,_weight:string,_use:string,_category:string,_probability:string,"
    "_indicatorMin:string,_indicatorMax:string,_indicatorStep:string,Generated:struct<Param:" + _BLOCK_PARAMS + ",Parameter:" + _BLOCK_PARAMS + ">>>>"
)
_CONTAINERS = "BuildingBlocks:" + _BLOCKS + ",OrderTypes:" + _BLOCKS + ",ExitTypes:" + _BLOCKS
# Section and check names of the configuration format.
CHECKS = (
    "RetestOnAdditionalMarkets", "WalkForwardOptimization", "RetestWithHigherPrecision", "MonteCarloRetest",
    "WalkForwardMatrix", "MonteCarloManipulation", "OptProfileSysParamPermutation", "WhatIf", "SequentialOptimization",
)
KINDS = ("build", "retester", "optimizer", "buildingconfig", "customproject", "info")
SLPT_KEYS = (
    "LimitSLPTRRR", "LimitSLPTRRRFrom", "LimitSLPTRRRTo", "MinSLATRMultiple", "MaxSLATRMultiple",
    "MinPTATRMultiple", "MaxPTATRMultiple", "MinSLInPips", "MinPTInPips", "SLRequired", "PTRequired", "SLATR", "PTATR",
)
_SETTINGS = (
    "struct<Options:struct<BuildTradingOptions:struct<Params:array<struct<Param:" + _PARAMS + ",Parameter:" + _PARAMS + ">>>>,"
    "WhatToBuild:struct<StrategyType:struct<_type:string>,MarketSides:struct<_type:string>,SLPTOptions:struct<"
    + ",".join(f"{k}:string" for k in SLPT_KEYS) + ">,BuildMode:struct<_generationType:string,PopulationSize:string,"
    "MaxGenerations:string,CrossoverProbability:string,MutationProbability:string>>,"
    "Data:struct<Setups:struct<Setup:array<struct<_dateFrom:string,_dateTo:string,Chart:array<struct<_symbol:string,"
    "_timeframe:string,_spread:string>>>>>,OutOfSample:struct<Range:array<struct<_dateFrom:string,_dateTo:string,"
    "_type:string>>>>,"
    "Rankings:struct<_type:string,MaxStrategies:string,FitnessCriteria:struct<_method:string>,Conditions:" + _CONDITIONS + ">,"
    "CrossChecks:struct<_use:string," + ",".join(f"{c}:struct<_use:string>" for c in CHECKS) + ">,"
    "Databanks:struct<Databank:array<struct<_label:string,_name:string,_value:string>>>,"
    "Blocks:struct<" + _CONTAINERS + ">,GoToTask:struct<_task:string>>"
)
# the corrupt record must come last: a column before the others shifts them
CONFIG_XML = "_type string, _version string, Settings " + _SETTINGS + ", _corrupt_record string"
BLOCKS_XML = "_type string, _version string, " + _CONTAINERS.replace("BuildingBlocks:", "BuildingBlocks ").replace(
    ",OrderTypes:", ", OrderTypes ").replace(",ExitTypes:", ", ExitTypes ") + ", _corrupt_record string"
PROJECT_XML = (
    "_name string, _version string, Databanks struct<Databank:array<struct<_name:string,_position:string>>>, "
    "Tasks struct<Task:array<struct<_type:string,_name:string,_title:string,_active:string,_taskXMLFile:string,"
    "_templateFile:string>>>"
)
TASK_XML = "Settings " + _SETTINGS


# the encoding that an XML prolog names
_PROLOG = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)")
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def decoded(raw: bytes) -> str:
    """XML text by its byte order mark, else by its prolog, else as UTF-8; bad bytes are replaced."""
    for mark, name in _BOMS:
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    named = _PROLOG.match(raw[:400])
    return raw.decode(named[1].decode() if named else "utf-8", "replace")


def _members(path: str, content: bytes) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield path, None, None, "not a ZIP archive"
        return
    with archive:
        names = [m for m in archive.namelist() if m.endswith(".xml")]
        if not names:
            yield path, None, None, "no XML member"
        for name in names:
            try:
                yield path, name, decoded(archive.read(name)), None
            except LookupError:
                yield path, name, None, "unknown encoding"
            except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError):
                yield path, name, None, "unreadable member"


def unpacked(files: DataFrame) -> DataFrame:
    """(path, member, xml, error): the XML members of archives given as (path, content).

    What cannot be read (no archive, no XML, an encrypted or damaged member, an unknown encoding) is a row with its error.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for member in _members(name, content):  # one document at a time
                    yield pd.DataFrame([member], columns=["path", "member", "xml", "error"])

    return files.select("path", "content").mapInPandas(unpack, MEMBER_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The XML members of every archive under ``path``."""
    return unpacked(spark.read.format("binaryFile").load(path))


def root_tag(xml: Column) -> Column:
    """Name of the document element, without its namespace prefix."""
    return F.regexp_extract(xml, r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)(?=[\s/>])", 1)


def archive_kinds(members: DataFrame) -> DataFrame:
    """What each archive is: project, blocks, builder (with its type) or unknown.

    ``config.xml`` decides; an archive without it is a block file if any member holds blocks.
    """
    main = F.col("member") == "config.xml"
    tag = root_tag(F.col("xml"))
    # the type attribute of the document element, after prolog and comments
    declared = F.lower(F.regexp_extract(
        "xml", r"^(?s)(?:<\?.*?\?>|<!--.*?-->|[^<])*<[A-Za-z][^>]*?\stype=\"([^\"]*)\"", 1))
    n_blocks = F.regexp_count("xml", F.lit(r"<(?:[A-Za-z_][\w.-]*:)?Block[\s/>]"))
    g = members.groupBy("path").agg(
        F.max(F.when(main, tag)).alias("root"), F.max(F.when(main, declared)).alias("declared"),
        F.max(F.when(main & (tag == "Project"), F.col("xml").contains("<Tasks"))).alias("has_tasks"),
        F.max(n_blocks).alias("blocks"), F.max("error").alias("error"),
    )
    kind = (
        F.when(F.coalesce("has_tasks", F.lit(False)), F.lit("project"))
        .when(F.col("root") == "Blocks", F.lit("blocks")).when(F.col("root").isNotNull(), F.lit("builder"))
        .when(F.col("blocks") > 0, F.lit("blocks")).otherwise(F.lit("unknown"))
    )
    typed = (
        F.when(F.col("declared") == "", F.lit("build")).when(F.col("declared").isin(*KINDS), F.col("declared"))
        .otherwise(F.lit("unknown"))
    )
    return g.select("path", kind.alias("kind"), F.when(kind == "builder", typed).alias("type"), "error")


def _parsed(docs: DataFrame, schema: str) -> DataFrame:
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_"}
    return docs.withColumn("doc", F.from_xml("xml", F.lit(schema), options))


def parse_configs(docs: DataFrame) -> DataFrame:
    """Typed structs of builder documents (config_id, xml) -> (config_id, doc)."""
    return once(_parsed(docs, CONFIG_XML), F.col("config_id"), F.col("doc"))


def sections(parsed: DataFrame, *places: str) -> DataFrame:
    """The documents with the named sections only, each ``Section`` or ``Section.Part``, for a table that is stored."""
    named: dict[str, list[str]] = {}
    for section, _, part in (p.partition(".") for p in places):
        named.setdefault(section, []).extend([part] if part else [])
    kept = [
        F.struct(*[F.col(f"doc.Settings.{s}.{p}").alias(p) for p in parts]).alias(s) if parts else F.col(f"doc.Settings.{s}").alias(s)
        for s, parts in named.items()
    ]
    return parsed.select("config_id", F.struct(F.struct(*kept).alias("Settings")).alias("doc"))


def parse_block_files(docs: DataFrame) -> DataFrame:
    return _parsed(docs, BLOCKS_XML).select("config_id", "doc")


def malformed(parsed: DataFrame) -> DataFrame:
    """(config_id, error) of documents that are not well-formed XML; none of their sections reach a table."""
    bad = F.col("doc._corrupt_record").isNotNull() | F.col("doc").isNull()
    return parsed.filter(bad).select("config_id", F.lit("malformed XML").alias("error"))


def _params(group: str) -> Column:
    """Both spellings of a parameter element, in one list."""
    lists = [F.coalesce(f"{group}.{name}", F.array().cast(_PARAMS if group == "g" else _BLOCK_PARAMS)) for name in ("Param", "Parameter")]
    return F.concat(*lists)


def inferred_type(raw: Column) -> Column:
    """Dynamic type of a value: bool, int, float or string."""
    v = F.trim(F.regexp_replace(F.trim(raw), "^[\"']+|[\"']+$", ""))
    return (
        F.when(F.lower(v).isin("true", "false"), F.lit("bool")).when(v.rlike(r"^-?\d+$"), F.lit("int"))
        .when(v.rlike(r"^-?\d+\.\d+$"), F.lit("float")).otherwise(F.lit("string"))
    )


def config_table(parsed: DataFrame) -> DataFrame:
    declared = F.lower("doc._type")
    s = "doc.Settings"
    return parsed.select(
        "config_id", F.when(declared.isin(*KINDS), declared).otherwise(F.lit("unknown")).alias("type"),
        F.col("doc._version").alias("version"), F.col(f"{s}.WhatToBuild.StrategyType._type").alias("strategy_type"),
        F.col(f"{s}.WhatToBuild.MarketSides._type").alias("market_sides"),
        F.col(f"{s}.Rankings._type").alias("ranking_type"), F.col(f"{s}.Rankings.MaxStrategies").alias("max_strategies"),
    )


def option_table(parsed: DataFrame, settings: str = "doc.Settings", ids: tuple[str, ...] = ("config_id",)) -> DataFrame:
    groups = parsed.select(*ids, F.explode(f"{settings}.Options.BuildTradingOptions.Params").alias("g"))
    p = groups.select(*ids, F.explode(_params("g")).alias("p"))
    return p.select(
        *ids, F.col("p._key").alias("key"), F.trim("p._VALUE").alias("value"), inferred_type(F.col("p._VALUE")).alias("inferred_type")
    )


def slpt_table(parsed: DataFrame) -> DataFrame:
    s = "doc.Settings.WhatToBuild.SLPTOptions"
    items = F.array(*[F.struct(F.lit(k).alias("key"), F.trim(f"{s}.{k}").alias("value")) for k in SLPT_KEYS])
    return parsed.select("config_id", F.explode(items).alias("i")).filter("i.value IS NOT NULL").select("config_id", "i.*")


def _containers(parsed: DataFrame, base: str) -> DataFrame:
    parts = F.array(*[
        F.struct(F.lit(n).alias("container"), F.col(f"{base}.{c}.Block").alias("blocks"))
        for n, c in (("building", "BuildingBlocks"), ("order", "OrderTypes"), ("exit", "ExitTypes"))
    ])
    c = parsed.select("config_id", F.explode(parts).alias("c"))
    return c.select("config_id", "c.container", F.posexplode("c.blocks").alias("block_idx", "b"))


def block_table(parsed: DataFrame, base: str = "doc.Settings.Blocks") -> DataFrame:
    """Blocks of all containers; ``base`` is "doc" for block files."""
    return _containers(parsed, base).select(
        "config_id", "container", "block_idx", F.col("b._key").alias("key"), F.col("b._category").alias("category"),
        F.coalesce("b._weight", F.lit("1")).cast("double").alias("weight"),
        F.coalesce(F.col("b._use") == "true", F.lit(False)).alias("use"), F.col("b._probability").alias("probability"),
    )


def block_param_table(parsed: DataFrame, base: str = "doc.Settings.Blocks") -> DataFrame:
    p = _containers(parsed, base).select(
        "config_id", "container", "block_idx", F.col("b._key").alias("block_key"),
        F.posexplode(_params("b.Generated")).alias("param_idx", "p"))
    return p.select(
        "config_id", "container", "block_idx", "block_key", "param_idx", F.col("p._key").alias("key"),
        F.coalesce("p._name", "p._key").alias("name"), F.col("p._type").alias("type"), F.col("p._paramType").alias("param_type"),
        F.col("p._generation").alias("generation"), F.col("p._minValue").alias("min"), F.col("p._maxValue").alias("max"),
        F.col("p._step").alias("step"), F.col("p._values").alias("values"), F.col("p._defaultValue").alias("default"),
        F.trim("p._VALUE").alias("value"),
    )


def condition_table(parsed: DataFrame) -> DataFrame:
    c = parsed.select("config_id", F.posexplode("doc.Settings.Rankings.Conditions.Condition").alias("condition_idx", "c"))
    return c.select(
        "config_id", "condition_idx", F.col("c.Left-Side.Column-Value._column").alias("column"),
        F.col("c.Comparator._value").alias("comparator"), F.col("c.Right-Side.Numeric-Value._value").alias("numeric"),
        F.coalesce(F.col("c._use") == "true", F.lit(False)).alias("use"),
    )


def _dotted_date(raw: str | Column) -> Column:
    return F.try_to_timestamp(F.col(raw) if isinstance(raw, str) else raw, F.lit("yyyy.MM.dd")).cast("date")


def setup_table(parsed: DataFrame) -> DataFrame:
    s = parsed.select("config_id", F.posexplode("doc.Settings.Data.Setups.Setup").alias("setup_idx", "s"))
    return s.select(
        "config_id", "setup_idx", _dotted_date("s._dateFrom").alias("date_from"), _dotted_date("s._dateTo").alias("date_to"),
        F.transform("s.Chart", lambda c: c["_symbol"]).alias("symbols"),
    )


def range_table(parsed: DataFrame, settings: str = "doc.Settings", ids: tuple[str, ...] = ("config_id",)) -> DataFrame:
    r = parsed.select(*ids, F.posexplode(f"{settings}.Data.OutOfSample.Range").alias("range_idx", "r"))
    return r.select(
        *ids, "range_idx", _dotted_date("r._dateFrom").alias("date_from"), _dotted_date("r._dateTo").alias("date_to"),
        F.col("r._type").alias("type"),
    )


def cross_check_table(parsed: DataFrame, settings: str = "doc.Settings", ids: tuple[str, ...] = ("config_id",)) -> DataFrame:
    c = F.array(*[
        F.struct(F.lit(n).alias("check"), (F.col(f"{settings}.CrossChecks.{n}._use") == "true").alias("use")) for n in CHECKS
    ])
    return parsed.select(*ids, F.explode(c).alias("c")).filter("c.use IS NOT NULL").select(*ids, "c.check", "c.use")


def project_tables(members: DataFrame) -> dict[str, DataFrame]:
    """Tables of workflow archives: task, task_option, task_range, task_check, task_databank.

    Manifest and task documents meet by (archive, member), an equi join.
    """
    ids = ("project_id", "task_idx")
    main = members.filter((F.col("member") == "config.xml") & (root_tag(F.col("xml")) == "Project"))
    manifest = once(_parsed(main, PROJECT_XML), F.col("path").alias("project_id"), F.col("doc").alias("doc")).select(
        "project_id", F.posexplode("doc.Tasks.Task").alias("_i", "t"))
    # manifests and task documents are parsed once and stored; small files may hold many rows, so no join is chosen by their size
    task = materialise(manifest.select(
        "project_id", (F.col("_i") + 1).alias("task_idx"), F.col("t._type").alias("type"), F.col("t._name").alias("name"),
        F.coalesce(F.nullif(F.col("t._title"), F.lit("")), F.col("t._name")).alias("title"),
        (F.lower(F.coalesce("t._active", F.lit("true"))) == "true").alias("active"),
        F.coalesce("t._templateFile", F.lit("")).alias("template_file"), F.col("t._taskXMLFile").alias("member"),
    )).hint("merge")
    docs = members.select(F.col("path").alias("project_id"), "member", "xml")
    # a task file is <X><Settings>...</Settings></X> or a bare <Settings> element
    wrapped = F.when(root_tag(F.col("xml")) == "Settings", F.concat(
        F.lit("<Task>"), F.regexp_replace("xml", r"^\s*<\?xml[^>]*\?>", ""), F.lit("</Task>"))).otherwise(F.col("xml"))
    parsed = _parsed(task.join(docs, ["project_id", "member"]).withColumn("xml", wrapped), TASK_XML)
    read = {s: F.col(f"doc.Settings.{s}") for s in ("Options", "CrossChecks", "Databanks", "GoToTask")}
    read["Data"] = F.struct(F.col("doc.Settings.Data.OutOfSample").alias("OutOfSample"))
    parsed = materialise(parsed.select(*ids, F.struct(F.struct(*[c.alias(s) for s, c in read.items()]).alias("Settings")).alias("doc"))).hint("merge")
    goto = parsed.select(*ids, F.col("doc.Settings.GoToTask._task").alias("goto"))
    checks = cross_check_table(parsed, ids=ids)
    enabled = checks.groupBy(*ids).agg(F.max("use").alias("cross_check"))
    banks = parsed.select(*ids, F.explode("doc.Settings.Databanks.Databank").alias("d")).select(
        *ids, F.lower("d._name").alias("role"), F.col("d._value").alias("databank"))
    full = task.drop("member").join(goto, list(ids), "left").join(enabled, list(ids), "left")
    return {
        "task": full.withColumn("cross_check", F.coalesce("cross_check", F.lit(False))),
        "task_option": option_table(parsed, ids=ids), "task_range": range_table(parsed, ids=ids),
        "task_check": checks, "task_databank": banks,
    }
