"""Lossless element table of XML documents, and typed tables of configurations as selects over it.

Every element becomes one row: where it stands (Dewey position and names of the elements around it), its name, attributes, its text
up to the first child and the text behind its end.  From these rows a document can be written again, up to
comments, processing instructions and namespace prefixes.  The walk streams: a task holds the open elements of one
document and a batch of finished rows, never a tree.

A section's table needs the rows of one place, so a stored element table is read with that place pushed down; a child finds
the ancestor it belongs to by the beginning of its Dewey position, an equi-join.  No section is named in the walk,
so what no typed table knows is still there (``raw_sections``).

Defined results: documents that are not well-formed, or declare entities, give one row with ``error`` and no element.  A null document
gives no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.sources.archives import inferred_type

ROWS = "dewey array<int>, place string, tag string, space string, text string, tail string, attributes map<string,string>, error string"
_ARROW = {
    "dewey": pa.list_(pa.int32()), "place": pa.string(), "tag": pa.string(), "space": pa.string(), "text": pa.string(), "tail": pa.string(),
    "attributes": pa.map_(pa.string(), pa.string()), "error": pa.string(),
}
BATCH = 8192
_CHUNK = 1 << 20
#: Characters up to which a document is walked once, its rows held until its end is seen.
_SHORT = 1 << 16
# Sections of the configuration format.
SECTIONS = (
    "Options", "WhatToBuild", "RiskMoneyManagement", "Data", "Rankings", "PartsToImprove", "CrossChecks", "Notes", "Blocks", "ATMs",
    "Databanks", "Resources",
)


class _Refused(Exception):
    """Entity declarations: a few bytes may stand for gigabytes."""


def _refuse(*_: object) -> None:
    raise _Refused("entity declarations are refused")


def _feed(parser: expat.XMLParserType, xml: str) -> Iterator[None]:
    for at in range(0, len(xml), _CHUNK):
        parser.Parse(xml[at: at + _CHUNK].encode("utf-8", "replace"), False)
        yield
    parser.Parse(b"", True)
    yield


def _parser() -> expat.XMLParserType:
    # text is decoded already: the prolog's encoding no longer holds
    parser = expat.ParserCreate("utf-8", namespace_separator="}")
    parser.EntityDeclHandler = _refuse
    parser.buffer_text = True
    return parser


def _name(raw: str) -> tuple[str, str | None]:
    space, _, tag = raw.rpartition("}")
    return tag, space or None


class _Walk:
    """Open elements, and rows of those whose following text is complete."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.open: list[dict] = []
        self.closed: dict | None = None
        self.parser = _parser()
        self.parser.ordered_attributes = True
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.data

    def _flush(self) -> None:
        if self.closed is not None:
            e = self.closed
            self.rows.append((e["dewey"], e["place"], e["tag"], e["space"], "".join(e["text"]) or None, "".join(e["tail"]) or None, e["attributes"], None))
            self.closed = None

    def start(self, raw: str, listed: list[str]) -> None:
        self._flush()
        tag, space = _name(raw)
        above = self.open[-1] if self.open else None
        if above is None:
            dewey, place = [1], ".."
        else:
            above["children"] += 1
            dewey = [*above["dewey"], above["children"]]
            place = tag if above["place"] is None else f"{above['place']}/{tag}"
        # places are counted from the settings; what stands outside them begins with two dots
        if tag == "Settings" and len(self.open) < 2:
            place = None
        pairs = [(n if s is None else f"{{{s}}}{n}", v) for (n, s), v in zip(map(_name, listed[::2]), listed[1::2])]
        self.open.append({"dewey": dewey, "place": place, "tag": tag, "space": space, "text": [], "tail": [], "attributes": pairs, "children": 0})

    def end(self, _: str) -> None:
        self._flush()
        self.closed = self.open.pop()

    def data(self, text: str) -> None:
        if self.closed is not None:
            self.closed["tail"].append(text)
        elif self.open:
            self.open[-1]["text"].append(text)


def _document_rows(xml: str) -> Iterator[list[tuple]]:
    """Rows of one document, a batch at a time."""
    walk = _Walk()
    short = len(xml) <= _SHORT
    try:
        for _ in _feed(walk.parser if short else _parser(), xml):  # nothing of a broken document reaches a table
            pass
    except (expat.ExpatError, _Refused) as problem:
        yield [(None, None, None, None, None, None, None, "malformed XML" if isinstance(problem, expat.ExpatError) else str(problem))]
        return
    for _ in () if short else _feed(walk.parser, xml):
        if len(walk.rows) >= BATCH:
            yield walk.rows
            walk.rows = []
    walk._flush()
    yield walk.rows


def element_table(docs: DataFrame, ids: tuple[str, ...] = ("config_id",), xml_col: str = "xml") -> DataFrame:
    """One row per element of every document, under the document's ``ids``."""
    names = [f"k{i}" for i in range(len(ids))]
    picked = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(ids, names)], F.col(f"`{xml_col}`").alias("xml")).where("xml is not null")
    made = T.StructType.fromDDL(ROWS)
    shape = T.StructType([*[T.StructField(k, picked.schema[k].dataType) for k in names], *made])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, of = [], []  # rows of short documents share a batch; ``of`` is each one's document

            def ready() -> pa.RecordBatch:
                part, at = held[:BATCH], pa.array(of[:BATCH], pa.int64())
                del held[:BATCH], of[:BATCH]
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(at) for k in names], *[pa.array([r[j] for r in part], kind) for j, kind in enumerate(_ARROW.values())]],
                    names=[*names, *_ARROW])

            for i in range(batch.num_rows):
                for rows in _document_rows(batch.column("xml")[i].as_py()):
                    held += rows
                    of += [i] * len(rows)
                    while len(held) >= BATCH:
                        yield ready()
            if held:
                yield ready()

    out = picked.mapInArrow(run, shape)
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, ids)], *made.names)


def id_names(elements: DataFrame) -> list[str]:
    """The columns that name the document."""
    return [c for c in elements.columns if c not in _ARROW]


def errors(elements: DataFrame) -> DataFrame:
    """Documents that could not be read, with their error."""
    return elements.where("error is not null").select(*id_names(elements), "error")


def attribute_table(elements: DataFrame) -> DataFrame:
    """One row per attribute: the document, ``dewey``, ``place``, ``tag``, ``attribute``, ``value``."""
    return elements.select(*id_names(elements), "dewey", "place", "tag", F.explode("attributes").alias("attribute", "value"))


def census(elements: DataFrame) -> DataFrame:
    """Elements, attributes and characters of text per document, place and name."""
    known = elements.where("error is null")
    return known.groupBy(*id_names(elements), "place", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("attributes")).cast("long").alias("n_attributes"),
        F.sum(F.length(text())).cast("long").alias("n_chars"))


def at(elements: DataFrame, *places: str) -> DataFrame:
    return elements.where(F.col("place").isin(*places))


def attribute(name: str, default: str | None = None) -> Column:
    found = F.try_element_at("attributes", F.lit(name))
    return found if default is None else F.coalesce(found, F.lit(default))


def flag(name: str) -> Column:
    return attribute(name, "false") == "true"


def text() -> Column:
    """The element's text as a value: trimmed, empty where there is none."""
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")


def ancestor(levels: int) -> Column:
    return F.slice("dewey", F.lit(1), F.size("dewey") - levels)


def position(levels: int = 0) -> Column:
    """The element's, or an ancestor's, position among its siblings, from 0."""
    return F.element_at("dewey", -1 - levels) - 1


def _with_owner(rows: DataFrame, owners: DataFrame, ids: list[str], levels: int) -> DataFrame:
    """Join elements to the ancestor ``levels`` above; ``owners`` has the ids, ``dewey`` and further columns."""
    return rows.withColumn("owner", ancestor(levels)).join(owners.withColumnRenamed("dewey", "owner"), [*ids, "owner"])


_PARAMS = ("Param", "Parameter")


def _parameters(elements: DataFrame, owner: str, with_bare: bool = True) -> DataFrame:
    """Parameters of the elements at ``owner``, with the owner's Dewey position; they stand in a list or (spelt out) directly."""
    listed = at(elements, *[f"{owner}/Params/{p}" for p in _PARAMS]).withColumn("owner", ancestor(2))
    if with_bare:
        listed = listed.unionByName(at(elements, f"{owner}/Parameter").withColumn("owner", ancestor(1)))
    return listed.select(*id_names(elements), "owner", "dewey", attribute("key", "").alias("key"),
                         F.coalesce(attribute("name"), attribute("key", "")).alias("name"), text().alias("value"), inferred_type(F.coalesce("text", F.lit(""))).alias("inferred_type"))


def money_methods(elements: DataFrame) -> DataFrame:
    """Money-management methods: ``method_idx``, ``type``, ``use``, and one row per parameter (a null key for a method without)."""
    place = "RiskMoneyManagement/MoneyManagement/Method"
    ids = id_names(elements)
    methods = at(elements, place).select(*ids, F.col("dewey").alias("owner"), position().alias("method_idx"), attribute("type", "").alias("type"), flag("use").alias("use"))
    params = _parameters(elements, place).drop("dewey")
    return methods.join(params, [*ids, "owner"], "left").drop("owner")


def risk_settings(elements: DataFrame) -> DataFrame:
    """Initial capital, drawdown limit and the risk method, as ``key``, ``value`` rows."""
    ids, base = id_names(elements), "RiskMoneyManagement"
    capital = at(elements, f"{base}/MoneyManagement/InitialCapital").select(*ids, F.lit("initial_capital").alias("key"), text().alias("value"))
    limit = at(elements, f"{base}/RiskManagement").select(*ids, F.lit("max_drawdown").alias("key"), attribute("maxDrawdown", "").alias("value"))
    method = at(elements, f"{base}/RiskManagement/Method").select(*ids, F.lit("method").alias("key"), F.concat_ws("/", attribute("type", ""), flag("use").cast("string")).alias("value"))
    return capital.unionByName(limit).unionByName(method)


def build_mode(elements: DataFrame) -> DataFrame:
    """The build mode's attributes and settings as ``key``, ``value`` rows; attributes of a setting are ``setting.attribute``."""
    ids, base = id_names(elements), "WhatToBuild/BuildMode"
    own = at(elements, base).select(*ids, F.explode("attributes").alias("key", "value"))
    children = elements.where(F.col("place").startswith(base + "/") & (F.regexp_count("place", F.lit("/")) == 2))
    texts = children.where("tag <> 'Conditions' and size(attributes) = 0").select(*ids, F.col("tag").alias("key"), text().alias("value"))
    pairs = children.select(*ids, "tag", F.explode("attributes").alias("a", "value")).select(*ids, F.concat_ws(".", "tag", "a").alias("key"), "value")
    return own.unionByName(texts).unionByName(pairs)


def parts_to_improve(elements: DataFrame) -> DataFrame:
    """``part``, its symmetry, and per side whether and how it is improved."""
    base, names = "PartsToImprove", ("EntryRules", "OrderTypes", "ExitRules")
    ids = id_names(elements)
    parts = at(elements, *[f"{base}/{n}" for n in names]).select(*ids, "dewey", F.col("tag").alias("part"), attribute("symmetry", "false").alias("symmetry"))
    sides = at(elements, *[f"{base}/{n}/{s}Improvement" for n in names for s in ("Long", "Short")]).select(
        *ids, "dewey", F.lower(F.regexp_replace("tag", "Improvement$", "")).alias("side"), flag("use").alias("use"), attribute("action", "").alias("action"))
    return _with_owner(sides, parts, ids, 1).select(*ids, "part", "symmetry", "side", "use", "action")


def trade_management(elements: DataFrame) -> DataFrame:
    """Scaling-out settings: attributes of the section, of its profile and of the generated types, as ``key``, ``value`` rows."""
    ids = id_names(elements)
    rows = elements.where((F.col("place") == "ATMs") | F.col("place").startswith("ATMs/"))
    key = F.concat_ws(".", F.regexp_replace("place", "^ATMs/?", ""), "attribute")
    return rows.select(*ids, "place", F.explode("attributes").alias("attribute", "value")).select(*ids, F.regexp_replace(key, r"^\.", "").alias("key"), "value")


def notes(elements: DataFrame) -> DataFrame:
    return at(elements, "Notes").select(*id_names(elements), text().alias("notes")).where("notes <> ''")


def databanks(elements: DataFrame) -> DataFrame:
    ids = id_names(elements)
    owner = at(elements, "Databanks").select(*ids, "dewey", flag("retestSelected").alias("retest_selected"))
    banks = at(elements, "Databanks/Databank").select(
        *ids, "dewey", position().alias("databank_idx"), attribute("label", "").alias("label"), attribute("name", "").alias("name"), attribute("value", "").alias("value"))
    return _with_owner(banks, owner, ids, 1).drop("owner", "dewey")


def resources(elements: DataFrame) -> DataFrame:
    """Symbols, brokers and instruments that a configuration carries: ``kind``, ``resource_idx``, ``attribute``, ``value``."""
    places = {"Resources/Symbols/Symbol": "symbol", "Resources/Symbols/Symbol/InstrumentInfo": "symbol_instrument",
              "Resources/Brokers/Broker": "broker", "Resources/Instruments/InstrumentInfo": "instrument"}
    kind = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    # a symbol's instrument counts under its symbol
    own = F.when(F.col("place") == "Resources/Symbols/Symbol/InstrumentInfo", position(1)).otherwise(position())
    return at(elements, *places).select(*id_names(elements), F.element_at(kind, F.col("place")).alias("kind"), own.alias("resource_idx"),
                                        F.explode("attributes").alias("attribute", "value"))


def fitness(elements: DataFrame) -> DataFrame:
    """How candidates are ranked: ``method``, ``use_by_index`` and the type of the ranking setting (the last one counts)."""
    ids = id_names(elements)
    types = at(elements, "Rankings/FitnessCriteria/Settings/Ranking").groupBy(*ids, ancestor(2).alias("dewey")).agg(
        F.max_by(attribute("type", ""), "dewey").alias("type"))
    criteria = at(elements, "Rankings/FitnessCriteria").select(
        *ids, "dewey", attribute("method", "").alias("method"), attribute("useFitnessByIndex", "false").alias("use_by_index"))
    return criteria.join(types, [*ids, "dewey"], "left").drop("dewey")


def check_settings(elements: DataFrame) -> DataFrame:
    """Settings and acceptance rules of the cross checks, one row per attribute or text: ``check``, ``part``, ``place``, ``key``, ``value``."""
    parts = F.split("place", "/")
    rows = elements.where(F.col("place").startswith("CrossChecks/") & F.get(parts, F.lit(2)).isin("Settings", "AcceptanceSettings"))
    entries = F.concat(
        F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
        F.when(text() != "", F.array(F.struct(F.lit("").alias("key"), text().alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    return rows.select(*id_names(elements), F.get(parts, F.lit(1)).alias("check"), F.get(parts, F.lit(2)).alias("part"),
                       F.array_join(F.slice(parts, 4, 1000), "/").alias("place"), "dewey", F.explode(entries).alias("e")).select(
        *id_names(elements), "check", "part", "place", "dewey", "e.key", "e.value")


def raw_sections(elements: DataFrame) -> DataFrame:
    """Elements of the sections that no typed table knows."""
    section = F.element_at(F.split("place", "/"), 1)
    return elements.where(F.col("place").isNotNull() & ~section.isin("..", *SECTIONS)).withColumn("section", section)


def chart_symbols(elements: DataFrame) -> DataFrame:
    """``symbol``: what the first chart of a document shows, as the broker writes it."""
    charts = at(elements, "Data/Setups/Setup/Chart").where(attribute("symbol", "") != "")
    return charts.groupBy(*id_names(elements)).agg(F.min_by(attribute("symbol"), "dewey").alias("symbol"))


def stress_ranges(elements: DataFrame, method: str = "RandomizeSpread") -> DataFrame:
    """``stress_min`` and ``stress_max`` of the first active stress test that randomises the spread, one row per document.

    A Monte Carlo retest counts where it is in use, wherever it stands, and so does its method; both limits must be given.
    """
    ids = id_names(elements)
    tests = elements.where((F.col("tag") == "MonteCarloRetest") & flag("use")).select(*ids, F.col("dewey").alias("test"))
    used = elements.where((F.col("tag") == "Method") & flag("use") & (attribute("type") == method)).select(*ids, F.col("dewey").alias("owner"))
    # any ancestor may be the test
    inside = used.select(*ids, "owner", F.explode(F.transform(F.sequence(F.lit(1), F.size("owner") - 1), lambda k: F.slice("owner", F.lit(1), k))).alias("test"))
    methods = inside.join(tests, [*ids, "test"]).select(*ids, "owner").distinct()
    limits = elements.where(F.col("place").endswith("/Method/Params/Param") & attribute("key").isin("Min", "Max")).select(
        *ids, ancestor(2).alias("owner"), "dewey", attribute("key").alias("key"), F.nullif(text(), F.lit("")).try_cast("double").alias("value"))
    first = limits.join(methods, [*ids, "owner"]).groupBy(*ids, "owner").agg(
        F.min_by("value", F.when(F.col("key") == "Min", F.col("dewey"))).alias("stress_min"), F.min_by("value", F.when(F.col("key") == "Max", F.col("dewey"))).alias("stress_max"))
    return first.where("stress_min is not null and stress_max is not null").groupBy(*ids).agg(
        F.min_by(F.struct("stress_min", "stress_max"), "owner").alias("s")).select(*ids, "s.*")


def exit_bars(elements: DataFrame, key: str = "#ExitAfterBars.ExitAfterBars#") -> DataFrame:
    """``max_exit_bars``: the upper limit of the first time stop of a document whose limits are numbers."""
    ids = id_names(elements)
    low, high = attribute("minValue"), attribute("maxValue")
    found = elements.where((attribute("key") == key) & low.rlike(r"^\d+$") & high.rlike(r"^\d+$"))
    return found.groupBy(*ids).agg(F.min_by(high.cast("int"), "dewey").alias("max_exit_bars"))
