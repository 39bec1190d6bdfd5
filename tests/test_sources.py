"""Files in, tables out: bars, trade lists, broker CSV, strategy CSV, archives, the landing stream."""

import datetime
import pathlib
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bar_helpers import frame, walk
from tickloom.operators import configs
from tickloom.sources import archives, bars as src, broker, strategies
from tickloom.streaming.landing import landing_stream, start_merge
from tickloom.streaming.rollup import rolled_bars, start_rollup


def as_bars(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_bar_store_keeps_the_last_write(spark, tmp_path):
    pdf = pd.concat([walk(400, 1, "A"), walk(50, 2, "B")])
    path = str(tmp_path / "bars")
    src.write_bars(as_bars(spark, pdf), path)
    assert dict(spark.read.parquet(path).dtypes)["close"] == "float"
    late = pdf[pdf["series_id"] == "A"].tail(30).assign(close=1.0)
    new = walk(430, 1, "A").tail(30)
    src.append_bars(spark, as_bars(spark, pd.concat([late, new])), path)
    got = frame(src.read_bars(spark, path), "series_id", "ts")
    assert len(got) == 480 and (got["close"] == 1.0).sum() == 30
    marks = {r.series_id: r.last_ts for r in src.high_water_marks(src.read_bars(spark, path)).collect()}
    assert marks["A"] == new["ts"].max()


def test_landing_stream_is_idempotent(spark, tmp_path):
    pdf = walk(200, 3, "A")
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    columns = list(src.BAR_COLUMNS)
    as_bars(spark, pdf.head(150)).select(columns).coalesce(1).write.parquet(str(landing), mode="append")
    for progress in ("p1", "p1", "p2"):  # the last run replays everything
        start_merge(landing_stream(spark, str(landing)), store, str(tmp_path / progress)).awaitTermination(120)
        as_bars(spark, pdf.tail(80)).select(columns).coalesce(1).write.parquet(str(landing), mode="append")
    assert src.read_bars(spark, store).count() == 200


def test_tidy_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Date Time` int, `Datetime` int")
    assert src.tidy_names(df).columns == ["date_time", "ts"]


@pytest.mark.parametrize("text,want", [
    ("1\n-2.5\nx\n\n3\n", [1, -2.5, 3]), ("id,Profit\n1,$5.5\n2,bad\n3,-7\n", [5.5, -7]), ("a;My Result\n1;2\n1;4\n", [2, 4]),
])
def test_trade_numbers(spark, tmp_path, text, want):
    path = tmp_path / "trades.csv"
    path.write_text(text)
    got = frame(src.read_trade_numbers(spark, str(path)), "seq")
    assert list(got["r"]) == want and list(got["seq"]) == list(range(len(want)))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for fmt in ("json", "csv", "parquet"):
        src.write_report(df, str(tmp_path / fmt), fmt)
        reader = spark.read.option("header", True).format(fmt)
        assert reader.load(str(tmp_path / fmt)).count() == 1


def test_broker_files(spark, tmp_path):
    specs, sessions = tmp_path / "specs.csv", tmp_path / "sessions.csv"
    specs.write_text(";".join(broker.SPEC_COLUMNS) + "\nUSTECm;d;p;2;0.01;112;0;1.0;0.01;1;-0.8;bad\nGONE;NO_EXISTE;;;;;;;;;;\nX;d;p;;0.1;1;0;1;1;1;0;0\n")
    sessions.write_text("symbol;day;session_from;session_to\nUSTECm;Mon;22:00;00:00\nGONE;NO_EXISTE;;\n")
    rows = broker.read_specs(spark, str(specs)).collect()
    assert [(r.symbol, r.spread, r.swap_long, r.swap_short) for r in rows] == [("USTEC", 112, -0.8, 0.0)]
    assert [tuple(r) for r in broker.read_sessions(spark, str(sessions)).collect()] == [("USTECm", "Mon", 1320, 1440)]


@pytest.mark.parametrize("sep", [";", ","])
def test_strategy_export(spark, tmp_path, sep):
    path = tmp_path / "s.csv"
    head = ["Strategy Name", "Net Profit", "Profit Factor", "Win/Loss Ratio", "# Trades", "Max Drawdown %", "Colour"]
    path.write_text("\n".join(sep.join(r) for r in [head, ["S1", "$1500", "1.85", "1.72", "410", "8.2%", "red"], ["S2", "900", "-", "1.38", "N/A", "11.4", "x"]]) + "\n")
    df, unmapped = strategies.read_strategies(spark, str(path))
    got = frame(df, "strategyname")
    assert unmapped == ["Colour"] and list(got["netprofit"]) == [1500.0, 900.0]
    assert got["profitfactor"].isna().tolist() == [False, True] and list(got["maxdrawdownpct"]) == [8.2, 11.4]


CONFIG = """<?xml version="1.0" encoding="UTF-8"?>
<Task type="Build" version="139"><Settings>
<Options><BuildTradingOptions><Params><Param key="LimitTimeRange">true</Param><Param key="SignalTimeRangeFrom">28800</Param>
<Param key="SignalTimeRangeTo">36000</Param><Param key="Lots">0.5</Param></Params></BuildTradingOptions></Options>
<WhatToBuild><StrategyType type="simple"/><MarketSides type="short"/><SLPTOptions><SLRequired>true</SLRequired><MinPTInPips>100</MinPTInPips></SLPTOptions></WhatToBuild>
<Data><Setups><Setup dateFrom="2018.01.01" dateTo="2020.06.01"><Chart symbol="NAS" timeframe="H1"/><Chart symbol="US30"/></Setup></Setups>
<OutOfSample><Range dateFrom="2018.02.01" dateTo="2018.03.01" type="oos"/><Range dateFrom="2019.01.01" dateTo="2019.12.01"/></OutOfSample></Data>
<Rankings type="a"><MaxStrategies>50</MaxStrategies><Conditions><Condition use="true"><Left-Side valueType="c"><Column-Value column="Profit Factor"/></Left-Side>
<Comparator value="&gt;="/><Right-Side valueType="n"><Numeric-Value value="1.3"/></Right-Side></Condition></Conditions></Rankings>
<CrossChecks use="true"><MonteCarloRetest use="true"/><WhatIf use="false"/></CrossChecks>
<Blocks><BuildingBlocks><Block key="RSI" category="indicators" use="true" weight="2"><Generated><Param key="#P#" name="Period" type="int" minValue="5" maxValue="20">14</Param>
<Param key="#N#" paramType="null">1</Param></Generated></Block><Block key="CCI" category="indicators" use="false"/></BuildingBlocks>
<ExitTypes><Block key="ExitAfterBars" use="true" probability="50"/></ExitTypes></Blocks><Strange><x/></Strange></Settings></Task>"""
BLOCKS = """<s:Blocks xmlns:s="urn:x" type="simple" version="1"><s:BuildingBlocks><s:Block key="EMA" category="c" use="true"><s:Generated>
<s:Param key="#P#" minValue="-1000001" maxValue="9"/><s:Param key="#Q#" minValue="1" maxValue="9"/></s:Generated></s:Block></s:BuildingBlocks></s:Blocks>"""
PROJECT = """<Project name="p" version="1"><Databanks><Databank name="R" position="1"/></Databanks><Tasks>
<Task type="Build" name="Build 1" active="true" taskXMLFile="b.xml"/><Task type="Retest" name="Retest 1" active="true" taskXMLFile="r.xml"/>
<Task type="GoToTask" name="Go" active="true" taskXMLFile="g.xml"/></Tasks></Project>"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")

    def archive(name, members):
        with zipfile.ZipFile(root / name, "w") as z:
            for member, text in members.items():
                z.writestr(member, text)

    archive("a.cfx", {"config.xml": CONFIG})
    archive("b.sqb", {"config.xml": BLOCKS})
    archive("c.cfx", {
        "config.xml": PROJECT, "b.xml": '<Settings><Databanks><Databank name="Output" value="R1"/></Databanks></Settings>',
        "r.xml": '<T><Settings><Databanks><Databank name="Input" value="R2"/></Databanks><CrossChecks use="true"><WhatIf use="true"/></CrossChecks></Settings></T>',
        "g.xml": '<T><Settings><GoToTask task="Nowhere"/></Settings></T>',
    })
    archive("d.zip", {"readme.txt": "x"})
    (root / "e.cfx").write_bytes(b"not a zip")
    return str(root)


def test_archive_kinds(spark, corpus):
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.type, r.error) for r in archives.archive_kinds(archives.read_archives(spark, corpus)).collect()}
    assert got == {
        "a.cfx": ("builder", "build", None), "b.sqb": ("blocks", None, None), "c.cfx": ("project", None, None),
        "d.zip": ("unknown", None, "no XML member"), "e.cfx": ("unknown", None, "not a ZIP archive"),
    }


def test_config_tables(spark, corpus):
    docs = archives.read_archives(spark, corpus).filter(F.col("path").endswith("a.cfx")).select(F.lit("a").alias("config_id"), "xml")
    parsed = archives.parse_configs(docs)
    assert tuple(archives.config_table(parsed).first()) == ("a", "build", "139", "simple", "short", "a", "50")
    assert [(r.key, r.inferred_type) for r in archives.option_table(parsed).collect()] == [
        ("LimitTimeRange", "bool"), ("SignalTimeRangeFrom", "int"), ("SignalTimeRangeTo", "int"), ("Lots", "float")]
    assert {r.key: r.value for r in archives.slpt_table(parsed).collect()} == {"SLRequired": "true", "MinPTInPips": "100"}
    blocks, params = archives.block_table(parsed), archives.block_param_table(parsed)
    assert [(r.container, r.key, r.use, r.weight) for r in blocks.orderBy("container", "block_idx").collect()] == [
        ("building", "RSI", True, 2.0), ("building", "CCI", False, 1.0), ("exit", "ExitAfterBars", True, 1.0)]
    found = configs.distinct_indicators(blocks.filter("container = 'building'"), params).first()
    assert found.key == "RSI" and [tuple(p) for p in found.params] == [("#P#", "Period", "14")]
    assert tuple(configs.ranking_thresholds(archives.condition_table(parsed)).first()) == ("a", "profitfactor", ">=", 1.3)
    assert [r.checks for r in configs.enabled_checks(archives.cross_check_table(parsed)).collect()] == [["MonteCarloRetest"]]
    assert [r.types for r in configs.enabled_types(blocks).collect()] == [["ExitAfterBars@50"]]
    codes = {r.code for r in configs.date_findings(archives.setup_table(parsed), archives.range_table(parsed)).collect()}
    assert codes == {"in_sample_short", "gap_between_ranges", "range_very_short", "walk_forward_ranges"}
    assert archives.setup_table(parsed).first().symbols == ["NAS", "US30"]
    assert "time_range_short" in {r.code for r in configs.option_findings(archives.option_table(parsed)).collect()}


def test_block_files_ignore_namespaces(spark):
    docs = spark.createDataFrame([("b", BLOCKS)], "config_id string, xml string")
    parsed = archives.parse_block_files(docs)
    listing = configs.catalogue_listing(archives.block_param_table(parsed, "doc"), archives.block_table(parsed, "doc")).first()
    assert listing.key == "EMA" and listing.params == ["#P#:=", "#Q#:=1..9"]


def test_project_tables(spark, corpus):
    members = archives.read_archives(spark, corpus).filter(F.col("path").endswith("c.cfx"))
    t = archives.project_tables(members)
    tasks = frame(t["task"], "task_idx")
    assert list(tasks["type"]) == ["Build", "Retest", "GoToTask"] and list(tasks["cross_check"]) == [False, True, False]
    found = configs.workflow_findings(t["task"], t["task_databank"], t["task_range"], t["task_option"])
    got = sorted((r.task_idx, r.code) for r in found.collect())
    assert got == [(1, "databank_mismatch"), (1, "template_missing"), (2, "retest_without_filter"), (3, "goto_missing")]


def test_second_parameter_spelling_and_malformed_documents(spark):
    second = CONFIG.replace("<Param key=\"Lots\">0.5</Param>", "<Parameter key=\"Lots\">0.5</Parameter>").replace(
        "<Param key=\"#N#\" paramType=\"null\">1</Param>", "<Parameter key=\"#N#\" paramType=\"null\">1</Parameter>")
    docs = spark.createDataFrame([("a", CONFIG), ("b", second), ("c", CONFIG[:-30]), ("d", "no xml"), ("e", None)], "config_id string, xml string")
    parsed = archives.parse_configs(docs)
    assert [r.config_id for r in archives.malformed(parsed).orderBy("config_id").collect()] == ["c", "d", "e"]
    tables = {k: sorted((tuple(r)[1:] for r in t(parsed).collect() if r.config_id == k), key=str) for k in "ab" for t in [archives.option_table]}
    assert tables["a"] == tables["b"] and len(tables["a"]) == 4
    params = [sorted((tuple(r)[5:] for r in archives.block_param_table(parsed).collect() if r.config_id == k), key=str) for k in "ab"]
    assert params[0] == params[1] and len(params[0]) == 2


def test_unreadable_members_are_rows(spark, tmp_path):
    import io
    import zipfile

    def made(name, data):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(name, data)
        return bytearray(buffer.getvalue())

    latin = made("config.xml", '<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>'.encode("latin-1"))
    wide = made("config.xml", "<a>é</a>".encode("utf-16"))
    damaged = made("config.xml", b"<a>some text that is long enough</a>")
    at = damaged.index(b"some text")
    damaged[at: at + 4] = b"XXXX"
    odd = made("config.xml", b'<?xml version="1.0" encoding="klingon"?><a/>')
    for k, data in enumerate([latin, wide, damaged, odd, b"junk"]):
        (tmp_path / f"{k}.cfx").write_bytes(bytes(data))
    got = {r.path[-5]: r for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert "é" in got["0"].xml and "é" in got["1"].xml
    assert [got[k].error for k in "234"] == ["unreadable member", "unknown encoding", "not a ZIP archive"]


def test_append_prunes_the_store_to_the_months_of_the_batch(spark, tmp_path, capsys):
    store = str(tmp_path / "bars")
    bars = as_bars(spark, walk(3000, 3))
    src.write_bars(bars, store)
    months = {p.name for p in (tmp_path / "bars").glob("series_id=A/*")}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bars").rglob("*.parquet")}
    last = bars.agg(F.max("ts")).first()[0]
    batch = bars.filter(F.col("ts") == F.lit(last)).withColumn("close", F.lit(1.0))
    src.append_bars(spark, batch, store)
    stored = spark.read.parquet(store)
    assert stored.count() == 3000 and stored.filter("close = 1.0").count() == 1
    kept = [p for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t]
    assert len(months) > 3 and len(kept) == len(before) - sum(f"month={last:%Y-%m}" in str(p) for p in before)


def test_stream_starts_on_an_empty_folder(spark, tmp_path):
    from tickloom.streaming.landing import has_bars, merge_batch

    store = tmp_path / "bars"
    assert not has_bars(spark, str(store))
    store.mkdir()
    assert not has_bars(spark, str(store))
    merge_batch(spark, as_bars(spark, walk(20, 3)), str(store))
    assert has_bars(spark, str(store))


def test_rolled_bars_take_late_events_and_replays(spark, tmp_path):
    """Late events change stored bars as long as the watermark lets them; what is later is dropped; a replay changes nothing."""
    base, minutes = datetime.datetime(2024, 1, 1), lambda k: datetime.timedelta(minutes=k)
    events = [(k, "A", base + minutes(7 * k), float((37 * k) % 101)) for k in range(300)]
    late, too_late = [(900, "A", base + minutes(1700), 500.0), (901, "A", base + minutes(1701), -5.0)], [(902, "A", base, 9999.0)]
    shape = "event_id long, event_type string, ts timestamp_ntz, value double"
    path = str(tmp_path)

    def arrive(rows, progress="progress"):
        if rows:
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{path}/events")
        stream = spark.readStream.schema(shape).parquet(f"{path}/events")
        start_rollup(rolled_bars(stream, "event_type", "ts", "value", "event_id", delay="10 hours"), f"{path}/bars", f"{path}/{progress}").awaitTermination()
        return frame(src.read_bars(spark, f"{path}/bars"), "series_id", "ts")

    def batch(rows):
        return frame(src.bars_from_events(spark.createDataFrame(rows, shape), "event_type", "ts", "value", "event_id"), "series_id", "ts")

    pd.testing.assert_frame_equal(arrive(events), batch(events), check_dtype=False)
    pd.testing.assert_frame_equal(arrive(late), batch(events + late), check_dtype=False)
    pd.testing.assert_frame_equal(arrive(too_late), batch(events + late), check_dtype=False)
    assert len(spark.read.parquet(f"{path}/events").collect()) == 303
    again = arrive([], "another")  # all files at once, from the start
    pd.testing.assert_frame_equal(again, batch(events + late + too_late), check_dtype=False)


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    from tickloom import session

    before = len([p for p in pathlib.Path(session.run_folder(spark).removeprefix("file:")).glob("stored-*")])
    df = session.materialise(spark.range(5))
    assert df.count() == 5
    first = tmp_path / "bars"
    pdf = walk(50, 3)
    src.write_bars(as_bars(spark, pdf), str(first))
    src.append_bars(spark, as_bars(spark, pdf.tail(5)), str(first))  # leaves nothing behind
    folder = pathlib.Path(session.run_folder(spark).removeprefix("file:"))
    assert len(list(folder.glob("stored-*"))) == before + 1
    assert session.remove_folder(spark, df.inputFiles()[0].rsplit("/", 1)[0]) and not session.remove_folder(spark, f"{tmp_path}/none")
    assert len(list(folder.glob("stored-*"))) == before


def test_workflow_documents_are_parsed_once(spark, corpus, monkeypatch, capsys):
    plans, stored = [], archives.materialise

    def seen(df, *by):
        df.explain()
        plans.append(capsys.readouterr().out)
        return stored(df, *by)

    monkeypatch.setattr(archives, "materialise", seen)
    members = archives.read_archives(spark, corpus).filter(F.col("path").endswith("c.cfx"))
    made = archives.project_tables(members)
    for table in made.values():
        table.explain()
        assert "from_xml" not in (plan := capsys.readouterr().out) and "BroadcastHashJoin" not in plan
    assert len(plans) == 2 and made["task"].count() == 3
    physical = [p.split("== Initial Plan ==")[0] for p in plans]
    assert all(p.count("from_xml") == 1 for p in physical)
