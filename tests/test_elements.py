"""The element table holds whole documents; typed sections, stress tests and time stops read from it."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tickloom.operators import costs
from tickloom.sources import archives, bars as bar_files, elements as el

ODD = """<?xml version="1.0" encoding="utf-16"?><!-- c --><t:A xmlns:t="urn:u" a="1" t:b="&lt;2&gt;">hi<Settings q="">
  <B/>mid &amp; more<B>b<!-- c -->x<C>1</C>y<C k="v">2</C>z</B>tail</Settings>end</t:A>"""


def rebuilt(rows):
    """An element tree from the rows of one document."""
    made = {}
    for r in sorted(rows, key=lambda r: r.dewey):
        name = f"{{{r.space}}}{r.tag}" if r.space else r.tag
        above = made.get(tuple(r.dewey[:-1]))
        node = ET.Element(name, dict(r.attributes)) if above is None else ET.SubElement(above, name, dict(r.attributes))
        node.text, node.tail = r.text, r.tail
        made[tuple(r.dewey)] = node
    return made[(1,)]


def same_tree(a, b):
    return (a.tag, a.attrib, a.text or "", a.tail or "") == (b.tag, b.attrib, b.text or "", b.tail or "") and len(a) == len(b) and all(
        same_tree(x, y) for x, y in zip(a, b))


def random_document(rng, depth=0):
    node = ET.Element(rng.choice(["Settings", "Block", "Param", "x-y"]), {rng.choice("abc"): rng.choice(["", "1", "<&\"é"]) for _ in range(rng.randint(0, 3))})
    node.text = rng.choice([None, "t", " \n", "中 & <"])
    for _ in range(rng.randint(0, 4) if depth < 4 else 0):
        child = random_document(rng, depth + 1)
        child.tail = rng.choice([None, "tail", "\n  "])
        node.append(child)
    return node


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(3)
    texts = [ET.tostring(random_document(rng), encoding="unicode") for _ in range(60)]
    wide = "<a>" + "".join(f"<b n='{k}'/>" for k in range(20_000)) + "</a>"
    deep = "".join(f"<d{k}>" for k in range(300)) + "".join(f"</d{k}>" for k in reversed(range(300)))
    return [ODD, wide, deep, *texts]


def test_documents_can_be_written_again(spark, documents):
    rows = [(k, x) for k, x in enumerate(documents)] + [(-1, None), (-2, "<a><b></a>"), (-3, ""), (-4, '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')]
    table = el.element_table(spark.createDataFrame(rows, "config_id int, xml string")).cache()
    by = {}
    for r in table.where("error is null").collect():
        by.setdefault(r.config_id, []).append(r)
    assert set(by) == set(range(len(documents)))
    for k, x in enumerate(documents):
        want = ET.fromstring(x.split("?>", 1)[1] if x.startswith("<?xml") else x)
        assert same_tree(rebuilt(by[k]), want)
    assert {r.config_id: r.error for r in el.errors(table).collect()} == {-2: "malformed XML", -3: "malformed XML", -4: "entity declarations are refused"}
    counted = el.census(table).groupBy("config_id").agg(F.sum("n").alias("n"), F.sum("n_attributes").alias("a")).collect()
    assert {r.config_id: (r.n, r.a) for r in counted} == {
        k: (len(list(t.iter())), sum(len(e.attrib) for e in t.iter())) for k, t in ((k, rebuilt(by[k])) for k in by)}
    assert el.attribute_table(table).count() == sum(r.a for r in counted)


def test_ids_of_any_name_and_empty_tables(spark):
    docs = spark.createDataFrame([("p", "m.xml", "<a/>", "x")], "path string, member string, xml string, place_ string")
    assert el.element_table(docs, ids=("path", "member")).select("path", "member", "tag").first() == ("p", "m.xml", "a")
    assert el.element_table(docs.where("false"), ids=("path",)).count() == 0


CONFIG = """<Task type="Build"><Settings>
<WhatToBuild><BuildMode generationType="g"><PopulationSize> 50 </PopulationSize><Conditions><Condition/></Conditions><EvoInSamplePeriod ratio="3"/></BuildMode></WhatToBuild>
<RiskMoneyManagement><MoneyManagement><Method type="Fixed" use="true"><Params><Param key="L" name="Lots">0.5</Param></Params></Method>
<Method type="Pct"><Parameter key="R">2</Parameter></Method><Method type="None"/><InitialCapital>10</InitialCapital></MoneyManagement></RiskMoneyManagement>
<PartsToImprove><EntryRules symmetry="true"><LongImprovement use="true" action="add"/></EntryRules><Other/></PartsToImprove>
<Notes>  a note
 </Notes><Databanks><Databank name="a"/><Databank name="b" value="v"/></Databanks>
<Rankings><FitnessCriteria method="m"><Settings><Ranking type="one"/><Ranking type="two"/></Settings></FitnessCriteria></Rankings>
<CrossChecks><WhatIf use="true"><AcceptanceSettings><Max value="3">x</Max></AcceptanceSettings><Else/></WhatIf></CrossChecks>
<Strange a="1"><y>z</y></Strange></Settings><Outside/></Task>"""


def test_sections(spark):
    e = el.element_table(spark.createDataFrame([(1, CONFIG), (2, "<Settings><Notes>n</Notes></Settings>"), (3, "<Other/>")], "config_id int, xml string")).cache()

    def rows(df):
        return sorted(map(tuple, df.drop("config_id").collect()), key=repr)

    assert rows(el.money_methods(e)) == [(0, "Fixed", True, "L", "Lots", "0.5", "float"), (1, "Pct", False, "R", "R", "2", "int"), (2, "None", False, None, None, None, None)]
    assert rows(el.risk_settings(e)) == [("initial_capital", "10")]
    assert rows(el.build_mode(e)) == [("EvoInSamplePeriod.ratio", "3"), ("PopulationSize", "50"), ("generationType", "g")]
    assert rows(el.parts_to_improve(e)) == [("EntryRules", "true", "long", True, "add")]
    assert {r.config_id: r.notes for r in el.notes(e).collect()} == {1: "a note", 2: "n"}
    assert [r[1:3] + r[4:] for r in sorted(map(tuple, el.databanks(e).collect()))] == [(0, "", "", False), (1, "", "v", False)]
    assert rows(el.fitness(e)) == [("m", "false", "two")]
    assert [r[:3] + r[4:] for r in rows(el.check_settings(e))] == [("WhatIf", "AcceptanceSettings", "Max", "", "x"), ("WhatIf", "AcceptanceSettings", "Max", "value", "3")]
    assert [(r.place, r.section) for r in el.raw_sections(e).orderBy("dewey").collect()] == [("Strange", "Strange"), ("Strange/y", "Strange")]


def stress(*tests):
    return f"<Task><Settings><CrossChecks>{''.join(tests)}</CrossChecks></Settings></Task>"


def spread(low, high, use="true", kind="RandomizeSpread"):
    limits = "".join(f'<Param key="{k}">{v}</Param>' for k, v in (("Min", low), ("Max", high)) if v is not None)
    return f'<Method type="{kind}" use="{use}"><Params>{limits}</Params></Method>'


def test_stress_ranges(spark):
    def test(*methods, use="true"):
        return f'<MonteCarloRetest use="{use}"><Settings>{"".join(methods)}</Settings></MonteCarloRetest>'

    docs = [
        (1, stress(test(spread(9, 9), use="false"), test(spread(1, 8, use="false"), spread(1, 7, kind="Other"), spread(2, None), spread(3, 5), spread(4, 6)))),
        (2, stress(test(spread(1, 2)), test(spread(8, 9)))), (3, stress(test(spread(1, "")))), (4, stress(spread(1, 2))), (5, stress(f"<X>{test(spread('0.5', '1.5'))}</X>")),
    ]
    e = el.element_table(spark.createDataFrame(docs, "config_id int, xml string"))
    assert sorted(map(tuple, el.stress_ranges(e).collect())) == [(1, 3.0, 5.0), (2, 1.0, 2.0), (5, 0.5, 1.5)]


def test_time_stops_of_documents(spark):
    def exits(*limits):
        return "<a>" + "".join(f'<Param key="#ExitAfterBars.ExitAfterBars#" minValue="{a}" maxValue="{b}"/>' for a, b in limits) + "</a>"

    docs = [(1, exits(("x", 5), (1, 9), (1, 20))), (2, exits()), (3, exits((0, 4)))]
    e = el.element_table(spark.createDataFrame(docs, "config_id int, xml string"))
    assert sorted(map(tuple, el.exit_bars(e).collect())) == [(1, 9), (3, 4)]


def test_bars_left_before_the_next_close(spark):
    days = [*costs.WEEKDAYS, *costs.WEEKEND]
    sessions = [("around", d, 0, 1440) for d in days] + [("day", d, 480, 1200) for d in days[:5]] + [("split", d, a, b) for d in days[:4] for a, b in ((60, 600), (600, 720), (900, 1440))]
    sessions += [("night", d, 1320, 1440) for d in days[:5]] + [("night", d, 0, 1260) for d in days[:6]] + [("day", "Mon", 480, 1200)]
    windows = [("around", 28800, 36000), ("day", 28800, 36000), ("split", 3600, 36000), ("night", 28800, 72000), ("none", 1, 2)]
    got = costs.time_stop_reach(spark.createDataFrame(windows, "symbol string, window_from int, window_to int"),
                                spark.createDataFrame(sessions, "symbol string, day string, from_min int, to_min int")).collect()
    left = {(r.symbol, r.day): r.bars_left for r in got}
    for symbol, _, end in windows[:4]:
        open_minutes = {days.index(d) * 1440 + m for s, d, a, b in sessions if s == symbol for m in range(a, b)}
        for k, d in enumerate(costs.WEEKDAYS):
            at, n = k * 1440 + end // 60, 0
            while (at + n) % costs.WEEK in open_minutes and n < 2 * costs.WEEK:
                n += 1
            if symbol == "around":  # never closes
                assert left[symbol, d] >= 7 * 24
            else:
                assert left[symbol, d] == (n // 60 if at % costs.WEEK in open_minutes else None), (symbol, d)
    stops = spark.createDataFrame([("day", 4), ("day2", 4), ("night", 0)], "symbol string, max_exit_bars int")
    rows = costs.notice_time_stop(stops, spark.createDataFrame(windows, "symbol string, window_from int, window_to int"),
                                  spark.createDataFrame(sessions, "symbol string, day string, from_min int, to_min int")).collect()
    assert [(r.symbol, r.severity, r.value, r.limit) for r in rows] == [("day", "info", 4.0, 10.0)]


def test_trade_numbers_follow_files_and_lines(spark, tmp_path):
    for name, numbers in (("b.txt", range(100, 200)), ("a.txt", range(100)), ("c.txt", range(200, 230))):
        (tmp_path / name).write_text("\n".join(map(str, numbers)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = bar_files.read_trade_numbers(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.seq, r.r) for r in got] == [(k, float(k)) for k in range(230)]


def test_members_come_one_at_a_time(spark):
    assert archives.unpacked(spark.createDataFrame([("x", bytearray(b"no"))], "path string, content binary")).first().error == "not a ZIP archive"


def test_short_documents_share_a_batch(spark, monkeypatch):
    """Long and short documents give the same rows; short ones do not cost an Arrow batch each."""
    import pyarrow as pa

    docs = [(k, f"<a n='{k}'>" + "<b>x</b>y" * (k % 5) + ("</a>" if k % 7 else "")) for k in range(300)]
    picked = pa.RecordBatch.from_pydict({"k0": pa.array([d[0] for d in docs], pa.int32()), "xml": [d[1] for d in docs]})
    e = el.element_table(spark.createDataFrame(docs, "config_id int, xml string"))
    got = sorted((r.config_id, r.error or "", r.place or "", r.tag or "", tuple(r.dewey or ())) for r in e.collect())
    want = sorted((k, r[7] or "", r[1] or "", r[2] or "", tuple(r[0] or ())) for k, x in docs for rows in el._document_rows(x) for r in rows)
    assert got == want
    monkeypatch.setattr(el, "_SHORT", 0)  # walked after a first pass, as long ones are
    assert sorted((k, r[7] or "", r[1] or "", r[2] or "", tuple(r[0] or ())) for k, x in docs for rows in el._document_rows(x) for r in rows) == want

    runs, frame = [], spark.createDataFrame(docs, "config_id int, xml string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda _, run, shape: runs.append(run) or spark.createDataFrame([], shape))
    el.element_table(frame)
    made = list(runs[0]([picked]))
    assert len(made) == 1 and made[0].num_rows == len(want)


def test_session_texts_are_made_once(spark, tmp_path, capsys):
    """No filter repeats the texts that the sessions are read from."""
    from tickloom.plans import costs as plans

    spark.sql("select 1L l_partkey, timestamp'2000-01-03' l_shipdate, 3 l_linenumber, 9.0D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spans = costs.open_spans(plans.sessions(spark, str(tmp_path)))
    spans.explain()
    plan = capsys.readouterr().out
    assert plan.count("format_string") <= 1 and plan.count("date_format") <= 1
    assert [(r.opens, r.closes) for r in spans.orderBy("opens").collect()] == [(390, 585), (390 + costs.WEEK, 585 + costs.WEEK)]
