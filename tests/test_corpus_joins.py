"""Stored tables of a few megabytes may hold many rows: their joins are never broadcast by the size of the files."""

import pytest
from pyspark.sql import Row

from tickloom.plans import configs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    lines = [Row(l_orderkey=i // 3, l_partkey=i % 7, l_suppkey=i % 4, l_linenumber=1 + i % 3, l_quantity=float(i % 40), l_extendedprice=float(i),
                 l_discount=(i % 10) / 100, l_tax=(i % 8) / 100, l_returnflag="ANR"[i % 3], l_linestatus="O") for i in range(120)]
    frame = spark.createDataFrame(lines).selectExpr("*", "timestamp'2000-01-01' as l_shipdate")
    frame.write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, f"n{k}", f"Brand#{k % 4}", f"T{k % 2}") for k in range(7)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, k) for k in range(5)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def broadcast(plan):
    """Joins by the keys of blocks that go through the driver."""
    return [x for x in plan.splitlines() if "BroadcastHashJoin" in x and any(k in x for k in ("container", "block_key", "block_idx"))]


@pytest.mark.parametrize("name", ["catalogue_listing", "distinct_indicators", "params"])
def test_block_joins_are_not_broadcast(spark, tables, name, capsys):
    made = getattr(configs, name)(spark, tables)
    made.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and not broadcast(plan)
    assert made.count() > 0


def test_documents_are_built_without_a_broadcast(spark, tables, monkeypatch, capsys):
    plans = []

    def seen(df, *by):
        df.explain()
        plans.append(capsys.readouterr().out)
        return stored(df, *by)

    stored = configs.materialise
    monkeypatch.setattr(configs, "materialise", seen)
    assert configs.ingest_params(spark, tables).count() == 120
    assert any("SortMergeJoin" in p for p in plans) and not any(map(broadcast, plans))
    assert sum("max(l_discount" in p for p in plans) == 1  # the blocks are derived once


def test_settings_are_parsed_once(spark, tables, monkeypatch, capsys):
    plans = []

    def seen(df, *by):
        df.explain()
        plans.append(capsys.readouterr().out.split("== Initial Plan ==")[0])
        return stored(df, *by)

    stored = configs.materialise
    monkeypatch.setattr(configs, "materialise", seen)
    made = configs.ingest_settings(spark, tables)
    made.explain()
    assert "from_xml" not in capsys.readouterr().out and sum(p.count("from_xml") for p in plans) == 1
    # the parameters are numbered once for all containers
    documents = next(p for p in plans if "from_xml" in p)
    assert documents.count("row_number") == 1 and not broadcast(documents)
    # what is read back is what the tables hold
    types = {"true": "bool", "false": "bool"}
    want = [(r.config_id, "option", r.key, f"{types.get(r.value, 'int')}:{r.value}") for r in configs.corpus(spark, tables, "options").collect()]
    want += [(r.config_id, "condition", r.column, f"{r.comparator}:{r.numeric}:{str(r.use).lower()}") for r in configs.corpus(spark, tables, "conditions").collect()]
    ranges = sorted(configs.corpus(spark, tables, "ranges").collect(), key=lambda r: (r.config_id, r.range_idx))
    want += [(r.config_id, "range", str(sum(q.config_id == r.config_id and q.range_idx < r.range_idx for q in ranges)), f"{r.date_from}:{r.date_to}") for r in ranges]
    assert len(want) > 50 and sorted(map(tuple, made.collect())) == sorted(want)


def test_documents_hold_all_blocks_and_parameters_in_order(spark, tables, monkeypatch):
    blocks = [(1, "building", 0, "a.b.c", "a"), (1, "building", 1, "a.b.c", "a.b"), (1, "building", 2, None, "x"), (1, "order", 0, "a.b.c", "o"),
              (1, "exit", 0, "none", "e"), (2, "exit", 0, "k", "e"), (None, "order", 0, "k", "o"), (9, "order", 0, "k", "o")]
    params = [(1, "building", "a.b.c", 1, "q"), (1, "building", "a.b.c", 10, "r"), (1, "building", "a.b.c", 2, "s"), (1, "building", "a.b.c", 1, "p"),
              (1, "building", "a.b.c", 1, "p"), (1, "building", "a.b.c", 3, None), (1, "building", None, 0, "lost"), (1, "order", "a.b.c", 0, "t"), (2, "building", "k", 0, "lost"), (None, "order", "k", 0, "lost")]
    made = {
        "blocks": spark.createDataFrame([(*b, 1.0, True, None) for b in blocks],
                                        "config_id long, container string, block_idx int, key string, category string, weight double, use boolean, probability string").hint("merge"),
        "block_params": spark.createDataFrame([(*p, p[4], "z", "v") for p in params], "config_id long, container string, block_key string, param_idx int, key string, name string, type string, value string"),
    }
    plain = configs.corpus
    monkeypatch.setattr(configs, "corpus", lambda spark, sf, name, *shared: made[name] if name in made else plain(spark, sf, name, *shared))
    xml = {r.config_id: r.xml for r in configs.corpus_xml(spark, tables).collect()}

    def block(key, category, *keys):
        held = "".join(f'<Param key="{k}" name="{k}" type="z">v</Param>' for k in keys)
        return f'<Block key="{key}" category="{category}" weight="1.0" use="true" probability=""><Generated>{held}</Generated></Block>'

    one = block("a.b.c", "a", *"ppqsr") + block("a.b.c", "a.b", *"ppqsr")
    assert sorted(xml) == [0, 1, 2, 3, 4]
    assert f"<BuildingBlocks>{one}</BuildingBlocks><OrderTypes>{block('a.b.c', 'o', 't')}</OrderTypes><ExitTypes>{block('none', 'e')}</ExitTypes>" in xml[1]
    assert f"<BuildingBlocks></BuildingBlocks><OrderTypes></OrderTypes><ExitTypes>{block('k', 'e')}</ExitTypes>" in xml[2]
    assert all("<BuildingBlocks></BuildingBlocks><OrderTypes></OrderTypes><ExitTypes></ExitTypes>" in xml[k] for k in (0, 3, 4))
