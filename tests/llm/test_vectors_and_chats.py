"""Vector links, tool calls and components against brute force, with odd rows and empty tables."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat_tools, components, vector_join


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, k) for k in range(6000, 6050)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    loops = {v for v in parent if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: root(v) for v in parent if v not in loops}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def vectors(n=400, width=8):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, width))
    for k in range(0, n, 5):
        x[k + 1] = x[k] + rng.normal(size=width) * 0.15
    rows = [(k, [float(np.float32(v)) for v in x[k]]) for k in range(n)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, []), (1004, [0.0] * width), (1005, [float("nan")] * width),
             (1006, [None] + [1.0] * (width - 1)), (1007, [float("inf")] + [1.0] * (width - 1)), (1008, [1.0, 2.0]), (1009, [1.0, 2.0]), (None, rows[5][1]),
             (1010, [3 * v for v in rows[7][1]]), (1011, [-0.0, 1.0]), (1012, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, rep string, cell int")
    got = vector_join.link_vectors(frame).collect()
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.asarray(np.asarray(rows[k][1], np.float32), float) for k in ok}
    near = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            u, v = unit[a], unit[b]
            if a != b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                near[a].append(b)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        reach, queue = {k}, [k]
        while queue:
            for j in near[queue.pop()]:
                if j not in reach:
                    reach.add(j)
                    queue.append(j)
        names = [rows[j][0] for j in reach if rows[j][0] is not None]
        want[i, len(near[k]), min(names) if names else None] += 1
    have = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum((have & want).values()) >= 0.97 * len(rows) and len(got) == len(rows)
    for i in (1000, 1002, 1003, 1004, 1005, 1006, 1007, 1008, 1011):
        assert [x for x in have if x[0] == i] == [x for x in want if x[0] == i]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert sum(n * c for (_, n, _), c in have.items()) >= 0.95 * sum(n * c for (_, n, _), c in want.items())


def test_grid_is_coarser_where_the_visits_miss_the_recall(monkeypatch):
    monkeypatch.setattr(vector_join, "MAX_VISITS", 16)
    rng = np.random.default_rng(6)
    sample = vector_join.unit(rng.normal(size=(2000, 16)))
    index = vector_join.MultiIndex(sample, 1 << 25, 0.9, 0.98)
    other = rng.normal(size=sample.shape)
    other -= (other * sample).sum(1)[:, None] * sample
    other = 0.91 * sample + np.sqrt(1 - 0.91 ** 2) * vector_join.unit(other)

    def meet(a, b):
        return (index.cells(a, index.visits) == index.cells(b, 1)).any(1)

    assert (meet(sample, other) | meet(other, sample)).mean() >= 0.96 and index.visits <= 16


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_join.link_vectors(empty).count() == 0
    assert vector_join.link_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].n_links == 0


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(3)
    left, right = rng.random((20, 9)), rng.random((20, 7))
    got = vector_join.traverse(left, right, 12)
    for k in range(20):
        total = (left[k][:, None] + right[k][None, :]).ravel()
        assert np.allclose(total[got[k]], np.sort(total)[:12])


SCHEMA = json.dumps({"type": "object", "required": ["q"], "additionalProperties": False, "properties": {
    "q": {"type": ["string", "object"], "minLength": 1}, "n": {"type": "integer", "minimum": 0, "maximum": 9}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}})


def called(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def answer(i, text):
    return json.dumps({"tool_call_id": i, "content": text})


@pytest.fixture(scope="module")
def chat(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", called(("a", "find", {"q": "é \"x\"\n", "n": 3}), ("b", "find", {"q": {"$result": "a"}}))),
        (1, 2, "tool", answer("a", "ok")), (1, 3, "tool", answer("zz", "who asked")), (1, 4, "assistant", called(("a", "find", {"q": "again"}))),
        (2, 0, "assistant", called(("x", "find", {"q": {"$result": "y"}}), ("y", "find", {"q": {"$result": "z"}}), ("z", "find", {"q": "1"}))),
        (2, 1, "tool", answer("z", "1")), (2, 2, "tool", answer("y", "2")), (2, 3, "tool", answer("x", "3")),
        (3, 0, "assistant", called(("p", "find", {"q": {"$result": "q"}}), ("q", "find", {"q": {"$result": "p"}}))),
        (4, 0, "assistant", called(("m", "none", {}), ("n", "find", {"q": "", "n": 12, "tags": ["a", "c"], "more": 1}), (None, "find", {"q": "k"}))),
        (4, 1, "tool", None), (4, 2, "assistant", ""), (4, 3, "assistant", '{"tool_calls": [broken'), (5, 0, None, "x"), (None, 0, "assistant", called(("a", "find", {"q": "s"}))),
        (None, 1, "tool", answer("a", "t")),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))


def linked(spark, messages):
    schemas = spark.createDataFrame([("find", SCHEMA), (None, "{}")], "name string, schema string")
    return chat_tools.linked_tools(chat_tools.tool_calls(messages), chat_tools.tool_results(messages), schemas)


def test_tool_calls(spark, chat):
    rows = linked(spark, chat).collect()
    by = {(r.conv_id, r.call_id, r.turn): r for r in rows}
    assert by[1, "a", 1].status == "linked" and by[1, "a", 1].valid and by[1, "a", 1].result_turn == 2
    assert by[1, "a", 1].json == '{"arguments":{"n":3,"q":"é \\"x\\"\\n"},"id":"a","name":"find","result":"ok","status":"linked"}'
    assert by[1, "a", 4].status == "unanswered" and by[1, "zz", None].status == "orphan" and by[1, "zz", None].valid is None
    assert [by[2, k, 0].level for k in "xyz"] == [2, 1, 0] and by[1, "b", 1].level == 1 and by[1, "a", 1].level == 0
    assert by[3, "p", 0].level is None and by[3, "q", 0].level is None
    assert by[4, "m", 0].errors == "unknown tool" and by[4, None, 0].status == "unanswered"
    assert by[4, "n", 0].errors == "$.more: unknown; $.n: out of bounds; $.q: too short; $.tags[1]: not allowed"
    assert Counter(r.status for r in rows if r.conv_id is None) == {"unanswered": 1, "orphan": 1}
    assert len(rows) == 14


def test_levels_match_a_walk(spark):
    """Random references, back, ahead, to unknown calls and in cycles, against a depth-first walk."""
    rng = np.random.default_rng(11)
    needs = {c: {f"k{i}": sorted({f"k{x}" for x in rng.integers(0, 14, rng.integers(0, 3))}) for i in range(12)} for c in range(40)}
    rows = [(c, i, "assistant", called((name, "find", {"q": [{"$result": x} for x in wanted]}))) for c, of in needs.items() for i, (name, wanted) in enumerate(of.items())]
    rows += [(100, i, "assistant", called((f"k{i}", "find", {"q": {"$result": f"k{i - 1}"}}))) for i in range(1, 9)]
    needs[100] = {f"k{i}": [f"k{i - 1}"] for i in range(1, 9)}

    def level(c, name, above=()):
        if name in above:
            return None
        below = [level(c, x, (*above, name)) for x in needs[c][name] if x in needs[c]]
        return None if None in below else 1 + max(below) if below else 0

    got = linked(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == {(c, name): level(c, name) for c in needs for name in needs[c]}
    assert {r.level for r in got} >= {None, 0, 1, 2, 7}


def test_no_tool_calls(spark, chat):
    assert linked(spark, chat.where("false")).count() == 0
    assert linked(spark, chat.where("role = 'user'")).count() == 0


def test_canonical_json_ignores_key_order():
    assert chat_tools.canonical({"b": 1, "a": {"d": [1.5, None], "c": True}}) == chat_tools.canonical({"a": {"c": True, "d": [1.5, None]}, "b": 1}) == '{"a":{"c":true,"d":[1.5,null]},"b":1}'
