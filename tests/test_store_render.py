"""Snapshots and renderers."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import orphans, render, snapshots


def small(spark):
    return DependencyGraph.from_rows(spark, [{"class": "A", "method": "x"}, {"class": "B", "method": "y"}], [("A::x", "B::y"), ("A::x", "B::y", "static_call"), ("A::x", "B::__interface", "interface_implementation")])


def test_store(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/snaps")
    assert store.labels() == []
    for label in ("one", "two", "three"):
        store.save_graph(label, small(spark))
    store.save("one", "nodes", small(spark).nodes.limit(1))
    assert store.load_graph("one").nodes.count() == 1 and store.load_graph("two").edges.count() == 3
    assert {x for x, _ in store.labels()} == {"one", "two", "three"}
    assert len(store.keep_last(1)) == 2 and len(store.labels()) == 1 and store.older_than(10**15) and store.labels() == []
    calls = []
    for _ in range(2):
        assert store.report("k", "r", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]


def test_fingerprint_and_guard(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content string")
    assert snapshots.fingerprint(a) == snapshots.fingerprint(a.orderBy(F.desc("path"))) != snapshots.fingerprint(a.limit(1))
    frames = iter([a, a, a.limit(1)])
    with pytest.raises(RuntimeError):
        snapshots.checked(lambda: next(frames), lambda df: df)


def test_render(spark):
    g = small(spark)
    assert json.loads(render.to_json(g.nodes.select("id").orderBy("id"))) == [{"id": "A::x"}, {"id": "B::y"}]
    assert render.to_markdown(spark.createDataFrame([("a|b", None)], "x string, y int"), "T").splitlines()[-1] == "| a\\|b |  |"
    assert render.flowchart(g.edges.where("type <> 'interface_implementation'")).count("-->") == 1
    assert "n0 --> n1" in render.component_diagram(g) and "n1 <|.. n0" in render.class_diagram(g)
    assert "-->|http 2|" in render.service_diagram(spark.createDataFrame([("a", "b", "http", 2)], "from string, to string, type string, count long"))
    assert render.sequence_diagram(["a", "b"]).endswith("n0->>n1: call")
    assert render.orphan_report(orphans.orphans(g)).startswith("== ")
