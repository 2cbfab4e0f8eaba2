"""Operators on literal graphs."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import assemble, cycles, diff, iterate, layers, maps, metrics, orphans, risk
from graphloom.operators.query import FlowQuery, critical_paths, longest_path, trace


def graph(spark, edges, nodes=None, **more):
    """X->Y is an edge X::m -> Y::m; nodes are named or those of the edges."""
    full = lambda x: x if "::" in x or ":" in x else f"{x}::m"
    links = [(full(a), full(b), *rest) for a, b, *rest in edges]
    names = nodes if nodes is not None else list(dict.fromkeys(x for e in links for x in e[:2]))
    return DependencyGraph.from_rows(spark, [{"class": full(n).split("::")[0], "method": full(n).split("::")[1], **more.get(n, {})} for n in names], links)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_chain_has_no_cycle_and_counts_ancestors(spark):
    g = graph(spark, [("A", "B"), ("B", "C")])
    assert cycles.cycles(g).count() == 0
    assert rows(metrics.blast_radius(g), "id", "blast_radius") == [("A::m", 0), ("B::m", 1), ("C::m", 2)]


def test_cycles_and_severity(spark):
    g = graph(spark, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "E"), ("E", "C"), ("P::a", "P::b"), ("P::b", "P::a"), ("S", "S")])
    assert rows(cycles.cycles(g), "cycle_id", "size", "severity") == [("A::m", 2, "LOW"), ("C::m", 3, "MEDIUM"), ("P::a", 2, "INFO")]
    assert cycles.cycle_stats(cycles.cycles(g)).first()["members"] == 7
    assert cycles.in_cycle(cycles.cycles(g), "C::m", "E::m").first()[0] and not cycles.in_cycle(cycles.cycles(g), "A::m", "C::m").first()[0]


def test_hotspot_and_scores(spark):
    g = graph(spark, [(f"Caller{k}", "Hot") for k in range(11)])
    m = metrics.node_metrics(g)
    assert rows(metrics.hotspots(m), "id", "risk") == [("Hot::m", "HIGH")]
    assert metrics.top_coupled(m, 3).first()["id"] == "Hot::m"
    two = metrics.node_metrics(graph(spark, [("X", "B"), ("B", "X")]))
    assert rows(two, "complexity") == [(5,), (5,)]


@pytest.mark.parametrize(("blast", "level"), [(0, "HIGH"), (3, "CRITICAL"), (None, "CRITICAL")])
def test_risk_cap(spark, blast, level):
    df = spark.createDataFrame([(0, 16, blast)], "i long, o long, b long")
    assert df.select(metrics.risk_level(F.col("i"), F.col("o"), F.col("b"))).first()[0] == level


def test_self_loop_and_duplicates(spark):
    g = graph(spark, [("A", "A"), ("B", "C"), ("B", "C", "static_call")])
    f = {r["id"]: (r["fan_in"], r["fan_out"]) for r in metrics.fans(g).collect()}
    assert f == {"A::m": (1, 1), "B::m": (0, 2), "C::m": (2, 0)}
    q = FlowQuery(g)
    assert rows(q.entrypoints().to_df(), "id") == [("B::m",)] and rows(q.leaf_nodes().to_df(), "id") == [("C::m",)]
    assert rows(trace(g, "B::m").edges, "src", "dst", "type") == [("B::m", "C::m", "static_call")]


def test_trace(spark):
    g = graph(spark, [("Ctl::store", "Svc::save"), ("Svc::save", "Repo::put"), ("Svc::save", "Cache::items", "property_access")])
    assert trace(g, "Ctl::store").nodes.count() == 4
    assert trace(g, "Ctl::store", max_depth=1).nodes.count() == 2
    assert trace(g, "Repo::put", iterate.UP).nodes.count() == 3
    assert trace(g, "Svc::save", iterate.BOTH).nodes.count() == 4
    only = FlowQuery(g).from_("Ctl::store").downstream().only_method_calls().max_depth(5).trace()
    assert rows(only.nodes, "id") == [("Ctl::store",), ("Repo::put",), ("Svc::save",)]
    assert longest_path(only.paths).first()["path"] == ["Ctl::store", "Svc::save", "Repo::put"]
    with pytest.raises(ValueError):
        trace(g, "Nope::x")
    with pytest.raises(ValueError):
        trace(g, "Ctl::store", max_depth=0)


def test_trace_to_an_id_that_is_no_node(spark):
    g = graph(spark, [("A", "http:GET:https://x.test/y", "http_call")], nodes=["A"])
    t = trace(g, "A::m")
    assert rows(t.nodes, "id") == [("A::m",)]
    assert t.paths.first()["path"] == ["A::m", "http:GET:https://x.test/y"]
    assert rows(maps.http_boundaries(g), "host", "calls") == [("x.test", 1)]


def test_phases_and_conflicts(spark):
    g = graph(spark, [("App::a", "App::b"), ("App::b", "App::c")])
    assert rows(risk.refactor_phases(g), "phase", "id") == [(1, "App::c"), (2, "App::b"), (3, "App::a")]
    two = graph(spark, [("A::x", "B::y"), ("B::y", "A::x"), ("C::z", "A::x")])
    p = risk.refactor_phases(two)
    assert {r["id"]: r["conflict"] for r in p.collect()} == {"A::x": True, "B::y": True, "C::z": True}
    assert rows(risk.conflicting_pairs(two, p), "src", "dst") == [("A::x", "B::y")]


def test_violations(spark):
    d, a, i = "X\\Domain\\D::m", "X\\Application\\A::m", "X\\Infrastructure\\I::m"
    g = graph(spark, [(d, i), (d, a), (a, i), (i, d), (a, d), (i, a), (d, i)])
    assert rows(layers.violations(g), "from_layer", "to_layer", "severity") == [("Application", "Infrastructure", "HIGH"), ("Domain", "Application", "CRITICAL"), ("Domain", "Infrastructure", "CRITICAL")]
    custom = layers.node_layers(g, [("Outer", "X\\Inf")])
    assert ("Outer",) in rows(custom, "layer")


def test_orphans(spark):
    g = graph(spark, [("Foo::run", "Bar::go")], nodes=["Foo::run", "Bar::go", "Lone::work", "Form::withName", "PayController::x", "Model::scopeActive"])
    found = {r["id"]: r for r in orphans.orphans(g).collect()}
    assert set(found) == {"Foo::run", "Lone::work"}
    assert found["Lone::work"]["confidence"] == 1.0 and found["Foo::run"]["confidence"] == 0.7


def test_empty_graph(spark):
    g = DependencyGraph.from_rows(spark, [], [])
    m = metrics.node_metrics(g)
    assert metrics.graph_stats(g, m).first().asDict() == {"total_nodes": 0, "avg_fan_in": 0.0, "avg_fan_out": 0.0, "max_fan_in": 0, "max_fan_out": 0, "hotspot_count": 0, "total_edges": 0}
    assert cycles.cycles(g).count() == 0 and layers.violations(g).count() == 0 and risk.refactor_phases(g).count() == 0


def test_definition_round_trip(spark):
    g = graph(spark, [("A", "B")])
    q = FlowQuery(g).by_namespace("A").public_nodes().entrypoints().describe("why")
    again = FlowQuery.from_definition(g, q.to_definition())
    assert again.filters == q.filters and rows(again.to_df(), "id") == [("A::m",)]


def test_critical_paths_share_one_traversal(spark):
    g = graph(spark, [("A", "B"), ("B", "C"), ("X", "C")])
    roots = spark.createDataFrame([("A::m",), ("X::m",)], "id string")
    assert rows(critical_paths(g, roots), "root", "depth") == [("A::m", 2), ("X::m", 1)]


def test_assembly(spark):
    g = DependencyGraph.from_rows(spark, [{"class": "A", "method": "m", "line": 1}, {"class": "B", "method": "m"}, {"class": "A", "method": "m", "line": 9}], [])
    d = {r["id"]: (r["node_seq"], r["line"], r["repeated"]) for r in assemble.dedupe(g.nodes).collect()}
    assert d == {"A::m": (1, 9, True), "B::m": (2, None, False)}
    two = DependencyGraph.from_rows(spark, [{"class": "A", "method": "m", "file": "x.php"}, {"class": "A", "method": "m", "file": "y.php"}, {"class": "B", "method": "m", "file": "y.php"}], [])
    assert rows(assemble.qualify(two.nodes), "id") == [("A@x.php::m",), ("A@y.php::m",), ("B::m",)]
    e = DependencyGraph.from_rows(spark, [{"class": "R", "method": "show", "metadata": {"http_method": "GET", "http_path": "/users/{id}"}}], [("C::x", "http:GET:/users/7", "http_call"), ("C::x", "http:POST:/users/7", "http_call")])
    out = assemble.resolve_routes(e.edges, e.nodes)
    assert rows(out.where("dst = 'R::show'"), "src", "type") == [("C::x", "http_call")] and out.count() == 3


def test_ambiguous_references(spark):
    refs = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f")], "src_file string, name string")
    cands = spark.createDataFrame([("f", "f@a", "a"), ("f", "f@d", "d")], "name string, id string, file string")
    includes = spark.createDataFrame([("b", "x"), ("x", "d")], "src string, dst string")
    assert rows(assemble.resolve_ambiguous(refs, cands, includes), "src_file", "id", "ambiguous") == [("a", "f@a", False), ("b", "f@d", False), ("c", "f@a", True), ("c", "f@d", True)]


def test_staleness_and_gate(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, fingerprint string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, fingerprint string")
    assert rows(assemble.staleness(old, new), "path", "status") == [("b", "changed"), ("c", "deleted"), ("d", "new")]
    v = spark.createDataFrame([("x", "y", "CRITICAL")], "src string, dst string, severity string")
    assert diff.gate(v, "new", v).first()["passed"] and not diff.gate(v, "any").first()["passed"]


def test_policies(spark):
    g = graph(spark, [("A", "B")])
    allow, deny = F.when(F.col("class") == "A", "allow"), F.when(F.col("class") == "B", "deny")
    assert rows(assemble.compose_policies(g.nodes, [("one", allow), ("two", deny)]), "id", "visibility") == [("A::m", "public"), ("B::m", "hidden")]
    clash = [("one", allow), ("two", F.lit("deny"))]
    assert rows(assemble.compose_policies(g.nodes, clash, strict=False), "visibility") == [("hidden",), ("hidden",)]
    with pytest.raises(Exception, match="disagree"):
        assemble.compose_policies(g.nodes, clash).collect()


def test_critical_path_len_of_every_entry_point(spark):
    from conftest import SMALL

    from graphloom.plans import projections
    from graphloom.plans.registry import QUERIES

    g = projections.sparse(spark, SMALL)
    after, ids = {}, {r["id"] for r in g.nodes.select("id").collect()}
    for r in g.edges.select("src", "dst").collect():
        after.setdefault(r["src"], set()).add(r["dst"])
    want = {}
    for root in ids - {x for part in after.values() for x in part}:
        seen, near, depth = {root}, {root}, 0
        while depth < 6 and (near := {b for a in near for b in after.get(a, ())} - seen):
            seen |= near
            depth += 1
        want[root] = depth
    assert len(want) > 1 and {r["root"]: r["depth"] for r in QUERIES["critical_path_len"].run(spark, SMALL).collect()} == want
