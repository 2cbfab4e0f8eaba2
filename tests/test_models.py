"""Random graphs against plain Python models, and every registered query against its SQL."""

import math
import os
from collections import deque

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import SMALL
from graphloom.model import DependencyGraph
from graphloom.operators import cycles, iterate, metrics
from graphloom.plans.registry import QUERIES

IDS = [f"C{k % 4}::m{k}" for k in range(12)]
edge_lists = st.lists(st.tuples(st.sampled_from(IDS), st.sampled_from([*IDS, "gone::x"])), max_size=40)


def reached(edges, start):
    seen, todo = set(), deque([start])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=edge_lists)
def test_reach_components_and_layers(spark, edges):
    g = DependencyGraph.from_rows(spark, [{"class": i.split("::")[0], "method": i.split("::")[1]} for i in IDS], edges)
    closure = {x: reached(edges, x) for x in [*IDS, "gone::x"]}
    pairs = {(r["a"], r["b"]) for r in iterate.reach(g.edges).collect()} if edges else set()
    assert pairs == {(a, b) for a, bs in closure.items() for b in bs}
    blast = {r["id"]: r["blast_radius"] for r in metrics.blast_radius(g).collect()}
    assert blast == {i: sum(i in bs and a != i for a, bs in closure.items()) for i in IDS}
    groups = {frozenset(r["nodes"]) for r in cycles.cycles(g).collect()}
    assert groups == {frozenset(y for y in closure[x] if x in closure[y]) for x in IDS if x in closure[x]} - {frozenset([x]) for x in IDS}
    fans = metrics.fans(g).collect()
    assert sum(r["fan_out"] for r in fans) == len(edges) and sum(r["fan_in"] for r in fans) == sum(b in IDS for _, b in edges)
    layer = {r["id"]: r["layer"] for r in iterate.peel(g.nodes.select("id"), g.edges).collect()}
    for a, b in edges:
        if a != b and b in IDS and layer[a] is not None:
            assert layer[b] is not None and layer[b] < layer[a]


def test_reach_writes_no_pairs(spark, monkeypatch):
    """A ring with a tail and a branch: only edges are written on the way, and the pairs are those of the joins."""
    edges = [(f"r{k}", f"r{(k + 1) % 40}") for k in range(40)] + [(f"t{k}", f"t{k + 1}") for k in range(60)] + [("t60", "r7"), ("t30", "u0"), ("u0", "u0")]
    df = spark.createDataFrame(edges + edges[:5], "src string, dst string")
    written, cut = [], iterate.cut

    def counted(rows, label):
        out = cut(rows, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(iterate, "cut", counted)
    monkeypatch.setattr(iterate, "SOURCES", 30, raising=False)
    monkeypatch.setattr(iterate, "PIECE", 7, raising=False)
    listed = sorted(tuple(r) for r in iterate.reach(df).collect())
    assert max(written) <= len(edges)
    assert listed == sorted((a, b) for a in {a for a, _ in edges} for b in reached(edges, a))
    monkeypatch.setattr(iterate, "LOCAL", 0)
    assert listed == sorted(tuple(r) for r in iterate.reach(df).collect())


def _norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", ["top_coupled", "trace_nodes", "cycle_list", "orphan_list", "change_risk", "endpoint_match", "rate_limit_greedy", "snapshot_metric_delta", "locate_node_asof", "grounding"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{SMALL}/{f}'")
    df, rel = QUERIES[name].run(spark, SMALL), con.sql(QUERIES[name].sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(_norm(r[k]) for k in at) for r in rel.fetchall()), key=repr)


def test_entry():
    import __spark_entry__ as e

    assert len(QUERIES) >= 70 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
