"""The engine's questions as plain functions that answer with dicts, for a caller that is no Spark program (K8).

Each takes a graph and texts or numbers, and returns what the screen shows; there is no transport here.
Limits are those of the answer, not of what is looked through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import cycles, layers, maps, metrics, orphans, risk, search
from graphloom.operators.query import FlowQuery, trace


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def lookup(graph: DependencyGraph, name: str, limit: int = 10) -> dict:
    return {"name": name, "found": _rows(search.lookup(metrics.fans(graph), name, limit), limit)}


def find(graph: DependencyGraph, name: str, limit: int = 10) -> dict:
    rows = _rows(search.find_classes(metrics.fans(graph), name, limit), limit)
    return {"name": name, "truncated": bool(rows and rows[0]["truncated"]), "found": [{k: v for k, v in r.items() if k != "truncated"} for r in rows]}


def impact(graph: DependencyGraph, node: str, limit: int = 200) -> dict:
    """Direct callers and callees; an unknown node is an error."""
    sides = _rows(metrics.direct_impact(graph, node).orderBy("side", "id"), limit)
    return {"node": node, "upstream": [r["id"] for r in sides if r["side"] == "upstream"], "downstream": [r["id"] for r in sides if r["side"] == "downstream"]}


def walk(graph: DependencyGraph, node: str, direction: str = "both", depth: int = 3, limit: int = 200) -> dict:
    found = trace(graph, node, direction, depth)
    return {"node": node, "nodes": _rows(found.nodes.select("id", "depth").orderBy("depth", "ord"), limit), "edges": _rows(found.edges.orderBy("src", "dst"), limit)}


def change_risk(graph: DependencyGraph, node: str) -> dict:
    rows = _rows(risk.change_risk(graph).where(F.col("id") == node).select("id", "score", "level", "fan_in", "fan_out", "blast_radius", "cycle_count", "violation_count"), 1)
    if not rows:
        raise ValueError(f"node not found: {node}")
    return rows[0]


def architecture(graph: DependencyGraph, limit: int = 50) -> dict:
    found = layers.violations(graph)
    return {"stats": _rows(layers.violation_stats(found), 1)[0], "layers": _rows(layers.layer_distribution(graph).orderBy("layer"), limit), "violations": _rows(found.orderBy("severity", "src", "dst"), limit)}


def health(graph: DependencyGraph, limit: int = 20) -> dict:
    m, loops, dead = metrics.node_metrics(graph, with_blast=False), cycles.cycles(graph), orphans.orphans(graph)
    return {
        "stats": _rows(metrics.graph_stats(graph, m), 1)[0],
        "hotspots": _rows(metrics.hotspots(m).select("id", "risk", "complexity"), limit),
        "cycles": _rows(cycles.cycle_stats(loops), 1)[0],
        "orphans": _rows(orphans.orphan_stats(dead), 1)[0],
    }


def overview(graph: DependencyGraph, limit: int = 20) -> dict:
    return {"areas": _rows(maps.area_rollup(graph), limit), "entrypoints": FlowQuery(graph).entrypoints().count(), "language": _rows(maps.dominant_language(graph), 1)}


TOOLS = {f.__name__: f for f in (lookup, find, impact, walk, change_risk, architecture, health, overview)}
