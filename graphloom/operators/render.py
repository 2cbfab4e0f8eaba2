"""Texts for people: JSON, Markdown and diagrams of small results (K4-K7).

Diagrams and tables are for the screen, so every function takes the number of rows that it shows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph, class_of
from graphloom.operators.query import RELEVANT_TYPES


def to_json(df: DataFrame, rows: int = 1000) -> str:
    """K4."""
    return "[" + ",".join(r["j"] for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(rows).collect()) + "]"


def to_markdown(df: DataFrame, title: str, rows: int = 50) -> str:
    """K5: a heading and a table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect()])


def _names(ids: list[str]) -> dict[str, str]:
    return {x: f"n{k}" for k, x in enumerate(dict.fromkeys(ids))}


def _label(text: str) -> str:
    return json.dumps(text.replace('"', "'"), ensure_ascii=False)


def flowchart(edges: DataFrame, rows: int = 100) -> str:
    """K6: a Mermaid flowchart of distinct edges (src, dst)."""
    found = [(r["src"], r["dst"]) for r in edges.select("src", "dst").distinct().orderBy("src", "dst").limit(rows).collect()]
    names = _names([x for e in found for x in e])
    return "\n".join(["flowchart LR", *(f"  {n}[{_label(x)}]" for x, n in names.items()), *(f"  {names[a]} --> {names[b]}" for a, b in found)])


def component_diagram(graph: DependencyGraph, rows: int = 100) -> str:
    """K6: classes and the distinct pairs that depend on each other."""
    e = graph.edges.where(F.col("type").isin(*RELEVANT_TYPES)).select(class_of(F.col("src")).alias("src"), class_of(F.col("dst")).alias("dst")).where("src <> dst")
    return flowchart(e, rows)


def class_diagram(graph: DependencyGraph, rows: int = 50) -> str:
    """K6: classes with their methods, and what they inherit or implement."""
    classes = graph.nodes.groupBy("class").agg(F.sort_array(F.collect_set("method")).alias("methods"), F.min("node_seq").alias("seq")).orderBy("seq").limit(rows).collect()
    names = _names([r["class"] for r in classes])
    links = graph.edges.where(F.col("type").isin("inherits", "interface_implementation")).select(class_of(F.col("src")).alias("src"), class_of(F.col("dst")).alias("dst"), "type").distinct().orderBy("src", "dst").limit(rows).collect()
    body = [line for r in classes for line in (f"  class {names[r['class']]}[{_label(r['class'])}] {{", *(f"    +{m}()" for m in r["methods"]), "  }")]
    arrows = {"inherits": "<|--", "interface_implementation": "<|.."}
    return "\n".join(["classDiagram", *body, *(f"  {names[r['dst']]} {arrows[r['type']]} {names[r['src']]}" for r in links if r["src"] in names and r["dst"] in names)])


def service_diagram(edges: DataFrame, rows: int = 100) -> str:
    """K6: services and their calls (from, to, type, count)."""
    found = edges.orderBy("from", "to", "type").limit(rows).collect()
    names = _names([x for r in found for x in (r["from"], r["to"])])
    return "\n".join(["flowchart LR", *(f"  {n}[{_label(x)}]" for x, n in names.items()), *(f"  {names[r['from']]} -->|{r['type']} {r['count']}| {names[r['to']]}" for r in found)])


def sequence_diagram(path: list[str]) -> str:
    """K6: the calls along a path."""
    names = _names(path)
    return "\n".join(["sequenceDiagram", *(f"  participant {n} as {x}" for x, n in names.items()), *(f"  {names[a]}->>{names[b]}: call" for a, b in zip(path, path[1:], strict=False))])


def orphan_report(found: DataFrame, rows: int = 200) -> str:
    """K7: orphans by level, surest first."""
    lines: list[str] = []
    for r in found.orderBy(F.col("confidence").desc(), "node_seq").limit(rows).collect():
        if not lines or not any(x == f"== {r['level']} ==" for x in lines):
            lines.append(f"== {r['level']} ==")
        lines.append(f"{r['percent']:3d} % {r['id']}: {r['reason']}")
    return "\n".join(lines)


def context_diagram(edges: DataFrame, title: str, rows: int = 100) -> str:
    """K6: services (from, to, type, count) as a C4 context diagram."""
    found = edges.orderBy("from", "to", "type").limit(rows).collect()
    names = _names([x for r in found for x in (r["from"], r["to"])])
    quoted = lambda x: _label(x)
    return "\n".join(["C4Context", f"  title {title}", *(f"  System({n}, {quoted(x)})" for x, n in names.items()), *(f"  Rel({names[r['from']]}, {names[r['to']]}, {quoted(r['type'])})" for r in found)])


def hotspots_json(found: DataFrame, rows: int = 200) -> str:
    """K7: hotspots (id, risk, complexity, fan_in, fan_out) by level, most complex first."""
    shown = found.orderBy(F.col("complexity").desc(), "id").limit(rows).collect()
    levels: dict[str, list[dict]] = {}
    for r in shown:
        levels.setdefault(r["risk"], []).append({k: r[k] for k in ("id", "complexity", "fan_in", "fan_out")})
    return json.dumps({"total": len(shown), "levels": levels}, ensure_ascii=False)


def graph_page(edges: DataFrame, title: str, rows: int = 300) -> str:
    """K7: a page that draws distinct edges (src, dst); it needs nothing but a browser with the diagram script at hand."""
    import html

    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><pre class='mermaid'>{html.escape(flowchart(edges, rows))}</pre></body></html>"
