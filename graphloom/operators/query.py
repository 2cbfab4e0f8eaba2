"""FlowQuery filters (F1-F13) and the trace builder.

A query is a tuple of (type, payload) filters; ``to_df`` folds them into one plan, so Catalyst
orders and fuses them.  ``from_`` starts a trace and, like the fluent form it stands for, leaves the
filters behind.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import iterate

# Namespaces that are not application code.
VENDOR_PREFIXES = ("Illuminate\\", "Symfony\\")


def _filtered(graph: DependencyGraph, df: DataFrame, kind: str, payload: str | None) -> DataFrame:
    if kind == "class":
        return df.where(F.col("class").startswith(payload))
    if kind == "method":
        return df.where(F.col("method") == payload)
    if kind == "visibility":
        return df.where(F.col("visibility") == "public") if payload == "public" else df
    if kind == "application":
        for prefix in VENDOR_PREFIXES:
            df = df.where(~F.col("class").startswith(prefix))
        return df
    if kind == "namespace":
        ns = payload.rstrip("\\")
        return df.where(F.col("class").startswith(ns + "\\") | (F.col("class") == ns))
    if kind == "entrypoints":
        return df.join(graph.edges.select(F.col("dst").alias("id")), "id", "left_anti")
    if kind == "leaves":
        return df.join(graph.edges.select(F.col("src").alias("id")), "id", "left_anti")
    raise ValueError(f"unknown filter {kind}")


@dataclass(frozen=True)
class FlowQuery:
    """Immutable; each call adds a filter, all of which must hold."""

    graph: DependencyGraph
    filters: tuple[tuple[str, str | None], ...] = ()
    intent: str | None = None

    def _with(self, kind: str, payload: str | None = None) -> FlowQuery:
        return replace(self, filters=(*self.filters, (kind, payload)))

    def by_class(self, prefix: str) -> FlowQuery:
        return self._with("class", prefix)

    def by_method(self, name: str) -> FlowQuery:
        return self._with("method", name)

    def public_nodes(self, visibility: str = "public") -> FlowQuery:
        return self._with("visibility", visibility)

    def only_application_code(self) -> FlowQuery:
        return self._with("application")

    exclude_vendor = only_application_code

    def by_namespace(self, ns: str) -> FlowQuery:
        return self._with("namespace", ns)

    def entrypoints(self) -> FlowQuery:
        return self._with("entrypoints")

    def leaf_nodes(self) -> FlowQuery:
        return self._with("leaves")

    def describe(self, intent: str) -> FlowQuery:
        return replace(self, intent=intent)

    def to_definition(self) -> dict:
        """the query as plain data; every filter has type and payload."""
        return {"intent": self.intent, "filters": [{"type": k, "payload": p} for k, p in self.filters]}

    @classmethod
    def from_definition(cls, graph: DependencyGraph, definition: dict) -> FlowQuery:
        return cls(graph, tuple((f["type"], f["payload"]) for f in definition["filters"]), definition.get("intent"))

    def to_df(self) -> DataFrame:
        df = self.graph.nodes
        for kind, payload in self.filters:
            df = _filtered(self.graph, df, kind, payload)
        return df

    def first(self) -> DataFrame:
        """F8: the earliest node, or no row."""
        return self.to_df().orderBy("node_seq").limit(1)

    def count(self) -> int:
        return self.to_df().count()

    def exists(self) -> bool:
        return not self.is_empty()

    def is_empty(self) -> bool:
        return self.to_df().isEmpty()

    def from_(self, node: str) -> TraceQuery:
        return TraceQuery(self.graph, node)


@dataclass(frozen=True)
class Trace:
    """M7: nodes (id, depth, parent, ord), edges and paths of a traversal."""

    visited: DataFrame
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame


@dataclass(frozen=True)
class TraceQuery:
    graph: DependencyGraph
    start: str
    direction: str = iterate.DOWN
    depth: int = 10
    types: tuple[str, ...] | None = None

    def upstream(self) -> TraceQuery:
        return replace(self, direction=iterate.UP)

    def downstream(self) -> TraceQuery:
        return replace(self, direction=iterate.DOWN)

    def both(self) -> TraceQuery:
        return replace(self, direction=iterate.BOTH)

    def max_depth(self, depth: int) -> TraceQuery:
        return replace(self, depth=depth)

    def edge_types(self, *types: str) -> TraceQuery:
        return replace(self, types=types)

    def only_method_calls(self) -> TraceQuery:
        return self.edge_types("method_call")

    def trace(self) -> Trace:
        return trace(self.graph, self.start, self.direction, self.depth, list(self.types) if self.types is not None else None)


def node(graph: DependencyGraph, id_: str) -> DataFrame:
    """the node with this id, or no row."""
    return graph.nodes.where(F.col("id") == id_).orderBy("node_seq").limit(1)


def find_symbols(graph: DependencyGraph, needle: str, limit: int = 20) -> DataFrame:
    """symbols whose name contains the needle, whatever the case; an empty needle matches all."""
    return graph.symbols.where(F.lower("name").contains(needle.lower())).orderBy("symbol_seq").limit(limit)


def symbols_named(graph: DependencyGraph, name: str) -> DataFrame:
    """F12."""
    return graph.symbols.where(F.lower("name") == name.lower())


def public_nodes(graph: DependencyGraph, ns: str | None = None) -> DataFrame:
    """F13."""
    q = FlowQuery(graph).public_nodes()
    return (q.by_namespace(ns) if ns else q).to_df()


def trace(graph: DependencyGraph, start: str, direction: str = iterate.DOWN, max_depth: int = 10, types: list[str] | None = None) -> Trace:
    """Breadth-first traversal from one node.

    edges: every step out of an expanded vertex; of parallel ones between two ids the last in
    traversal order stays.  paths: tree paths ending at the depth limit, at a vertex without
    neighbours, or without unvisited ones (the start only if nothing else was found).
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    if node(graph, start).isEmpty():
        raise ValueError(f"node not found: {start}")
    spark = graph.nodes.sparkSession
    steps = iterate.adjacency(graph.edges, direction, types)
    visited = iterate.bfs(steps, spark.createDataFrame([(start,)], "root string"), max_depth)
    nodes = visited.join(graph.nodes, "id").select("id", "depth", "parent", "ord", "node_seq")
    expanded = visited.where(F.col("depth") < max_depth).select(F.col("id").alias("a"), "depth", "ord").join(steps, "a")
    ends = expanded.select(F.when(F.col("rank") == 0, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("rank") == 0, F.col("b")).otherwise(F.col("a")).alias("dst"), "depth", "ord", "rank", "edge_seq", "type")
    edges = ends.groupBy("src", "dst").agg(F.max_by("type", F.struct("depth", "ord", "rank", "edge_seq")).alias("type"))
    inner = visited.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    has_steps = steps.select(F.col("a").alias("id")).distinct().withColumn("steps", F.lit(True))
    leaves = visited.join(inner, "id", "left_anti").join(has_steps, "id", "left")
    alone = visited.count() == 1 if max_depth else False
    ending = leaves.where((F.col("id") != start) | F.col("steps").isNull() | F.lit(alone))
    return Trace(visited, nodes, edges, ending.select("path"))


def subgraph_ids(graph: DependencyGraph, start: str, depth: int = 5) -> DataFrame:
    """T4: ids within ``depth`` steps in either direction."""
    return trace(graph, start, iterate.BOTH, depth).nodes.select("id")


def longest_path(paths: DataFrame) -> DataFrame:
    """The longest path; of equally long ones the least when joined by ``|``."""
    return paths.orderBy(F.size("path").desc(), F.array_join("path", "|")).limit(1)


def critical_paths(graph: DependencyGraph, roots: DataFrame, depth: int = 6) -> DataFrame:
    """For every root the length of its longest downstream path, by one traversal for all roots."""
    visited = iterate.bfs(iterate.adjacency(graph.edges), roots.select(F.col("id").alias("root")), depth)
    best = Window.partitionBy("root").orderBy(F.size("path").desc(), F.array_join("path", "|"))
    return visited.withColumn("k", F.row_number().over(best)).where("k = 1").select("root", "depth", F.array_join("path", "|").alias("path"))


# Edge types that a lookup shows.
RELEVANT_TYPES = ("method_call", "static_call", "instantiation", "direct_instantiation", "http_call", "wp_hook", "import_call")


def neighbours(graph: DependencyGraph, id_: str) -> DataFrame:
    """Relevant callers and callees of a node, not made distinct, by id."""
    e = graph.edges.where(F.col("type").isin(*RELEVANT_TYPES))
    callers = e.where(F.col("dst") == id_).select(F.lit("caller").alias("side"), F.col("src").alias("id"), "type")
    callees = e.where(F.col("src") == id_).select(F.lit("callee").alias("side"), F.col("dst").alias("id"), "type")
    return callers.union(callees).orderBy("side", "id")


def with_neighbours(graph: DependencyGraph, ids: DataFrame) -> DataFrame:
    """Ids and everything one step away from them."""
    down = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    up = graph.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return ids.select("id").union(down).union(up).distinct()
