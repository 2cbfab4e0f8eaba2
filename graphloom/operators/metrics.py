"""Degrees, blast radius, risk levels and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import iterate


def fans(graph: DependencyGraph) -> DataFrame:
    """A1: nodes with fan_in and fan_out; every edge counts, parallel ones and self-loops too."""
    ins = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    outs = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return graph.nodes.join(ins, "id", "left").join(outs, "id", "left").select(*graph.nodes.columns, zero("fan_in"), zero("fan_out"))


def blast_radius(graph: DependencyGraph) -> DataFrame:
    """(id, blast_radius): distinct ids from which a path leads to the node, itself left out."""
    counted = iterate.ancestors(graph.edges).withColumnRenamed("n", "blast_radius")
    return graph.nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("blast_radius", F.lit(0).cast("long")).alias("blast_radius"))


def risk_level(fan_in: Column, fan_out: Column, blast: Column) -> Column:
    """A2: null blast means unknown and never lowers the level."""
    level = (
        F.when((fan_in > 20) | (fan_out > 15), "CRITICAL")
        .when((fan_in > 10) | (fan_out > 8), "HIGH")
        .when((fan_in > 5) | (fan_out > 5), "MEDIUM")
        .otherwise("LOW")
    )
    return F.when((level == "CRITICAL") & (fan_in == 0) & blast.eqNullSafe(F.lit(0)), "HIGH").otherwise(level)


def complexity_score(fan_in: Column, fan_out: Column, blast: Column) -> Column:
    """A3."""
    return F.least(F.lit(100), F.floor(fan_in * 2 + fan_out * 3 + F.coalesce(blast, F.lit(0)) * F.lit(0.5).cast("double"))).cast("long")


def node_metrics(graph: DependencyGraph, with_blast: bool = True) -> DataFrame:
    """M8: id, node_seq, class, type, fan_in, fan_out, blast_radius, risk, complexity, coupling."""
    f = fans(graph)
    if with_blast:
        f = f.join(blast_radius(graph), "id")
    else:
        f = f.withColumn("blast_radius", F.lit(None).cast("long"))
    i, o, b = F.col("fan_in"), F.col("fan_out"), F.col("blast_radius")
    return f.select("id", "node_seq", "class", "method", "type", "fan_in", "fan_out", "blast_radius", risk_level(i, o, b).alias("risk"), complexity_score(i, o, b).alias("complexity"), (i + o).alias("coupling"))


def hotspots(metrics: DataFrame) -> DataFrame:
    """A5: HIGH and CRITICAL nodes, most complex first."""
    return metrics.where(F.col("risk").isin("HIGH", "CRITICAL")).orderBy(F.col("complexity").desc(), "node_seq")


def top_coupled(metrics: DataFrame, n: int = 10) -> DataFrame:
    """A6."""
    return metrics.orderBy(F.col("coupling").desc(), "node_seq").limit(n)


def graph_stats(graph: DependencyGraph, metrics: DataFrame) -> DataFrame:
    """One row; 0 where the graph is empty."""
    edges = graph.edges.agg(F.count("*").alias("total_edges"))
    avg = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0))
    top = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long"))
    row = metrics.agg(
        F.count("*").alias("total_nodes"), avg("fan_in").alias("avg_fan_in"), avg("fan_out").alias("avg_fan_out"), top("fan_in").alias("max_fan_in"), top("fan_out").alias("max_fan_out"),
        F.count(F.when(F.col("risk").isin("HIGH", "CRITICAL"), 1)).alias("hotspot_count"),
    )
    return row.crossJoin(edges)  # two single rows


def complexity_level(value: Column) -> Column:
    """A9."""
    return F.when(value >= 51, "CRITICAL").when(value >= 21, "HIGH").when(value >= 11, "MEDIUM").otherwise("LOW")


def complexity_stats(values: DataFrame) -> DataFrame:
    """Number of rows and share by level; values has the column complexity."""
    return values.groupBy(complexity_level(F.col("complexity")).alias("level")).agg(F.count("*").alias("n"), F.max("complexity").alias("max_complexity"), F.round(F.avg("complexity"), 2).alias("avg_complexity"))


#: Branch points of a code text, after strings and comments are taken out: one regular expression per counted construct.
# Constructs that add a path.
BRANCHES = (r"\bif\b", r"\bfor\b", r"\bforeach\b", r"\bwhile\b", r"\bcase\b", r"\bdefault\s*:", r"\bcatch\b", r"(?<!\?)\?(?![?>:\-])", r"&&", r"\|\|", r"\?\?")


def cyclomatic(code: Column) -> Column:
    """1 + branch points, counted on the token level (elseif counts as its if)."""
    plain = F.regexp_replace(code, r"(?s)/\*.*?\*/|//[^\n]*|#[^\[\n][^\n]*|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", " ")
    plain = F.regexp_replace(plain, r"\belseif\b", "else if")
    total = F.lit(1)
    for pattern in BRANCHES:
        total = total + F.size(F.regexp_extract_all(plain, F.lit(f"({pattern})"), 1))
    return total.cast("long")


def direct_impact(graph: DependencyGraph, id_: str) -> DataFrame:
    """(side, id): distinct callers and callees one step away; an unknown node is an error."""
    if graph.nodes.where(F.col("id") == id_).isEmpty():
        raise ValueError(f"node not found: {id_}")
    up = graph.edges.where(F.col("dst") == id_).select(F.lit("upstream").alias("side"), F.col("src").alias("id"))
    down = graph.edges.where(F.col("src") == id_).select(F.lit("downstream").alias("side"), F.col("dst").alias("id"))
    return up.union(down).distinct()
