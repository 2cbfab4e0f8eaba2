"""Cycles: strongly connected components with severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph, class_of
from graphloom.operators import iterate


def severity(size: Column, classes: Column) -> Column:
    """Recursion within one class is only information."""
    return F.when(classes == 1, "INFO").when(size >= 11, "CRITICAL").when(size >= 6, "HIGH").when(size >= 3, "MEDIUM").otherwise("LOW")


def cycles(graph: DependencyGraph) -> DataFrame:
    """A10: cycle_id (least member), nodes (sorted), size, severity, reason; self-loops are no cycles."""
    members = iterate.strong_components(graph.edges)
    grouped = members.groupBy(F.col("component").alias("cycle_id")).agg(F.sort_array(F.collect_list("id")).alias("nodes"), F.count("*").alias("size"), F.count_distinct(class_of(F.col("id"))).alias("classes"))
    reason = F.when(F.col("classes") == 1, "intra-class mutual recursion").otherwise(F.concat(F.lit("cycle of "), F.col("size").cast("string"), F.lit(" nodes")))
    return grouped.select("cycle_id", "nodes", "size", severity(F.col("size"), F.col("classes")).alias("severity"), reason.alias("reason"))


def cycle_stats(found: DataFrame) -> DataFrame:
    """One row."""
    per = [F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")]
    return found.agg(F.count("*").alias("total"), *per, F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("members"), F.coalesce(F.max("size"), F.lit(0).cast("long")).alias("largest"))


def in_cycle(found: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether both ids are on one cycle."""
    return found.agg(F.coalesce(F.max(F.array_contains("nodes", a) & F.array_contains("nodes", b)), F.lit(False)).alias("in_cycle"))


def cycles_of(found: DataFrame) -> DataFrame:
    """(id, cycle_id, size, severity) of every member."""
    return found.select(F.explode("nodes").alias("id"), "cycle_id", "size", "severity")
