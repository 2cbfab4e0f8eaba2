"""Layers, violations and SOLID rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph, class_of, method_of, short_name

# Name segments that tell a layer, in order; the first found counts.
SEGMENTS = (
    ("\\Domain\\", "Domain"),
    ("\\Application\\", "Application"),
    ("\\Infrastructure\\", "Infrastructure"),
    ("\\Core\\", "Domain"),
    ("\\Entity\\", "Domain"),
    ("\\Service\\", "Application"),
    ("\\UseCase\\", "Application"),
    ("\\Repository\\", "Infrastructure"),
    ("\\Controller\\", "Infrastructure"),
)

# Dependencies that must not be, with severity.
FORBIDDEN = (
    ("Domain", "Infrastructure", "CRITICAL"),
    ("Domain", "Application", "CRITICAL"),
    ("Application", "Infrastructure", "HIGH"),
)


def layer_of(name: Column, metadata_layer: Column | None = None, custom: Sequence[tuple[str, str]] = ()) -> Column:
    """L1: metadata, then custom (layer, prefix) rules in order, then name segments, else Unknown."""
    rules = [F.when(name.startswith(prefix), layer) for layer, prefix in custom]
    rules += [F.when(name.contains(part), layer) for part, layer in SEGMENTS]
    first = [metadata_layer] if metadata_layer is not None else []
    return F.coalesce(*first, *rules, F.lit("Unknown"))


def node_layers(graph: DependencyGraph, custom: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(id, layer)"""
    return graph.nodes.select("id", layer_of(class_of(F.col("id")), F.col("metadata.layer"), custom).alias("layer"))


def violations(graph: DependencyGraph, custom: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """L2: distinct forbidden dependencies; an end that is no node has the layer Unknown."""
    layers = node_layers(graph, custom)
    pairs = graph.edges.select("src", "dst").distinct()
    pairs = pairs.join(layers.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), "src").join(layers.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    level = F.coalesce(*(F.when((F.col("from_layer") == a) & (F.col("to_layer") == b), s) for a, b, s in FORBIDDEN))
    return pairs.withColumn("severity", level).where("severity is not null").dropDuplicates(["src", "dst", "from_layer", "to_layer"])


def violation_stats(found: DataFrame) -> DataFrame:
    """L3: one row; is_clean where there is none."""
    return found.agg(F.count("*").alias("total"), F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("critical"), F.count(F.when(F.col("severity") == "HIGH", 1)).alias("high"), (F.count("*") == 0).alias("is_clean"))


def layer_distribution(graph: DependencyGraph, custom: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """L3: (layer, n) with a row for every known layer, also where none is."""
    names = list(dict.fromkeys(["Domain", "Application", "Infrastructure", "Unknown", *(layer for layer, _ in custom)]))
    every = graph.nodes.sparkSession.createDataFrame([(n,) for n in names], "layer string")
    counted = node_layers(graph, custom).groupBy("layer").agg(F.count("*").alias("n"))
    return every.join(counted, "layer", "full_outer").select("layer", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _ends(graph: DependencyGraph) -> DataFrame:
    """Edges with the classes of both ends; ends without a class are left out."""
    named = graph.edges.withColumn("src_class", class_of(F.col("src"))).withColumn("dst_class", class_of(F.col("dst")))
    return named.where("src_class <> '' and dst_class <> ''")


def _synthetic(method: Column) -> Column:
    return F.coalesce(method.startswith("__"), F.lit(False))


def interface_like(name: Column) -> Column:
    short = short_name(name)
    return short.endswith("Interface") | short.endswith("Contract") | short.endswith("Port")


def srp(graph: DependencyGraph, most: int = 7) -> DataFrame:
    """L4: classes that depend on more than ``most`` other classes."""
    e = _ends(graph).where("src_class <> dst_class").where(~_synthetic(method_of(F.col("dst"))))
    found = e.groupBy(F.col("src_class").alias("class")).agg(F.count_distinct("dst_class").alias("fan_out"))
    return found.where(F.col("fan_out") > most).withColumn("severity", F.when(F.col("fan_out") > 12, "HIGH").otherwise("MEDIUM"))


def isp(graph: DependencyGraph, most: int = 5) -> DataFrame:
    """Interfaces with more than ``most`` methods."""
    n = graph.nodes.select(class_of(F.col("id")).alias("class"), method_of(F.col("id")).alias("m")).where("class <> '' and m is not null").where(~_synthetic(F.col("m"))).where(interface_like(F.col("class")))
    found = n.groupBy("class").agg(F.count("*").alias("methods"))
    return found.where(F.col("methods") > most).withColumn("severity", F.when(F.col("methods") > 10, "HIGH").otherwise("MEDIUM"))


def dip_layer(name: Column) -> Column:
    """The layers of L6, by name segments of its own."""
    parts = ("Domain", "Application", "Infrastructure", "Interfaces")
    return F.coalesce(*(F.when(name.contains(f"\\{p}\\"), p) for p in parts), F.lit("Unknown"))


def dip(graph: DependencyGraph, protected: Sequence[str] = ("Domain", "Application")) -> DataFrame:
    """Protected layers that instantiate a class that is no interface."""
    e = _ends(graph).where("type = 'direct_instantiation'").dropDuplicates(["src", "dst"]).withColumn("layer", dip_layer(F.col("src_class")))
    found = e.where(F.col("layer").isin(*protected)).where(~interface_like(F.col("dst_class")))
    return found.select("src", "dst", "layer", F.when(F.col("layer") == "Domain", "HIGH").otherwise("MEDIUM").alias("severity"))


def ocp(graph: DependencyGraph, least: int = 3) -> DataFrame:
    """Classes that instantiate ``least`` or more other classes."""
    e = _ends(graph).where("type = 'direct_instantiation' and src_class <> dst_class")
    return e.groupBy(F.col("src_class").alias("class")).agg(F.count_distinct("dst_class").alias("instantiated")).where(F.col("instantiated") >= least).withColumn("severity", F.lit("LOW"))
