"""Lookup and search over nodes and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _classes(fans: DataFrame, needle: str) -> DataFrame:
    hit = fans.where(F.lower("class").contains(needle.lower().strip()))
    return hit.groupBy(F.col("class").alias("name")).agg(F.min("node_seq").alias("seq"), F.count("*").alias("methods"), F.max("fan_in").alias("fan_in"), F.sum("fan_in").alias("fan_in_sum"), F.sum("fan_out").alias("fan_out_sum"))


def find_classes(fans: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Classes that match, in order of first appearance; truncated tells that there are more.  limit is between 1 and 50."""
    limit = max(1, min(50, limit))
    rows = _classes(fans, needle)
    more = rows.agg((F.count("*") > limit).alias("truncated"))
    return rows.orderBy("seq").limit(limit).crossJoin(more)  # one row


def find_many(fans: DataFrame, needles: Sequence[str]) -> DataFrame:
    """S3: several queries at once: (query, name, methods).  Queries are few, given by the caller, and compared as one list."""
    wanted = list(dict.fromkeys(n.strip().lower() for n in needles))
    hits = F.filter(F.array(*map(F.lit, wanted)), lambda q: F.lower("class").contains(q))
    return fans.withColumn("query", F.explode(hits)).groupBy("query", F.col("class").alias("name")).agg(F.count("*").alias("methods"))


def lookup(fans: DataFrame, needle: str, limit: int = 10, kind: str | None = None) -> DataFrame:
    """Classes, then methods (without a kind only of classes that don't match), then namespaces, at most ``limit``."""
    n = needle.lower()
    classes = _classes(fans, n).select(F.lit(0).alias("section"), "name", "seq", F.col("fan_in_sum").alias("fan_in"), F.col("fan_out_sum").alias("fan_out"))
    m = fans.where(F.lower("method").contains(n))
    if kind is None:
        m = m.where(~F.lower("class").contains(n))
    methods = m.select(F.lit(1), "id", "node_seq", "fan_in", "fan_out")
    ns = F.regexp_replace("class", r"\\[^\\]*$", "")
    spaces = fans.where(F.col("class").contains("\\")).withColumn("ns", ns).where(F.lower("ns").contains(n)).groupBy("ns").agg(F.min("node_seq").alias("s"), F.sum("fan_in").alias("i"), F.sum("fan_out").alias("o")).select(F.lit(2), "ns", "s", "i", "o")
    parts = {None: classes.union(methods).union(spaces), "class": classes, "method": methods.toDF(*classes.columns), "namespace": spaces.toDF(*classes.columns)}
    return parts[kind].orderBy("section", "seq").limit(limit)


def area_dependencies(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """What crosses the border of a set of ids: (direction, id, type); of several types to one id the last."""
    inside = ids.select("id").distinct()
    out = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.max_by("type", "edge_seq").alias("type"))
    into = edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").join(inside.withColumnRenamed("id", "src"), "src", "left_anti").groupBy(F.col("src").alias("id")).agg(F.max_by("type", "edge_seq").alias("type"))
    return out.select(F.lit("out").alias("direction"), "id", "type").union(into.select(F.lit("in"), "id", "type"))


def scoped_counts(ids: DataFrame, violations: DataFrame, cycles: DataFrame) -> DataFrame:
    """What of each report belongs to a set of ids: violations with an end in it, cycles with a member in it."""
    inside = ids.select("id").distinct()
    ends = violations.select("src", "dst", F.explode(F.array("src", "dst")).alias("id")).join(inside, "id", "left_semi").select("src", "dst").distinct()
    members = cycles.select("cycle_id", F.explode("nodes").alias("id")).join(inside, "id", "left_semi").select("cycle_id").distinct()
    return ends.agg(F.lit("violations").alias("report"), F.count("*").alias("n")).union(members.agg(F.lit("cycles"), F.count("*")))


def token_estimate(text: Column) -> Column:
    """S6."""
    return F.ceil(F.length(text) / 4).cast("long")


def signature(name: Column, params: Column, returned: Column) -> Column:
    """name(type a, b): returned"""
    args = F.array_join(F.transform(params, lambda p: F.concat_ws(" ", p["type"], F.concat(F.lit("$"), p["name"]))), ", ")
    return F.concat(name, F.lit("("), F.coalesce(args, F.lit("")), F.lit(")"), F.when(returned.isNotNull(), F.concat(F.lit(": "), returned)).otherwise(""))


def grounding(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """References Class::method in texts (text_id, text), and whether they are known."""
    refs = texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_\\]*::[A-Za-z_]\w*)"), 1))).alias("ref"))
    known = ids.select(F.col("id").alias("ref")).distinct().withColumn("known", F.lit(True))
    return refs.join(known, "ref", "left").select("text_id", "ref", F.coalesce("known", F.lit(False)).alias("known"))


def snippet(content: Column, start: Column, end: Column, most: int = 30) -> Column:
    """Lines start to end (at most ``most``, a display limit), without their common indent."""
    lines = F.slice(F.split(content, "\r?\n"), start, F.least(F.greatest(end - start + 1, F.lit(1)), F.lit(most)))
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x))), "\n")
