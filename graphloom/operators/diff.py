"""Comparing snapshots, drift and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metrics that a snapshot keeps.
METRICS = ("total_nodes", "total_edges", "avg_fan_in", "avg_fan_out", "max_fan_in", "max_fan_out", "hotspot_count")


def long_form(stats: DataFrame) -> DataFrame:
    """One row of statistics as (metric, value)."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))
    return stats.select(F.inline(pairs))


def metric_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, old, new, delta); a missing value is 0."""
    joined = old.withColumnRenamed("value", "o").join(new.withColumnRenamed("value", "n"), "metric", "full_outer")
    o, n = F.coalesce("o", F.lit(0.0)), F.coalesce("n", F.lit(0.0))
    return joined.select("metric", o.alias("old"), n.alias("new"), F.round(n - o, 2).alias("delta"))


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right has not; repeated rows of left stay."""
    return left.join(right.select(*keys), keys, "left_anti")


def new_and_resolved(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side alone, with status new or resolved."""
    a, b = only_in(new, old, keys), only_in(old, new, keys)
    return a.select(*keys, F.lit("new").alias("status")).union(b.select(*keys, F.lit("resolved").alias("status")))


def cycle_key(nodes: Column) -> Column:
    """A cycle's identity: its members in order."""
    return F.array_join(F.array_sort(nodes), ",")


def complexity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose complexity changed; a missing id has 0."""
    joined = old.select("id", F.col("complexity").alias("o")).join(new.select("id", F.col("complexity").alias("n")), "id", "full_outer")
    o, n = F.coalesce("o", F.lit(0).cast("long")), F.coalesce("n", F.lit(0).cast("long"))
    rows = joined.select("id", o.alias("old"), n.alias("new"), (n - o).alias("delta")).where("delta <> 0")
    return rows.withColumn("change", F.when(F.col("delta") < 0, "improved").otherwise("degraded"))


def summary(deltas: DataFrame) -> DataFrame:
    """How many deltas (column delta) fell, rose or stayed; lower is better."""
    n = lambda test: F.count(F.when(test, 1))
    return deltas.agg(n(F.col("delta") < 0).alias("improved"), n(F.col("delta") > 0).alias("degraded"), n(F.col("delta") == 0).alias("unchanged"))


def flow_diff(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(what, status, n): nodes by id, edges by (src, dst, type, method)."""
    parts = []
    for what, old, new, keys in (("node", old_nodes, new_nodes, ["id"]), ("edge", old_edges, new_edges, ["src", "dst", "type", "method"])):
        for status, a, b in (("added", new, old), ("removed", old, new)):
            parts.append(only_in(a, b, keys).agg(F.lit(what).alias("what"), F.lit(status).alias("status"), F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def set_drift(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys added and removed, and totals."""
    o, n = old.select(key).distinct(), new.select(key).distinct()
    marked = o.withColumn("o", F.lit(1)).join(n.withColumn("n", F.lit(1)), key, "full_outer")
    c = lambda t: F.count(F.when(t, 1))
    return marked.agg(c(F.col("o").isNull()).alias("added"), c(F.col("n").isNull()).alias("removed"), F.count("o").alias("total_baseline"), F.count("n").alias("total_current"), (F.count("n") - F.count("o")).alias("delta"))


def ratio_severity(ratio: Column) -> Column:
    """How far a value is above its limit."""
    return F.when(ratio >= 3, "critical").when(ratio >= 2, "high").when(ratio >= 1.5, "medium").otherwise("low")


def drift_policy(values: DataFrame, limits: DataFrame) -> DataFrame:
    """Values (name, value) against limits (name, most): those above, with severity."""
    over = values.join(limits, "name").where("value > most")
    return over.select("name", "value", "most", ratio_severity(F.col("value") / F.greatest(F.col("most"), F.lit(1))).alias("severity"))


def passed(breaches: DataFrame, blockers: DataFrame) -> DataFrame:
    """One row: no breach and no blocker."""
    return breaches.agg(F.count("*").alias("breaches")).crossJoin(blockers.agg(F.count("*").alias("blockers"))).withColumn("passed", (F.col("breaches") == 0) & (F.col("blockers") == 0))  # two single rows


# Contract findings that break callers.
BREAKING = ("CONTRACT_ENDPOINT_MISSING_IN_CODE", "HTTP_METHOD_MISMATCH")


def map_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Service edges (from, to, type, count) of two maps; a changed count is one removed and one added."""
    keys = ["from", "to", "type", "count"]
    a, b = only_in(new, old, keys), only_in(old, new, keys)
    return a.select(*keys, F.lit("added").alias("status"), F.lit(False).alias("breaking")).union(b.select(*keys, F.lit("removed"), F.lit(True)))


def compliance(findings: DataFrame, top: int = 5) -> DataFrame:
    """Findings (kind threshold or blocker, code): status by code, blockers first, at most ``top`` distinct codes."""
    f = findings.select(F.when(F.col("kind") == "blocker", "fail").otherwise("warn").alias("status"), "code").distinct()
    return f.orderBy("status", "code").limit(top)


def gate(violations: DataFrame, mode: str, baseline: DataFrame | None = None) -> DataFrame:
    """One row: violations that count in the mode (any, new, critical) and whether the gate is passed.

    Without a baseline every violation is new.
    """
    if mode not in ("any", "new", "critical"):
        raise ValueError(f"unknown mode {mode}")
    found = violations.where("severity = 'CRITICAL'") if mode == "critical" else violations
    if mode == "new" and baseline is not None:
        found = only_in(found, baseline, ["src", "dst"])
    return found.agg(F.count("*").alias("counted"), (F.count("*") == 0).alias("passed"))
