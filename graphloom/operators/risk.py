"""Risk, impact, refactoring and bug scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators import cycles as CY
from graphloom.operators import iterate
from graphloom.operators import layers as L
from graphloom.operators import metrics as M

# Weights of the risk factors, and the raw score that is 100.
WEIGHTS = {"blast_radius": 3.0, "fan_in": 2.0, "fan_out": 1.5, "cycle_count": 10.0, "violation_count": 8.0, "cyclomatic": 0.5}
FULL_SCORE = 200.0


def risk_score(values: dict[str, Column]) -> Column:
    """A13."""
    raw = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        raw = raw + values[name] * F.lit(weight)
    return F.least(F.lit(100), F.round(raw / F.lit(FULL_SCORE) * 100)).cast("long")


def risk_factors(values: dict[str, Column]) -> Column:
    """What each factor adds."""
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), values[n].cast("double").alias("value"), F.round(values[n] * F.lit(w), 2).alias("contribution")) for n, w in WEIGHTS.items()))


def level_of(score: Column) -> Column:
    return F.when(score <= 25, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")


def change_risk(graph: DependencyGraph, custom=(), complexities: DataFrame | None = None) -> DataFrame:
    """A14, A15 for every node: cycles and violations that touch it, score and level.

    complexities (id, cyclomatic) come from a parser; without them every code has none.
    """
    m = M.node_metrics(graph)
    cycles = CY.cycles_of(CY.cycles(graph)).groupBy("id").agg(F.count("*").alias("cycle_count"))
    v = L.violations(graph, custom)
    touched = v.select(F.col("src").alias("id")).union(v.where("src <> dst").select("dst")).groupBy("id").agg(F.count("*").alias("violation_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    known = complexities if complexities is not None else graph.nodes.select("id", F.lit(0).cast("long").alias("cyclomatic"))
    rows = m.join(cycles, "id", "left").join(touched, "id", "left").join(known, "id", "left").select(*m.columns, *map(zero, ("cycle_count", "violation_count", "cyclomatic")))
    score = risk_score({n: F.col(n) for n in WEIGHTS})
    return rows.withColumn("score", score).withColumn("level", level_of(F.col("score")))


def refactor_safety(graph: DependencyGraph) -> DataFrame:
    """A16 for every node: how much a refactoring of it touches.

    Affected are its distinct direct callers and callees; cycles and violations count once each when
    any of their members is affected or the node itself.
    """
    near = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(graph.edges.select("dst", "src")).distinct()
    affected = near.groupBy("id").agg(F.count("*").alias("affected"))
    scope = near.union(graph.nodes.select("id", F.col("id").alias("other"))).distinct()
    members = CY.cycles_of(CY.cycles(graph)).select(F.col("id").alias("other"), "cycle_id")
    cyc = scope.join(members, "other").groupBy("id").agg(F.count_distinct("cycle_id").alias("cycles"))
    v = L.violations(graph).select("src", "dst")
    ends = v.select(F.col("src").alias("other"), "src", "dst").union(v.select("dst", "src", "dst"))
    vio = scope.join(ends, "other").groupBy("id").agg(F.count_distinct("src", "dst").alias("violations"))
    few = M.fans(graph).where("fan_in <= 1").select(F.col("id").alias("dst"))
    lone = graph.edges.select("src", "dst").distinct().join(few, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("potential_orphans"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    rows = graph.nodes.select("id").join(affected, "id", "left").join(cyc, "id", "left").join(vio, "id", "left").join(lone, "id", "left").select("id", *map(zero, ("affected", "cycles", "violations", "potential_orphans")))
    score = F.col("affected") * 2 + F.col("cycles") * 10 + F.col("violations") * 8 + F.col("potential_orphans") * 3
    return rows.withColumn("score", score).withColumn("risk", F.when(F.col("score") >= 50, "CRITICAL").when(F.col("score") >= 30, "HIGH").when(F.col("score") >= 10, "MEDIUM").otherwise("LOW"))


def bug_scores(findings: DataFrame, metrics: DataFrame, min_score: int = 0) -> DataFrame:
    """Findings (node_id, type, confidence, ...) scored by the node's metrics, worst first by rank of score."""
    m = metrics.select(F.col("id").alias("node_id"), "fan_in", "blast_radius", F.lit(True).alias("known"))
    c = F.col("confidence")
    known = F.round(c * (1 + 2 * F.col("fan_in") + F.col("blast_radius") / 10.0))
    raw = F.least(F.lit(100.0), F.when(F.col("known"), known).otherwise(F.round(c * 20)))
    graceful = F.col("type") == "graceful_degradation"
    score = F.when(graceful, 0).otherwise(raw).cast("long")
    rows = findings.join(m, "node_id", "left").withColumn("bug_score", score).where(graceful | (F.col("bug_score") >= min_score))
    severity = F.when(graceful, "INFO").when(F.col("bug_score") >= 70, "CRITICAL").when(F.col("bug_score") >= 40, "HIGH").when(F.col("bug_score") >= 20, "MEDIUM").otherwise("LOW")
    return rows.select(*findings.columns, "bug_score", severity.alias("severity"))


def bug_stats(scored: DataFrame) -> DataFrame:
    """Totals by severity; INFO is not in the total."""
    per = [F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")]
    return scored.agg(F.count(F.when(F.col("severity") != "INFO", 1)).alias("total"), *per)


def refactor_phases(graph: DependencyGraph, risks: DataFrame | None = None) -> DataFrame:
    """(id, phase, conflict): callees first; what is on a cycle, and all that depends on it, comes last."""
    layers = iterate.peel(graph.nodes.select("id"), graph.edges)
    last = layers.agg(F.coalesce(F.max("layer"), F.lit(0)).alias("m"))
    out = layers.crossJoin(last).select("id", F.coalesce("layer", F.col("m") + 1).alias("phase"), F.col("layer").isNull().alias("conflict"))  # last is one row
    return out if risks is None else out.join(risks.select("id", "score"), "id", "left")


def conflicting_pairs(graph: DependencyGraph, phases: DataFrame) -> DataFrame:
    """Pairs of conflicting ids that depend on each other."""
    left = phases.where("conflict").select("id")
    e = graph.edges.select("src", "dst").distinct().where("src < dst")
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    both = e.join(back, ["src", "dst"])
    return both.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")


def refactor_plan(rows: DataFrame) -> DataFrame:
    """Rows of change_risk with affected and violations: whether a plan is trivial, and its size 1-10."""
    trivial = (F.col("level") == "LOW") & (F.col("affected") < 3) & (F.col("cycle_count") == 0) & (F.col("violation_count") == 0)
    return rows.withColumn("trivial", trivial).withColumn("plan_complexity", F.least(F.lit(10), F.greatest(F.lit(1), 1 + F.floor(F.col("affected") / 2))).cast("long"))


def remediation(violations: DataFrame, hotspots: DataFrame, limit: int = 10) -> DataFrame:
    """Proposals: violations first, then hotspots, numbered, at most ``limit`` (a top-k report)."""
    v = violations.select(F.lit(0).alias("part"), F.lit("violation").alias("kind"), F.concat_ws("->", "src", "dst").alias("target"), F.when(F.col("severity") == "CRITICAL", 0).otherwise(1).alias("priority"), F.lit(0).cast("long").alias("weight"))
    h = hotspots.select(F.lit(1), F.lit("hotspot"), "id", F.when(F.col("risk") == "CRITICAL", 0).otherwise(1), -F.col("complexity"))
    return v.union(h).orderBy("part", "priority", "weight", "target").limit(limit)


def step_progress(done: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_id, steps, completed, percent) of plans (plan_id, step) with completed steps (plan_id, step)."""
    marked = plan.join(done.distinct().withColumn("ok", F.lit(1)), ["plan_id", "step"], "left")
    return marked.groupBy("plan_id").agg(F.count("*").alias("steps"), F.count("ok").alias("completed")).withColumn("percent", F.round(F.col("completed") * 100.0 / F.col("steps"), 1))
