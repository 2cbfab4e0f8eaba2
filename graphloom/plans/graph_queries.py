"""Queries over the projected graphs: filters, traversal, metrics, rules, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph, class_of
from graphloom.operators import assemble, cycles, diff, iterate, layers, maps, metrics, orphans, patterns, risk, search
from graphloom.operators.query import FlowQuery, critical_paths, neighbours, node, public_nodes, trace, with_neighbours
from graphloom.plans import projections as P
from graphloom.plans.registry import query

D, S = P.DENSE_SQL, P.SPARSE_SQL
# Fixed ids that the traversal queries start from: the customer with this key.
START = 7
START_SQL = f"(SELECT id FROM nodes WHERE node_seq = {START})"

FANS_SQL = """fans AS (SELECT n.*, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out FROM nodes n
  LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id)"""
_LEVEL = "CASE WHEN fan_in > 20 OR fan_out > 15 THEN 'CRITICAL' WHEN fan_in > 10 OR fan_out > 8 THEN 'HIGH' WHEN fan_in > 5 OR fan_out > 5 THEN 'MEDIUM' ELSE 'LOW' END"
METRICS_SQL = f"{FANS_SQL}, metrics AS (SELECT *, NULL::BIGINT AS blast_radius, {_LEVEL} AS risk, least(100, floor(fan_in * 2 + fan_out * 3))::BIGINT AS complexity, fan_in + fan_out AS coupling FROM fans)"
REACH_SQL = """reach AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = r.b)"""
BLAST_SQL = f"""{REACH_SQL}, {FANS_SQL}, metrics AS (SELECT *, CASE WHEN lvl = 'CRITICAL' AND fan_in = 0 AND blast_radius = 0 THEN 'HIGH' ELSE lvl END AS risk,
  least(100, floor(fan_in * 2 + fan_out * 3 + blast_radius * 0.5::DOUBLE))::BIGINT AS complexity, fan_in + fan_out AS coupling
  FROM (SELECT f.*, coalesce(r.c, 0)::BIGINT AS blast_radius, {_LEVEL} AS lvl FROM fans f LEFT JOIN (SELECT b, count(*) AS c FROM reach WHERE a <> b GROUP BY b) r ON r.b = f.id))"""
CYCLES_SQL = """members AS (SELECT x.a AS id, least(min(x.b), x.a) AS cycle_id FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
cycles AS (SELECT cycle_id, string_agg(id, ',' ORDER BY id) AS nodes, count(*)::BIGINT AS size, count(DISTINCT split_part(id, '::', 1)) AS classes FROM members GROUP BY cycle_id),
leveled AS (SELECT cycle_id, nodes, size, CASE WHEN classes = 1 THEN 'INFO' WHEN size >= 11 THEN 'CRITICAL' WHEN size >= 6 THEN 'HIGH' WHEN size >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM cycles)"""
VIOLATIONS_SQL = """violations AS (SELECT DISTINCT e.src, e.dst, a.layer AS from_layer, b.layer AS to_layer,
  CASE WHEN a.layer = 'Domain' AND b.layer IN ('Infrastructure', 'Application') THEN 'CRITICAL' WHEN a.layer = 'Application' AND b.layer = 'Infrastructure' THEN 'HIGH' END AS severity
  FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE (a.layer = 'Domain' AND b.layer IN ('Infrastructure', 'Application')) OR (a.layer = 'Application' AND b.layer = 'Infrastructure'))"""


def start(graph: DependencyGraph) -> str:
    return graph.nodes.where(F.col("node_seq") == START).select("id").first()["id"]


def metric_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "node_seq", "fan_in", "fan_out", "risk", "complexity", "coupling")


# ---- filters -------------------------------------------------------------------------------------


@query(f"{D} SELECT id, node_seq FROM nodes WHERE starts_with(class, 'Shop\\Domain')")
def by_class_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.dense(spark, sf_dir)).by_class("Shop\\Domain").to_df().select("id", "node_seq")


@query(f"{D} SELECT id, node_seq FROM nodes WHERE method = 'c42'")
def by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.dense(spark, sf_dir)).by_method("c42").to_df().select("id", "node_seq")


@query(f"{D} SELECT id, node_seq FROM nodes WHERE starts_with(class, 'Shop\\Application\\')")
def by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.dense(spark, sf_dir)).by_namespace("Shop\\Application\\").to_df().select("id", "node_seq")


@query(f"{D} SELECT id, node_seq FROM nodes WHERE visibility = 'public'")
def public_app_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.dense(spark, sf_dir)).public_nodes().only_application_code().to_df().select("id", "node_seq")


@query(f"{D} SELECT id FROM nodes WHERE visibility = 'public' AND starts_with(class, 'Shop\\Domain\\')")
def public_in_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_nodes(P.dense(spark, sf_dir), "Shop\\Domain").select("id")


@query(f"{S} SELECT id, node_seq FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.sparse(spark, sf_dir)).entrypoints().to_df().select("id", "node_seq")


@query(f"{S} SELECT id, node_seq FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.sparse(spark, sf_dir)).leaf_nodes().to_df().select("id", "node_seq")


@query(f"{S} SELECT id, node_seq FROM nodes WHERE starts_with(class, 'Shop\\Domain\\') AND visibility = 'public' AND id NOT IN (SELECT dst FROM edges) ORDER BY node_seq LIMIT 1")
def first_public_entrypoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FlowQuery(P.sparse(spark, sf_dir)).by_namespace("Shop\\Domain").public_nodes().entrypoints().first().select("id", "node_seq")


@query(f"{D} SELECT id, class, method FROM nodes WHERE node_seq = {START}")
def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return node(g, start(g)).select("id", "class", "method")


# ---- metrics -------------------------------------------------------------------------------------


@query(f"{D}, {FANS_SQL} SELECT id, fan_in, fan_out FROM fans")
def fan_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fans(P.dense(spark, sf_dir)).select("id", "fan_in", "fan_out")


@query(f"{D}, {METRICS_SQL} SELECT id, risk FROM metrics")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.node_metrics(P.dense(spark, sf_dir), with_blast=False).select("id", "risk")


@query(f"{D}, {METRICS_SQL} SELECT id, node_seq, fan_in, fan_out, risk, complexity, coupling FROM metrics ORDER BY coupling DESC, node_seq LIMIT 10")
def top_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_columns(metrics.top_coupled(metrics.node_metrics(P.dense(spark, sf_dir), with_blast=False)))


@query(f"{D}, {METRICS_SQL} SELECT id, node_seq, fan_in, fan_out, risk, complexity, coupling FROM metrics WHERE risk IN ('HIGH', 'CRITICAL')")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_columns(metrics.hotspots(metrics.node_metrics(P.dense(spark, sf_dir), with_blast=False)))


STATS_SQL = """SELECT count(*)::BIGINT AS total_nodes, round(avg(fan_in), 2) AS avg_fan_in, round(avg(fan_out), 2) AS avg_fan_out, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out,
  (count(*) FILTER (risk IN ('HIGH', 'CRITICAL')))::BIGINT AS hotspot_count, (SELECT count(*) FROM edges)::BIGINT AS total_edges FROM metrics"""


@query(f"{D}, {METRICS_SQL} {STATS_SQL}")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return metrics.graph_stats(g, metrics.node_metrics(g, with_blast=False))


@query(f"{S}, {BLAST_SQL} SELECT id, blast_radius FROM metrics")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.blast_radius(P.sparse(spark, sf_dir))


@query(f"{S}, {BLAST_SQL} SELECT id, blast_radius, risk, complexity FROM metrics")
def full_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.node_metrics(P.sparse(spark, sf_dir)).select("id", "blast_radius", "risk", "complexity")


@query(f"""{D}, {METRICS_SQL} SELECT CASE WHEN complexity >= 51 THEN 'CRITICAL' WHEN complexity >= 21 THEN 'HIGH' WHEN complexity >= 11 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  count(*)::BIGINT AS n, max(complexity) AS max_complexity, round(avg(complexity), 2) AS avg_complexity FROM metrics GROUP BY 1""")
def complexity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.complexity_stats(metrics.node_metrics(P.dense(spark, sf_dir), with_blast=False))


@query(f"""{D} SELECT DISTINCT 'upstream' AS side, src AS id FROM edges WHERE dst = {START_SQL} UNION SELECT DISTINCT 'downstream', dst FROM edges WHERE src = {START_SQL}""")
def direct_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return metrics.direct_impact(g, start(g))


@query(f"""{D} SELECT 'caller' AS side, src AS id, type FROM edges WHERE dst = {START_SQL} AND type IN ('method_call', 'static_call', 'direct_instantiation')
  UNION ALL SELECT 'callee', dst, type FROM edges WHERE src = {START_SQL} AND type IN ('method_call', 'static_call', 'direct_instantiation')""")
def relevant_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return neighbours(g, start(g))


@query(f"""{D}, own AS (SELECT id FROM nodes WHERE class LIKE 'Shop_Domain_N0%') SELECT id FROM own UNION SELECT dst FROM edges WHERE src IN (FROM own) UNION SELECT src FROM edges WHERE dst IN (FROM own)""")
def expanded_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return with_neighbours(g, g.nodes.where(F.col("class").startswith("Shop\\Domain\\N0")).select("id"))


# ---- traversal -----------------------------------------------------------------------------------


def _depths(depth: int) -> str:
    return f"""walk AS (SELECT {START_SQL} AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM walk JOIN edges e ON e.src = walk.id WHERE depth < {depth}),
near AS (SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id)"""


@query(f"{D}, {_depths(3)} SELECT id, depth FROM near")
def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return trace(g, start(g), max_depth=3).nodes.select("id", "depth")


@query(f"{D}, {_depths(3)} SELECT DISTINCT src, dst FROM edges JOIN near ON src = near.id WHERE depth < 3")
def trace_edges_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return trace(g, start(g), max_depth=3).edges.select("src", "dst")


@query(f"""{S}, walk AS (SELECT {START_SQL} AS id, 0 AS depth UNION SELECT e.b, depth + 1 FROM walk JOIN (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) e ON e.a = walk.id WHERE depth < 5) SELECT DISTINCT id FROM walk""")
def subgraph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.query import subgraph_ids

    g = P.sparse(spark, sf_dir)
    return subgraph_ids(g, start(g), 5)


@query(f"""{S}, roots AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)),
walk AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, e.dst, depth + 1 FROM walk JOIN edges e ON e.src = walk.id WHERE depth < 6),
near AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id) SELECT root, max(depth)::INTEGER AS depth FROM near GROUP BY root""")
def critical_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every entry point, by one traversal."""
    g = P.sparse(spark, sf_dir)
    return critical_paths(g, FlowQuery(g).entrypoints().to_df(), 6).select("root", "depth")


@query(f"{S}, {REACH_SQL} SELECT a, b FROM reach")
def reachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iterate.reach(P.sparse(spark, sf_dir).edges)


# ---- cycles --------------------------------------------------------------------------------------


@query(f"{S}, {REACH_SQL}, {CYCLES_SQL} SELECT cycle_id, nodes, size, severity FROM leveled")
def cycle_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cycles(P.sparse(spark, sf_dir)).select("cycle_id", F.array_join("nodes", ",").alias("nodes"), "size", "severity")


@query(f"""{S}, {REACH_SQL}, {CYCLES_SQL} SELECT count(*)::BIGINT AS total, (count(*) FILTER (severity = 'INFO'))::BIGINT AS info, (count(*) FILTER (severity = 'LOW'))::BIGINT AS low, (count(*) FILTER (severity = 'MEDIUM'))::BIGINT AS medium,
  (count(*) FILTER (severity = 'HIGH'))::BIGINT AS high, (count(*) FILTER (severity = 'CRITICAL'))::BIGINT AS critical, coalesce(sum(size), 0)::BIGINT AS members, coalesce(max(size), 0)::BIGINT AS largest FROM leveled""")
def cycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cycle_stats(cycles.cycles(P.sparse(spark, sf_dir)))


@query(f"{S}, {REACH_SQL}, {CYCLES_SQL} SELECT id, m.cycle_id, size, severity FROM members m JOIN leveled l ON l.cycle_id = m.cycle_id")
def cycles_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cycles_of(cycles.cycles(P.sparse(spark, sf_dir)))


# ---- layers and SOLID ----------------------------------------------------------------------------


@query(f"""{D}, c AS (SELECT CASE WHEN layer = 'Other' THEN 'Unknown' ELSE layer END AS layer, count(*) AS n FROM nodes GROUP BY 1)
  SELECT l.layer, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('Domain'), ('Application'), ('Infrastructure'), ('Unknown')) l(layer) LEFT JOIN c ON c.layer = l.layer""")
def layer_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.layer_distribution(P.dense(spark, sf_dir))


@query(f"{D}, {VIOLATIONS_SQL} SELECT src, dst, from_layer, to_layer, severity FROM violations")
def arch_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.violations(P.dense(spark, sf_dir))


@query(f"{D}, {VIOLATIONS_SQL} SELECT count(*)::BIGINT AS total, (count(*) FILTER (severity = 'CRITICAL'))::BIGINT AS critical, (count(*) FILTER (severity = 'HIGH'))::BIGINT AS high, count(*) = 0 AS is_clean FROM violations")
def violation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.violation_stats(layers.violations(P.dense(spark, sf_dir)))


@query(f"{S} SELECT src_class AS class, count(DISTINCT dst_class)::BIGINT AS fan_out, CASE WHEN count(DISTINCT dst_class) > 12 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM edges WHERE src_class <> dst_class GROUP BY 1 HAVING count(DISTINCT dst_class) > 7")
def srp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.srp(P.sparse(spark, sf_dir))


def _renamed(graph: DependencyGraph, suffix: str) -> DependencyGraph:
    """The graph with a suffix on every class, so that name rules have something to find."""
    new = lambda c: F.concat(class_of(F.col(c)), F.lit(f"{suffix}::"), F.substring_index(c, "::", -1))
    nodes = graph.nodes.withColumn("id", new("id")).withColumn("class", F.concat("class", F.lit(suffix)))
    return DependencyGraph(nodes, graph.edges.withColumn("src", new("src")).withColumn("dst", new("dst")))


@query(f"{D} SELECT class || 'Port' AS class, count(*)::BIGINT AS methods, CASE WHEN count(*) > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM nodes GROUP BY 1 HAVING count(*) > 5")
def isp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.isp(_renamed(P.dense(spark, sf_dir), "Port"))


@query(f"""{D} SELECT DISTINCT e.src, e.dst, n.layer, CASE WHEN n.layer = 'Domain' THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'direct_instantiation' AND n.layer IN ('Domain', 'Application')""")
def dip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.dip(P.dense(spark, sf_dir))


@query(f"{S} SELECT src_class AS class, count(DISTINCT dst_class)::BIGINT AS instantiated, 'LOW' AS severity FROM edges WHERE type = 'direct_instantiation' AND src_class <> dst_class GROUP BY 1 HAVING count(DISTINCT dst_class) >= 3")
def ocp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.ocp(P.sparse(spark, sf_dir))


# ---- patterns ------------------------------------------------------------------------------------


@query(f"{D} SELECT dst_class || 'Policy' AS interface, count(*)::BIGINT AS implementations FROM edges WHERE type = 'interface_implementation' GROUP BY 1 HAVING count(*) >= 2")
def strategy_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.strategies(_renamed(P.dense(spark, sf_dir), "Policy"))


def _method_graph(spark: SparkSession, sf_dir: str, suffix: str, names: list[str]) -> DependencyGraph:
    """The dense graph with method names dealt out by key."""
    g = _renamed(P.dense(spark, sf_dir), suffix)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("node_seq") % len(names) + 1).cast("int"))
    return DependencyGraph(g.nodes.withColumn("method", name).withColumn("id", F.concat("class", F.lit("::"), "method")), g.edges)


@query(f"""{D} SELECT n.class || 'Repository' AS class, count(*)::BIGINT AS methods, CASE WHEN EXISTS (FROM edges e WHERE e.type = 'interface_implementation' AND e.src_class = n.class) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
  FROM nodes n WHERE node_seq % 4 IN (0, 1) GROUP BY n.class HAVING count(*) >= 2""")
def repository_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.repositories(_method_graph(spark, sf_dir, "Repository", ["findOne", "save", "other", "__get"]))


@query(f"{D} SELECT class || 'Maker' AS class, count(*)::BIGINT AS methods, 'MEDIUM' AS confidence FROM nodes WHERE node_seq % 3 IN (0, 1) GROUP BY 1 HAVING count(*) >= 2")
def factory_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.factories(_method_graph(spark, sf_dir, "Maker", ["createOne", "of", "run"]))


@query(f"{D} SELECT class || 'Subscriber' AS class, count(*)::BIGINT AS events, 'EventSubscriber' AS subtype FROM nodes WHERE node_seq % 3 IN (0, 1) GROUP BY 1")
def observer_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.observers(_method_graph(spark, sf_dir, "Subscriber", ["onPaid", "saved", "run"]))


@query(f"{D} SELECT class || 'Job' AS class, CASE WHEN bool_or(node_seq % 7 = 0) THEN 'handle' ELSE 'execute' END AS executor FROM nodes WHERE node_seq % 7 IN (0, 1) GROUP BY 1")
def command_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.commands(_method_graph(spark, sf_dir, "Job", ["handle", "execute", "__invoke", "a", "b", "c", "d"]))


@query(f"{D} SELECT src_class || 'Gateway' AS class, count(*)::BIGINT AS interfaces FROM edges WHERE type = 'interface_implementation' GROUP BY 1")
def adapter_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.adapters(_renamed(P.dense(spark, sf_dir), "Gateway"))


# ---- orphans -------------------------------------------------------------------------------------

_CALLED = "coalesce(c.called, FALSE)"
ORPHANS_SQL = f"""{FANS_SQL}, called AS (SELECT DISTINCT dst_class AS class, TRUE AS called FROM edges WHERE src_class <> dst_class),
orphans AS (SELECT f.id, f.fan_out, least(20, 10 + CASE WHEN fan_out = 0 THEN 6 ELSE 0 END + CASE WHEN layer <> 'Infrastructure' THEN 2 ELSE 0 END + 2 - CASE WHEN {_CALLED} THEN 4 ELSE 0 END) / 20.0::DOUBLE AS confidence
  FROM fans f LEFT JOIN called c USING (class) WHERE fan_in = 0)"""


@query(f"{S}, {ORPHANS_SQL} SELECT id, confidence, round(confidence * 100)::INTEGER AS percent, CASE WHEN confidence >= 0.8 THEN 'VERY_HIGH' WHEN confidence >= 0.6 THEN 'HIGH' WHEN confidence >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level, confidence >= 0.8 AS safe_to_remove FROM orphans")
def orphan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(P.sparse(spark, sf_dir)).select("id", "confidence", "percent", "level", "safe_to_remove")


@query(f"{S}, {ORPHANS_SQL} SELECT count(*)::BIGINT AS total, (count(*) FILTER (confidence > 0.7::DOUBLE))::BIGINT AS high_confidence, (count(*) FILTER (confidence >= 0.6::DOUBLE))::BIGINT AS high_or_more, round(avg(confidence), 4) AS avg_confidence FROM orphans")
def orphan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_stats(orphans.orphans(P.sparse(spark, sf_dir)))


@query(f"{S}, {FANS_SQL} SELECT id, fan_in, CASE WHEN fan_in = 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM fans WHERE fan_out = 0")
def suspicious_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.suspicious_leaves(P.sparse(spark, sf_dir))


# ---- risk ----------------------------------------------------------------------------------------

RISK_SQL = f"""{BLAST_SQL}, {CYCLES_SQL}, {VIOLATIONS_SQL}, touched AS (SELECT id, count(*) AS violation_count FROM (SELECT src AS id FROM violations UNION ALL SELECT dst FROM violations WHERE src <> dst) GROUP BY id),
rows AS (SELECT m.id, m.fan_in, m.fan_out, m.blast_radius, (SELECT count(*) FROM members x WHERE x.id = m.id)::BIGINT AS cycle_count, coalesce(t.violation_count, 0)::BIGINT AS violation_count FROM metrics m LEFT JOIN touched t ON t.id = m.id),
scored AS (SELECT *, least(100, round((3.0::DOUBLE * blast_radius + 2.0::DOUBLE * fan_in + 1.5::DOUBLE * fan_out + 10.0::DOUBLE * cycle_count + 8.0::DOUBLE * violation_count) / 200.0::DOUBLE * 100))::BIGINT AS score FROM rows)"""


@query(f"{S}, {RISK_SQL} SELECT id, cycle_count, violation_count, score, CASE WHEN score <= 25 THEN 'LOW' WHEN score <= 50 THEN 'MEDIUM' WHEN score <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM scored")
def change_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.change_risk(P.sparse(spark, sf_dir)).select("id", "cycle_count", "violation_count", "score", "level")


SAFETY_SQL = f"""{REACH_SQL}, {FANS_SQL}, {CYCLES_SQL}, {VIOLATIONS_SQL}, near AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges), scope AS (FROM near UNION SELECT id, id FROM nodes),
safety AS (SELECT n.id, (SELECT count(*) FROM near x WHERE x.id = n.id)::BIGINT AS affected, (SELECT count(DISTINCT m.cycle_id) FROM scope s JOIN members m ON m.id = s.other WHERE s.id = n.id)::BIGINT AS cycles,
  (SELECT count(DISTINCT (v.src, v.dst)) FROM scope s JOIN violations v ON v.src = s.other OR v.dst = s.other WHERE s.id = n.id)::BIGINT AS violations,
  (SELECT count(DISTINCT e.dst) FROM edges e JOIN fans f ON f.id = e.dst WHERE e.src = n.id AND f.fan_in <= 1)::BIGINT AS potential_orphans FROM nodes n),
scored AS (SELECT *, affected * 2 + cycles * 10 + violations * 8 + potential_orphans * 3 AS score FROM safety)"""


@query(f"{S}, {SAFETY_SQL} SELECT id, affected, cycles, violations, potential_orphans, score, CASE WHEN score >= 50 THEN 'CRITICAL' WHEN score >= 30 THEN 'HIGH' WHEN score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM scored")
def refactor_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.refactor_safety(P.sparse(spark, sf_dir))


_FINDINGS = """findings AS (SELECT id AS node_id, CASE WHEN node_seq % 9 = 0 THEN 'graceful_degradation' ELSE 'exception_swallowing' END AS type, (node_seq % 10) / 10.0::DOUBLE AS confidence FROM nodes
  UNION ALL SELECT 'gone::x' || node_seq, 'resource_leak', 0.8::DOUBLE FROM nodes WHERE node_seq <= 20)"""
BUGS_SQL = f"""{BLAST_SQL}, {_FINDINGS}, scored AS (SELECT f.*, CASE WHEN f.type = 'graceful_degradation' THEN 0 ELSE least(100, CASE WHEN m.id IS NULL THEN round(confidence * 20) ELSE round(confidence * (1 + 2 * fan_in + blast_radius / 10.0::DOUBLE)) END) END::BIGINT AS bug_score
  FROM findings f LEFT JOIN metrics m ON m.id = f.node_id), bugs AS (SELECT *, CASE WHEN type = 'graceful_degradation' THEN 'INFO' WHEN bug_score >= 70 THEN 'CRITICAL' WHEN bug_score >= 40 THEN 'HIGH' WHEN bug_score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM scored)"""


def findings(graph: DependencyGraph) -> DataFrame:
    n = graph.nodes
    kind = F.when(F.col("node_seq") % 9 == 0, "graceful_degradation").otherwise("exception_swallowing")
    own = n.select(F.col("id").alias("node_id"), kind.alias("type"), ((F.col("node_seq") % 10) / F.lit(10.0)).alias("confidence"))
    gone = n.where("node_seq <= 20").select(F.concat(F.lit("gone::x"), F.col("node_seq").cast("string")), F.lit("resource_leak"), F.lit(0.8))
    return own.union(gone)


@query(f"{S}, {BUGS_SQL} SELECT node_id, type, confidence, bug_score, severity FROM bugs")
def bug_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.sparse(spark, sf_dir)
    return risk.bug_scores(findings(g), metrics.node_metrics(g))


@query(f"""{S}, {BUGS_SQL} SELECT (count(*) FILTER (severity <> 'INFO'))::BIGINT AS total, (count(*) FILTER (severity = 'INFO'))::BIGINT AS info, (count(*) FILTER (severity = 'LOW'))::BIGINT AS low, (count(*) FILTER (severity = 'MEDIUM'))::BIGINT AS medium,
  (count(*) FILTER (severity = 'HIGH'))::BIGINT AS high, (count(*) FILTER (severity = 'CRITICAL'))::BIGINT AS critical FROM bugs""")
def bug_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.sparse(spark, sf_dir)
    return risk.bug_stats(risk.bug_scores(findings(g), metrics.node_metrics(g)))


@query("""WITH RECURSIVE links AS (SELECT 'nation::k' || n_nationkey AS src, 'region::k' || n_regionkey AS dst FROM nation UNION SELECT 'customer::k' || c_custkey, 'nation::k' || c_nationkey FROM customer
  UNION SELECT 'supplier::k' || s_suppkey, 'nation::k' || s_nationkey FROM supplier UNION SELECT 'part::k' || l_partkey, 'supplier::k' || l_suppkey FROM lineitem),
ids AS (SELECT src AS id FROM links UNION SELECT dst FROM links), up AS (SELECT id, 1 AS phase FROM ids UNION SELECT l.src, phase + 1 FROM up JOIN links l ON l.dst = up.id)
SELECT id, max(phase)::INTEGER AS phase, FALSE AS conflict FROM up GROUP BY id""")
def refactor_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.refactor_phases(P.keys(spark, sf_dir))


@query(f"""{D}, {METRICS_SQL}, {VIOLATIONS_SQL}, p AS (SELECT 0 AS part, 'violation' AS kind, src || '->' || dst AS target, CASE WHEN severity = 'CRITICAL' THEN 0 ELSE 1 END AS priority, 0::BIGINT AS weight FROM violations
  UNION ALL SELECT 1, 'hotspot', id, CASE WHEN risk = 'CRITICAL' THEN 0 ELSE 1 END, -complexity FROM metrics WHERE risk IN ('HIGH', 'CRITICAL')) SELECT kind, target, priority FROM p ORDER BY part, priority, weight, target LIMIT 10""")
def remediation_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    m = metrics.node_metrics(g, with_blast=False)
    return risk.remediation(layers.violations(g), metrics.hotspots(m)).select("kind", "target", "priority")


# ---- snapshots -----------------------------------------------------------------------------------

_OLD = "o_orderkey % 10 <> 0"


def _snapshot_sql(where: str, tail: str) -> str:
    return f"WITH {P.NODES_SQL}, {P.hops_sql(where)}, {tail}"


def _both(tail: str, columns: str) -> str:
    """CTEs old_ and new_ with the columns of ``tail``'s last table t."""
    old, new = (f"(WITH {P.NODES_SQL}, {P.hops_sql(w)}, {tail} SELECT {columns} FROM t)" for w in (_OLD, "TRUE"))
    return f"WITH o AS {old}, n AS {new}"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DependencyGraph, DependencyGraph]:
    return P.dense(spark, sf_dir, _OLD), P.dense(spark, sf_dir)


_VALUES = "unnest([{metric: 'total_nodes', v: total_nodes::DOUBLE}, {metric: 'total_edges', v: total_edges::DOUBLE}, {metric: 'avg_fan_in', v: avg_fan_in}, {metric: 'avg_fan_out', v: avg_fan_out}, {metric: 'max_fan_in', v: max_fan_in::DOUBLE}, {metric: 'max_fan_out', v: max_fan_out::DOUBLE}, {metric: 'hotspot_count', v: hotspot_count::DOUBLE}]) AS s"
_DELTAS = f"{_both(f'{METRICS_SQL}, t AS ({STATS_SQL})', _VALUES)}, deltas AS (SELECT n.s.metric AS metric, o.s.v AS old, n.s.v AS new, round(n.s.v - o.s.v, 2) AS delta FROM n JOIN o ON o.s.metric = n.s.metric)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (diff.long_form(metrics.graph_stats(g, metrics.node_metrics(g, with_blast=False))) for g in _snapshots(spark, sf_dir))
    return diff.metric_deltas(old, new)


@query(f"{_DELTAS} SELECT metric, old, new, delta FROM deltas")
def snapshot_metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@query(f"{_DELTAS} SELECT (count(*) FILTER (delta < 0))::BIGINT AS improved, (count(*) FILTER (delta > 0))::BIGINT AS degraded, (count(*) FILTER (delta = 0))::BIGINT AS unchanged FROM deltas")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary(_deltas(spark, sf_dir))


@query(f"{_both(f'{VIOLATIONS_SQL}, t AS (FROM violations)', 'src, dst')} SELECT src, dst, 'new' AS status FROM n ANTI JOIN o USING (src, dst) UNION ALL SELECT src, dst, 'resolved' FROM o ANTI JOIN n USING (src, dst)")
def violation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (layers.violations(g) for g in _snapshots(spark, sf_dir))
    return diff.new_and_resolved(old, new, ["src", "dst"])


@query(f"""{_both(f'{METRICS_SQL}, t AS (FROM metrics)', 'id, complexity')} SELECT id, o.complexity AS old, n.complexity AS new, n.complexity - o.complexity AS delta, CASE WHEN n.complexity < o.complexity THEN 'improved' ELSE 'degraded' END AS change FROM o JOIN n USING (id) WHERE n.complexity <> o.complexity""")
def complexity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.complexity_changes(*(metrics.node_metrics(g, with_blast=False) for g in _snapshots(spark, sf_dir)))


@query(f"""{_both('t AS (FROM edges)', 'src, dst, type, method')} SELECT 'node' AS what, 'added' AS status, 0::BIGINT AS n UNION ALL SELECT 'node', 'removed', 0 UNION ALL SELECT 'edge', 'added', (SELECT count(*) FROM n ANTI JOIN o USING (src, dst, type, method)) UNION ALL SELECT 'edge', 'removed', (SELECT count(*) FROM o ANTI JOIN n USING (src, dst, type, method))""")
def flow_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return diff.flow_diff(old.nodes, old.edges, new.nodes, new.edges)


@query(f"{_both(f'{VIOLATIONS_SQL}, t AS (FROM violations)', 'src, dst')} SELECT count(*)::BIGINT AS counted, count(*) = 0 AS passed FROM n ANTI JOIN o USING (src, dst)")
def gate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (layers.violations(g) for g in _snapshots(spark, sf_dir))
    return diff.gate(new, "new", old)


@query(f"""{_both('t AS (FROM edges)', "src || '->' || dst AS key")}, a AS (SELECT DISTINCT key FROM o), b AS (SELECT DISTINCT key FROM n)
SELECT (SELECT count(*) FROM b ANTI JOIN a USING (key))::BIGINT AS added, (SELECT count(*) FROM a ANTI JOIN b USING (key))::BIGINT AS removed, (SELECT count(*) FROM a)::BIGINT AS total_baseline, (SELECT count(*) FROM b)::BIGINT AS total_current, ((SELECT count(*) FROM b) - (SELECT count(*) FROM a))::BIGINT AS delta""")
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (g.edges.select(F.concat_ws("->", "src", "dst").alias("key")) for g in _snapshots(spark, sf_dir))
    return diff.set_drift(old, new, "key")


# ---- assembly, maps, search ----------------------------------------------------------------------


@query(f"""WITH {P.NODES_SQL}, raw AS (SELECT class AS id, min(node_seq) AS node_seq, max_by(method, node_seq) AS method, count(*) > 1 AS repeated FROM nodes GROUP BY class) SELECT id, node_seq, method, repeated FROM raw""")
def dedupe_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.customer_nodes(spark, sf_dir).withColumn("id", F.col("class"))
    return assemble.dedupe(n).select("id", "node_seq", "method", "repeated")


@query(f"""{D}, kept AS (SELECT e.edge_seq, e.src, e.type, CASE WHEN e.type <> 'static_call' THEN e.dst WHEN n.node_seq % 2 = 0 THEN 'func:Shop\\' || n.method ELSE 'func:' || n.method END AS dst FROM edges e JOIN nodes n ON n.id = e.dst
  WHERE NOT (e.type = 'property_access' AND n.node_seq % 2 = 1) AND NOT (e.type = 'static_call' AND n.node_seq % 2 = 1 AND n.node_seq % 3 <> 0)) FROM kept""")
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property edges stand for includes, static calls for calls of functions in a namespace; every other target is unknown, some of those are known globally."""
    g = P.dense(spark, sf_dir)
    own = F.concat(F.lit("func:Shop\\"), F.col("method"))
    even, odd = g.nodes.where("node_seq % 2 = 0"), g.nodes.where("node_seq % 2 = 1 and node_seq % 3 = 0")
    known = even.select("id").union(even.select(own)).union(odd.select(F.concat(F.lit("func:"), "method")))
    kind = F.when(F.col("type") == "property_access", "include").when(F.col("type") == "static_call", "function_call").otherwise(F.col("type"))
    raw = g.edges.withColumn("dst", F.when(F.col("type") == "static_call", own).otherwise(F.col("dst"))).withColumn("was", F.col("type")).withColumn("type", kind)
    return assemble.resolve_edges(raw, known).select("edge_seq", "src", "dst", F.col("was").alias("type"))


@query(f"{D}, {FANS_SQL} SELECT class AS name, count(*)::BIGINT AS methods, max(fan_in) AS fan_in, sum(fan_in)::BIGINT AS fan_in_sum, sum(fan_out)::BIGINT AS fan_out_sum FROM fans WHERE contains(lower(class), 'domain') GROUP BY class ORDER BY min(node_seq) LIMIT 10")
def find_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_classes(metrics.fans(P.dense(spark, sf_dir)), "DOMAIN", 10).select("name", "methods", "fan_in", "fan_in_sum", "fan_out_sum")


@query(f"""{D}, {FANS_SQL}, hit AS (SELECT 0 AS section, class AS name, min(node_seq) AS seq, sum(fan_in)::BIGINT AS fan_in, sum(fan_out)::BIGINT AS fan_out FROM fans WHERE contains(lower(class), 'n12') GROUP BY class
  UNION ALL SELECT 1, id, node_seq, fan_in, fan_out FROM fans WHERE contains(lower(method), 'n12') AND NOT contains(lower(class), 'n12')) SELECT section, name, fan_in, fan_out FROM hit ORDER BY section, seq LIMIT 10""")
def lookup_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup(metrics.fans(P.dense(spark, sf_dir)), "N12", 10).where("section < 2").select("section", "name", "fan_in", "fan_out")


@query(f"""{S}, {FANS_SQL} SELECT 'Shop\\' || layer AS area, count(*)::BIGINT AS nodes, (count(*) FILTER (fan_in = 0))::BIGINT AS entrypoints, 'php' AS languages FROM fans GROUP BY 1""")
def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.area_rollup(P.sparse(spark, sf_dir)).select("area", "nodes", "entrypoints", "languages")


@query(f"""{D}, x AS (SELECT 'Shop\\' || a.layer AS sa, 'Shop\\' || b.layer AS sb FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)
  SELECT area, count(*)::BIGINT AS n FROM (SELECT sb AS area FROM x WHERE sa = 'Shop\\Domain' AND sb <> sa UNION ALL SELECT sa FROM x WHERE sb = 'Shop\\Domain' AND sb <> sa) GROUP BY area""")
def related_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.related_areas(P.dense(spark, sf_dir), "Shop\\Domain")


@query(f"""{D} SELECT split_part(class, '\\', 1) || '\\' || split_part(class, '\\', 2) AS namespace, count(DISTINCT class)::BIGINT AS classes FROM nodes GROUP BY 1 ORDER BY classes DESC, namespace LIMIT 5""")
def structure_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.namespaces(P.dense(spark, sf_dir), 5)


@query(f"""{S}, {REACH_SQL}, {CYCLES_SQL}, {VIOLATIONS_SQL}, own AS (SELECT id FROM nodes WHERE starts_with(class, 'Shop\\Domain\\')) SELECT 'violations' AS report, count(*)::BIGINT AS n FROM violations WHERE src IN (FROM own) OR dst IN (FROM own)
  UNION ALL SELECT 'cycles', count(DISTINCT cycle_id) FROM members WHERE id IN (FROM own)""")
def context_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.sparse(spark, sf_dir)
    return search.scoped_counts(FlowQuery(g).by_namespace("Shop\\Domain").to_df().select("id"), layers.violations(g), cycles.cycles(g))
