"""Queries over assembly, policies, maps, catalogue, comparison and search that need made-up columns beside the projected graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import METADATA, DependencyGraph
from graphloom.operators import assemble, diff, maps, metrics, orphans, risk, search, services
from graphloom.operators import query as Q
from graphloom.plans import projections as P
from graphloom.plans.graph_queries import FANS_SQL, START_SQL, start
from graphloom.plans.registry import query
from graphloom.streaming import events as E

D, S = P.DENSE_SQL, P.SPARSE_SQL

def seq() -> Column:
    return F.col("node_seq")


def with_metadata(nodes: DataFrame, **columns: Column) -> DataFrame:
    fields = [(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA]
    return nodes.withColumn("metadata", F.struct(*fields))


def _pick(*values, by: Column | None = None) -> Column:
    rest = (seq() if by is None else by) % len(values)
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (rest + 1).cast("int"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ---- queries and symbols


@query(f"{D} SELECT id FROM nodes WHERE starts_with(class, 'Shop\\Domain\\') AND visibility = 'public'")
def definition_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    plain = Q.FlowQuery(g).by_namespace("Shop\\Domain").public_nodes().describe("public domain").to_definition()
    return Q.FlowQuery.from_definition(g, plain).to_df().select("id")


def _with_symbols(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    g = P.dense(spark, sf_dir)
    s = g.nodes.select(seq().alias("symbol_seq"), "id", F.concat(F.lit("Make"), "method").alias("name"), F.lit("function").alias("kind"), "file", "line", F.lit(None).cast("string").alias("source_module"))
    return DependencyGraph(g.nodes, g.edges, s)


@query("SELECT c_custkey AS symbol_seq, 'Makec' || c_custkey AS name FROM customer WHERE contains('makec' || c_custkey, 'kec12') ORDER BY c_custkey LIMIT 20")
def symbols_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find_symbols(_with_symbols(spark, sf_dir), "KEC12", 20).select("symbol_seq", "name")


@query("SELECT c_custkey AS symbol_seq, 'Makec' || c_custkey AS name FROM customer WHERE c_custkey = 11")
def symbols_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.symbols_named(_with_symbols(spark, sf_dir), "MAKEC11").select("symbol_seq", "name")


@query(f"""{D}, own AS (SELECT src, dst FROM edges WHERE type IN ('method_call', 'static_call')), walk AS (SELECT {START_SQL} AS id, 0 AS depth UNION SELECT o.dst, depth + 1 FROM walk JOIN own o ON o.src = walk.id WHERE depth < 3)
  SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id""")
def trace_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return Q.FlowQuery(g).from_(start(g)).downstream().max_depth(3).edge_types("method_call", "static_call").trace().nodes.select("id", "depth")


@query(f"""{D}, walk AS (SELECT {START_SQL} AS id, 0 AS depth UNION SELECT e.src, depth + 1 FROM walk JOIN edges e ON e.dst = walk.id WHERE depth < 2) SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id""")
def trace_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return Q.FlowQuery(g).from_(start(g)).upstream().max_depth(2).trace().nodes.select("id", "depth")


# ---- assembly


@query(f"WITH {P.NODES_SQL} SELECT id, CASE WHEN node_seq % 3 = 0 THEN 'hidden' ELSE 'public' END AS visibility, TRUE AS visibility_evaluated FROM nodes")
def visibility_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.visibility(P.customer_nodes(spark, sf_dir), F.when(seq() % 3 == 0, "hidden")).select("id", "visibility", "visibility_evaluated")


@query(f"""WITH {P.NODES_SQL}, n AS (SELECT layer AS class, 'm' || node_seq % 50 AS method, file, node_seq FROM nodes), many AS (SELECT class, method FROM n GROUP BY ALL HAVING count(DISTINCT file) > 1)
SELECT node_seq, class || CASE WHEN m.class IS NULL THEN '' ELSE '@' || file END || '::' || n.method AS id FROM n LEFT JOIN many m USING (class, method)""")
def qualified_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.customer_nodes(spark, sf_dir)
    cls, method = F.split_part("class", F.lit("\\"), F.lit(2)), F.concat(F.lit("m"), (seq() % 50).cast("string"))
    rows = n.withColumn("class", cls).withColumn("method", method).withColumn("id", F.concat("class", F.lit("::"), "method"))
    return assemble.qualify(rows).select("node_seq", "id")


@query("""WITH RECURSIVE inc AS (SELECT 'f' || n_nationkey AS a, 'f' || (n_nationkey + 1) AS b FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'f' || n_nationkey, 'f' || (n_nationkey + 2) FROM nation WHERE n_nationkey % 4 = 1),
clo AS (SELECT a, b FROM inc UNION SELECT c.a, i.b FROM clo c JOIN inc i ON i.a = c.b), cand AS (SELECT DISTINCT c_mktsegment AS name, 'f' || c_nationkey AS file FROM customer WHERE (c_nationkey + length(c_mktsegment)) % 2 = 0), refs AS (SELECT DISTINCT 'f' || c_nationkey AS src_file, c_mktsegment AS name FROM customer),
x AS (SELECT r.src_file, r.name, c.file, c.file = r.src_file AS own, EXISTS (FROM clo WHERE clo.a = r.src_file AND clo.b = c.file) AS near FROM refs r JOIN cand c ON c.name = r.name), y AS (SELECT *, bool_or(own) OVER w AS has_own, sum(near::INTEGER) OVER w AS n FROM x WINDOW w AS (PARTITION BY src_file, name))
SELECT src_file, name, name || '@' || file AS id, NOT has_own AND n <> 1 AS ambiguous FROM y WHERE CASE WHEN has_own THEN own WHEN n = 1 THEN near ELSE TRUE END""")
def ambiguous_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = P.table(spark, sf_dir, "customer"), P.table(spark, sf_dir, "nation")
    file = F.concat(F.lit("f"), _text("c_nationkey"))
    step = lambda k: F.concat(F.lit("f"), (F.col("n_nationkey") + k).cast("string"))
    inc = n.where("n_nationkey % 3 = 0").select(step(0).alias("src"), step(1).alias("dst")).union(n.where("n_nationkey % 4 = 1").select(step(0), step(2)))
    cand = c.where("(c_nationkey + length(c_mktsegment)) % 2 = 0").select(F.col("c_mktsegment").alias("name"), file.alias("file")).distinct().withColumn("id", F.concat("name", F.lit("@"), "file"))
    return assemble.resolve_ambiguous(c.select(file.alias("src_file"), F.col("c_mktsegment").alias("name")).distinct(), cand, inc)


@query("SELECT 'file:src/' || c_custkey AS id, 'src/' || c_custkey AS path FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def included_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even files are included, every third is a node already, every fifth was not scanned."""
    c = P.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("src/"), _text("c_custkey")).alias("path"))
    edges = c.where("c_custkey % 2 = 0").select(F.lit("file:main").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("include").alias("type"))
    return assemble.included_files(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("file:"), "path").alias("id")), edges, c.where("c_custkey % 5 <> 0").select("path"))


_SERVED = "served AS (SELECT 'h::s' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, CASE WHEN n_nationkey < 20 THEN '/n/' || n_nationkey ELSE '/v' || n_nationkey || '/{id}' END AS route, n_nationkey AS seq FROM nation)"
_CALLED = "called AS (SELECT c_custkey AS edge_seq, 'c::c' || c_custkey AS src, CASE WHEN c_custkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb, CASE WHEN c_custkey % 3 = 0 THEN '/v' || c_nationkey || '/' || c_custkey ELSE '/n/' || c_nationkey END AS path FROM customer)"


@query(f"""WITH {_SERVED}, {_CALLED}, hit AS (SELECT c.edge_seq, c.src, s.id AS dst FROM called c JOIN served s ON s.verb = c.verb AND (s.route = c.path OR (s.seq >= 20 AND regexp_matches(c.path, '^/v' || s.seq || '/[^/]+$'))))
SELECT edge_seq, src, 'http:' || verb || ':' || path AS dst FROM called UNION ALL SELECT edge_seq, src, dst FROM hit""")
def route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "customer")
    key = F.col("n_nationkey")
    route = F.when(key < 20, F.concat(F.lit("/n/"), key.cast("string"))).otherwise(F.concat(F.lit("/v"), key.cast("string"), F.lit("/{id}")))
    nodes = with_metadata(n.select(F.concat(F.lit("h::s"), key.cast("string")).alias("id"), key.cast("long").alias("node_seq"), route.alias("r"), F.when(key % 2 == 0, "get").otherwise("POST").alias("v")), http_method=F.col("v"), http_path=F.col("r"))
    k = F.col("c_custkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/v"), _text("c_nationkey"), F.lit("/"), k.cast("string"))).otherwise(F.concat(F.lit("/n/"), _text("c_nationkey")))
    verb = F.when(k % 2 == 0, "GET").otherwise("POST")
    edges = c.select(k.cast("long").alias("edge_seq"), F.concat(F.lit("c::c"), k.cast("string")).alias("src"), F.concat(F.lit("http:"), verb, F.lit(":"), path).alias("dst"), F.lit("fetch").alias("method"), F.lit("http_call").alias("type"))
    return assemble.resolve_routes(edges, nodes).select("edge_seq", "src", "dst")


@query("""SELECT c_custkey AS edge_seq, CASE WHEN c_custkey % 2 = 0 AND c_nationkey < 20 THEN 'class' || c_nationkey || 'a' WHEN c_custkey % 2 = 1 THEN 'fn' || c_nationkey || 'b' ELSE 'ts_import:m::K' || c_nationkey END AS dst FROM customer""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key is exported twice: of classes the first export counts, of functions the last."""
    c, n = P.table(spark, sf_dir, "customer"), P.table(spark, sf_dir, "nation")
    key = lambda col, letter: F.concat(F.lit(f"ts_import:m::{letter}"), _text(col))
    dst = F.when(F.col("c_custkey") % 2 == 0, key("c_nationkey", "K")).otherwise(key("c_nationkey", "F"))
    edges = c.select(F.col("c_custkey").alias("edge_seq"), F.lit("x").alias("src"), dst.alias("dst"), F.lit("m").alias("method"), F.lit("import_call").alias("type"))
    out = []
    for letter, kind, name, rows in (("K", "class", "class", n.where("n_nationkey < 20")), ("F", "function", "fn", n)):
        for nth, tail in ((1, "a"), (2, "b")):
            out.append(rows.select(key("n_nationkey", letter).alias("key"), F.concat(F.lit(name), _text("n_nationkey"), F.lit(tail)).alias("id"), F.lit(kind).alias("kind"), F.lit(nth).alias("seq")))
    exports = out[0].union(out[1]).union(out[2]).union(out[3])
    return assemble.resolve_imports(edges, exports).select("edge_seq", "dst")


def _fingerprints(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0" if old else "c_custkey % 5 <> 0")
    content = F.when(F.lit(old) | (F.col("c_custkey") % 3 != 0), F.col("c_mktsegment")).otherwise(F.lit("new"))
    path = F.concat(F.lit("src/"), _text("c_custkey"))
    return c.select(path.alias("path"), assemble.fingerprint(path, content, "v1").alias("fingerprint"))


@query("SELECT 'src/' || c_custkey AS path FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 3 = 0)")
def files_to_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.to_parse(_fingerprints(spark, sf_dir, False), _fingerprints(spark, sf_dir, True)).select("path")


@query("""SELECT 'src/' || c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 'new' WHEN c_custkey % 5 = 0 THEN 'deleted' ELSE 'changed' END AS status FROM customer
  WHERE NOT (c_custkey % 7 = 0 AND c_custkey % 5 = 0) AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0)""")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.staleness(_fingerprints(spark, sf_dir, True), _fingerprints(spark, sf_dir, False))


@query(f"WITH {P.NODES_SQL} SELECT id, CASE WHEN node_seq % 3 = 0 THEN 'hidden' ELSE 'public' END AS visibility, CASE WHEN node_seq % 3 = 0 THEN 'deny' END AS first, CASE WHEN node_seq % 2 = 0 THEN 'allow' END AS second FROM nodes")
def policy_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = [("names", F.when(seq() % 3 == 0, "deny")), ("layers", F.when(seq() % 2 == 0, "allow"))]
    found = assemble.compose_policies(P.customer_nodes(spark, sf_dir), policies, strict=False)
    return found.select("id", "visibility", F.col("decisions")[0]["decision"].alias("first"), F.col("decisions")[1]["decision"].alias("second"))


# ---- entry points and orphans


@query("SELECT 'region::k' || r_regionkey AS id FROM region")
def leaf_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.FlowQuery(P.keys(spark, sf_dir)).leaf_nodes().to_df().select("id")


@query("SELECT 'region::k' || r_regionkey AS id, count(*)::BIGINT AS fan_in, 0.3::DOUBLE AS confidence FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def suspicious_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.suspicious_leaves(P.keys(spark, sf_dir))


_KINDS = ("handle", "__invoke", "getNameProperty", "scopeActive", "fromArray", "withName", "toArray", "plain", "render", "posts")


def _entry_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    g = P.sparse(spark, sf_dir)
    n = g.nodes.withColumn("class", F.concat(F.lit("Shop\\T"), (seq() % 40).cast("string"))).withColumn("method", _pick(*_KINDS)).withColumn("id", F.concat("class", F.lit("::"), "method", F.lit("#"), seq().cast("string")))
    meta = with_metadata(n, returnType=F.when(F.col("method") == "posts", "Illuminate\\HasMany"), attributes=F.when(seq() % 50 == 7, F.array(F.lit("Route"))), entrypoint_type=F.when(seq() % 90 == 17, "http"))
    return DependencyGraph(meta, g.edges.limit(0))


@query("""WITH n AS (SELECT c_custkey AS node_seq, c_custkey % 10 AS m FROM customer) SELECT node_seq, m IN (0, 1, 2, 3, 4, 8, 9) OR (m = 7 AND (node_seq % 50 = 7 OR node_seq % 90 = 17)) AS entry, m IN (5, 6) AS utility FROM n""")
def entry_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by name, attribute, return type and kind."""
    return orphans.with_interfaces(_entry_graph(spark, sf_dir)).select("node_seq", orphans.is_entry().alias("entry"), orphans.is_utility().alias("utility"))


@query("""SELECT c_custkey AS node_seq FROM customer WHERE c_custkey % 10 = 7 AND c_custkey % 50 <> 7 AND c_custkey % 90 <> 17""")
def unmarked_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(_entry_graph(spark, sf_dir)).select("node_seq")


@query("""SELECT 'Shop\\A::m' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'false_positive' WHEN c_custkey % 4 = 1 THEN 'investigate' WHEN c_custkey % 2 = 0 THEN 'abandoned' ELSE 'investigate' END AS class FROM customer""")
def orphan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth orphan is called in the code, the next one named in the docs; even ones are safe to remove."""
    c = P.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    found = c.select(F.concat(F.lit("Shop\\A::m"), k.cast("string")).alias("id"), (k % 2 == 0).alias("safe_to_remove"))
    said = c.where(k % 4 == 0).select(F.lit("internal").alias("scope"), F.concat(F.lit("$x->m"), k.cast("string"), F.lit("();")).alias("content"))
    named = c.where(k % 4 == 1).select(F.lit("docs"), F.concat(F.lit("see A::m"), k.cast("string")))
    return orphans.audit(found, said.union(named)).select("id", "class")


def _typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.customer_nodes(spark, sf_dir)
    cls = F.concat(F.lit("App\\N"), seq().cast("string"), _pick("Controller", "Listener", "", "", "Command", "Livewire", ""))
    method = _pick("show", "on", "plain", "cli", "handle", "draw", "queue")
    kind = F.when(seq() % 7 == 3, "cli").when(seq() % 7 == 6, "async")
    return with_metadata(n.withColumn("class", cls).withColumn("method", method).withColumn("id", F.concat("class", F.lit("::"), "method")), entrypoint_type=kind)


@query("""SELECT c_custkey AS node_seq, CASE c_custkey % 7 WHEN 0 THEN 'http' WHEN 1 THEN 'event' WHEN 3 THEN 'cli' WHEN 4 THEN 'cli' WHEN 5 THEN 'ui' ELSE 'event' END AS entry_type FROM customer WHERE c_custkey % 7 <> 2""")
def actionable_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _typed_nodes(spark, sf_dir)
    return maps.actionable_entrypoints(DependencyGraph(n, P.dense(spark, sf_dir).edges.limit(0))).select("node_seq", "entry_type")


@query("""SELECT c_custkey AS node_seq, CASE c_custkey % 7 WHEN 0 THEN 'http' WHEN 1 THEN 'event' WHEN 2 THEN 'custom' WHEN 3 THEN 'cli' WHEN 4 THEN 'cli' WHEN 5 THEN 'livewire' ELSE 'event' END AS entry_type FROM customer""")
def cli_entry_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_nodes(spark, sf_dir).select("node_seq", maps.entry_type(cli=True).alias("entry_type"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 IN (0, 2) THEN 'cli' ELSE 'http' END AS kind FROM customer")
def script_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _pick("bin/run.php", "public/bins/x.php", "app/console/y.php", "cron.php", by=F.col("c_custkey"))
    return P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), maps.script_type(path).alias("kind"))


# ---- services


@query(f"""WITH {P.NODES_SQL} SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 3 <> 2 THEN (SELECT arg_min(n.id, (length(n.id), n.id)) FROM nodes n WHERE n.file = 'src/Domain/' || c_mktsegment || '.php') END AS id FROM orders JOIN customer ON c_custkey = o_custkey""")
def php_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders").join(P.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seg = F.col("c_mktsegment")
    path = _pick(F.concat(F.lit("/src/Domain/"), seg, F.lit(".php")), F.concat(F.lit("Domain/"), seg, F.lit(".php")), F.concat(F.lit("/gone/"), seg, F.lit(".php")), by=F.col("o_orderkey"))
    return services.match_files(o.select(F.col("o_orderkey").alias("call_id"), path.alias("path")), P.customer_nodes(spark, sf_dir)).select("call_id", "id")


@query("""SELECT 'box' || c_custkey AS container, CASE c_custkey % 3 WHEN 0 THEN 'N' || c_nationkey WHEN 1 THEN 'N' || c_nationkey END AS service FROM customer""")
def docker_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = P.table(spark, sf_dir, "customer"), P.table(spark, sf_dir, "nation")
    own = n.select(F.concat(F.lit("N"), _text("n_nationkey")).alias("name"), F.concat(F.lit("/srv/"), _text("n_nationkey")).alias("root"))
    k = F.col("c_custkey")
    keys = F.when(k % 3 == 0, F.array(F.lit("zz"), F.concat(F.lit("n"), _text("c_nationkey")))).otherwise(F.array(F.lit("zz")))
    boxes = c.select(F.concat(F.lit("box"), k.cast("string")).alias("container"), keys.alias("keys"), F.when(k % 3 == 1, F.concat(F.lit("/srv/"), _text("c_nationkey"), F.lit("/app"))).alias("context"))
    return services.match_docker(own, boxes).select("container", "service")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_nationkey || '.test' ELSE '(relative)' END AS host, 'p' || c_custkey % 30 AS p FROM customer WHERE c_custkey % 5 <> 0)
SELECT host, count(*)::BIGINT AS calls, count(DISTINCT k)::BIGINT AS callers, count(DISTINCT p)::BIGINT AS targets FROM c GROUP BY host""")
def external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth call meets a node of the graph."""
    k, g = F.col("c_custkey"), P.dense(spark, sf_dir)
    c = P.table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/p"), (k % 30).cast("string"))
    dst = F.when(k % 2 == 0, F.concat(F.lit("http:GET:https://h"), _text("c_nationkey"), F.lit(".test"), path)).otherwise(F.concat(F.lit("http:GET:"), path))
    edges = c.select(k.alias("edge_seq"), F.concat(F.lit("s"), k.cast("string")).alias("src"), F.when(k % 5 == 0, F.lit("known")).otherwise(dst).alias("dst"), F.lit("m").alias("method"), F.lit("http_call").alias("type"))
    return maps.http_boundaries(DependencyGraph(g.nodes.limit(1).withColumn("id", F.lit("known")), edges))


@query(f"""WITH {P.NODES_SQL}, own AS (SELECT *, CASE WHEN layer = 'Domain' AND split_part(file, '/', 3) = 'BUILDING.php' THEN 'deep' ELSE layer END AS s FROM nodes WHERE layer IN ('Domain', 'Application')), c AS (SELECT s, count(*) AS n, count(DISTINCT file) AS f, count(DISTINCT class) AS k FROM own GROUP BY s)
SELECT v.s AS service, coalesce(n, 0)::BIGINT AS nodes, coalesce(f, 0)::BIGINT AS files, coalesce(k, 0)::BIGINT AS classes, CASE WHEN n IS NULL THEN '' ELSE 'php' END AS languages FROM (VALUES ('Domain'), ('Application'), ('deep'), ('empty')) v(s) LEFT JOIN c ON c.s = v.s""")
def catalogue_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Domain", "src/Domain/"), ("Application", "src/Application"), ("deep", "src/Domain/BUILDING.php"), ("empty", "lib")], "name string, root string")
    return maps.catalogue_services(P.customer_nodes(spark, sf_dir), known)


@query("""WITH e AS (SELECT DISTINCT 'n' || c_nationkey AS service, CASE WHEN c_custkey % 3 = 0 THEN 'http' ELSE 'cli' END AS entry_type, 'e' || c_custkey AS id FROM customer)
SELECT service, entry_type, count(*)::BIGINT AS n, array_to_string(list_sort(list(id))[1:5], ',') AS samples FROM e GROUP BY ALL""")
def catalogue_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer")
    return maps.catalogue_entrypoints(c.select(F.concat(F.lit("n"), _text("c_nationkey")).alias("service"), F.when(F.col("c_custkey") % 3 == 0, "http").otherwise("cli").alias("entry_type"), F.concat(F.lit("e"), _text("c_custkey")).alias("id")))


_MAP_SQL = """map AS (SELECT 'n' || c_nationkey AS a, 'n' || (o_orderkey % 25) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'http' ELSE 'script' END AS type, count(*)::BIGINT AS count FROM orders JOIN customer ON c_custkey = o_custkey WHERE {where} GROUP BY ALL)"""


def _service_map(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    o = P.table(spark, sf_dir, "orders").where(where).join(P.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return o.groupBy(F.concat(F.lit("n"), _text("c_nationkey")).alias("from"), F.concat(F.lit("n"), (k % 25).cast("string")).alias("to"), F.when(k % 2 == 0, "http").otherwise("script").alias("type")).agg(F.count("*").alias("count"))


@query(f"""WITH {_MAP_SQL.format(where="TRUE")} SELECT a AS "from", b AS "to", sum(count)::BIGINT AS calls, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM map WHERE a <> b GROUP BY ALL""")
def service_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.catalogue_boundaries(_service_map(spark, sf_dir))


@query(f"""WITH {_MAP_SQL.format(where="o_orderkey % 11 = 0")}, x AS (SELECT DISTINCT a, b FROM map WHERE a <> b), o AS (SELECT a AS s, count(*) AS n FROM x GROUP BY 1), i AS (SELECT b AS s, count(*) AS n FROM x GROUP BY 1)
SELECT coalesce(o.s, i.s) AS service, coalesce(o.n, 0)::BIGINT AS calls, coalesce(i.n, 0)::BIGINT AS called_by FROM o FULL JOIN i ON o.s = i.s""")
def integration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.integration_points(_service_map(spark, sf_dir, "o_orderkey % 11 = 0")).select("service", "calls", "called_by")


@query(f"""WITH {_MAP_SQL.format(where="TRUE")}, x AS (SELECT a, b, sum(count)::BIGINT AS calls FROM map WHERE a <> b GROUP BY ALL) SELECT 'n3' AS service, 'out' AS direction, b AS other, calls FROM x WHERE a = 'n3' UNION ALL SELECT 'n3', 'in', a, calls FROM x WHERE b = 'n3'""")
def service_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("service"))
    return maps.lookup_service(n, maps.catalogue_boundaries(_service_map(spark, sf_dir)), "N3")


@query(f"""WITH {_MAP_SQL.format(where="o_orderkey % 10 <> 0").replace("map AS", "o AS")}, {_MAP_SQL.format(where="TRUE").replace("map AS", "n AS")} SELECT a AS "from", b AS "to", type, count, 'added' AS status, FALSE AS breaking FROM (FROM n EXCEPT FROM o)
  UNION ALL SELECT a, b, type, count, 'removed', TRUE FROM (FROM o EXCEPT FROM n)""")
def service_map_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.map_diff(_service_map(spark, sf_dir, "o_orderkey % 10 <> 0"), _service_map(spark, sf_dir))


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'test' ELSE 'deploy' END AS stage, (count(*) FILTER (c_custkey % 2 = 0))::BIGINT AS blockers, (count(*) FILTER (c_custkey % 2 = 1))::BIGINT AS risks FROM customer GROUP BY 1""")
def devops_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer")
    return maps.devops(c.select(_pick("SCHEMA_DRIFT", "CONTRACT_x", "BREAKING_change", by=F.col("c_custkey")).alias("type"), F.when(F.col("c_custkey") % 2 == 0, "high").otherwise("medium").alias("severity")))


# ---- comparison and plans


@query("""SELECT 'a' || c_custkey || ',b' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'resolved' END AS status FROM customer WHERE c_custkey % 3 <> 0""")
def cycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third cycle is on both sides, its members in another order."""
    k = F.col("c_custkey")
    c = P.table(spark, sf_dir, "customer")
    a, b = F.concat(F.lit("a"), k.cast("string")), F.concat(F.lit("b"), k.cast("string"))
    old = c.where((k % 3 == 0) | (k % 2 == 1)).select(diff.cycle_key(F.array(a, b)).alias("key"))
    new = c.where((k % 3 == 0) | (k % 2 == 0)).select(diff.cycle_key(F.array(b, a)).alias("key"))
    return diff.new_and_resolved(old, new, ["key"])


_LIMITS = "values_ AS (SELECT 'v' || c_nationkey AS name, count(*)::BIGINT AS value FROM customer GROUP BY 1), limits AS (SELECT 'v' || n_nationkey AS name, n_nationkey * 2 AS most FROM nation)"


def _limits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    values = P.table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("v"), _text("c_nationkey")).alias("name")).agg(F.count("*").alias("value"))
    return values, P.table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), _text("n_nationkey")).alias("name"), (F.col("n_nationkey") * 2).alias("most"))


@query(f"""WITH {_LIMITS}, b AS (SELECT *, value / greatest(most, 1)::DOUBLE AS r FROM values_ JOIN limits USING (name) WHERE value > most) SELECT name, value, most, CASE WHEN r >= 3 THEN 'critical' WHEN r >= 2 THEN 'high' WHEN r >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM b""")
def drift_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.drift_policy(*_limits(spark, sf_dir))


@query(f"WITH {_LIMITS} SELECT (SELECT count(*) FROM values_ JOIN limits USING (name) WHERE value > most)::BIGINT AS breaches, 0::BIGINT AS blockers, (SELECT count(*) FROM values_ JOIN limits USING (name) WHERE value > most) = 0 AS passed")
def drift_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaches = diff.drift_policy(*_limits(spark, sf_dir))
    return diff.passed(breaches, breaches.limit(0))


@query("SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'fail' ELSE 'warn' END AS status, 'c' || c_nationkey AS code FROM customer GROUP BY ALL ORDER BY status, code LIMIT 5")
def compliance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer")
    return diff.compliance(c.select(F.when(F.col("c_nationkey") % 2 == 0, "blocker").otherwise("threshold").alias("kind"), F.concat(F.lit("c"), _text("c_nationkey")).alias("code")))


@query("SELECT c_nationkey AS plan_id, count(*)::BIGINT AS steps, (count(*) FILTER (c_custkey % 3 = 0))::BIGINT AS completed, round((count(*) FILTER (c_custkey % 3 = 0)) * 100.0 / count(*), 1)::DOUBLE AS percent FROM customer GROUP BY 1")
def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = P.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plan_id"), F.col("c_custkey").alias("step"))
    done = plan.where("step % 3 = 0")
    return risk.step_progress(done.union(done), plan).withColumn("percent", F.col("percent").cast("double"))


@query("""SELECT c_custkey AS k, c_custkey % 4 = 0 AND c_custkey % 6 < 3 AND c_custkey % 5 = 0 AS trivial, least(10, greatest(1, 1 + floor((c_custkey % 6) / 2)))::BIGINT AS plan_complexity FROM customer""")
def plan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = P.table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 4 == 0, "LOW").otherwise("HIGH").alias("level"), (k % 6).alias("affected"), (k % 5).alias("cycle_count"), F.lit(0).alias("violation_count"))
    return risk.refactor_plan(rows).select("k", "trivial", "plan_complexity")


# ---- search


@query(f"""{D} SELECT q AS query, class AS name, count(*)::BIGINT AS methods FROM nodes, (VALUES ('n12'), ('domain'), ('nothing')) v(q) WHERE contains(lower(class), q) GROUP BY ALL""")
def find_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_many(metrics.fans(P.dense(spark, sf_dir)), ["N12", "domain ", "n12", "nothing"])


@query(f"""{D}, own AS (SELECT id FROM nodes WHERE starts_with(class, 'Shop\\Domain\\N0')) SELECT 'out' AS direction, dst AS id, arg_max(type, edge_seq) AS type FROM edges WHERE src IN (FROM own) AND dst NOT IN (FROM own) GROUP BY dst
  UNION ALL SELECT 'in', src, arg_max(type, edge_seq) FROM edges WHERE dst IN (FROM own) AND src NOT IN (FROM own) GROUP BY src""")
def area_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.dense(spark, sf_dir)
    return search.area_dependencies(g.edges, g.nodes.where(F.col("class").startswith("Shop\\Domain\\N0")).select("id"))


@query("SELECT c_custkey AS k, 'f' || c_custkey || '(int $a, $b)' || CASE WHEN c_custkey % 2 = 0 THEN ': string' ELSE '' END AS signature FROM customer")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    params = F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("type")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type")))
    return P.table(spark, sf_dir, "customer").select(k.alias("k"), search.signature(F.concat(F.lit("f"), k.cast("string")), params, F.when(k % 2 == 0, "string")).alias("signature"))


@query("SELECT c_custkey AS k, 'b' || c_custkey || chr(10) || '  c' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'd' ELSE '' END AS code FROM customer")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    content = F.concat(F.lit("a\n  b"), k.cast("string"), F.lit("\n    c\n  d\n"))
    return P.table(spark, sf_dir, "customer").select(k.alias("k"), search.snippet(content, F.lit(2), F.when(k % 2 == 0, 4).otherwise(3)).alias("code"))


# ---- sessions


@query("""SELECT user_id AS session, min(ts) AS started, max(CASE WHEN event_type = 'error' THEN ts END) AS ended, (count(*) FILTER (event_type NOT IN ('error', 'view')))::BIGINT AS operations FROM events GROUP BY user_id""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for starts, errors for ends."""
    e = P.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "end").when(F.col("event_type") == "view", "start").otherwise(F.col("event_type"))
    return E.sessions(e.select(F.col("user_id").alias("session"), F.lit("m").alias("mode"), F.lit("g").alias("goal"), F.col("ts").alias("at"), kind.alias("operation"))).select("session", "started", "ended", "operations")
