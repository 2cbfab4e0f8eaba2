"""Queries over service maps; pages, customers and orders stand in for calls, endpoints and services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import maps, services
from graphloom.plans import projections as P
from graphloom.plans.registry import query

# Calls: every order calls the service of its customer's nation; endpoints: one per nation and segment.
CALLS_SQL = r"""calls AS (SELECT o_orderkey AS call_id, 'n' || c_nationkey AS service, CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method,
  '/' || c_mktsegment || CASE o_orderkey % 4 WHEN 0 THEN '/items/{id}' WHEN 1 THEN '/items/' WHEN 2 THEN '/' || o_orderkey ELSE '' END AS path FROM orders JOIN customer ON c_custkey = o_custkey)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders").join(P.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    tail = F.when(k % 4 == 0, "/items/{id}").when(k % 4 == 1, "/items/").when(k % 4 == 2, F.concat(F.lit("/"), k.cast("string"))).otherwise("")
    return o.select(k.cast("long").alias("call_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("service"), F.when(k % 3 == 0, "GET").when(k % 3 == 1, "POST").alias("method"), F.concat(F.lit("/"), F.col("c_mktsegment"), tail).alias("path"))


_ROUTES = (("GET", "/{segment}/items/{id}", "items", 1), ("POST", "/MACHINERY/items/{id?}", "machine", 2), ("ANY", "/BUILDING", "building", 3), ("GET", "/{segment}/{key}", "any", 4), ("POST", "/FURNITURE/items/{id}", "furniture", 5))
_SEG = lambda p: f"list_filter(string_split({p}, '/'), lambda x: x <> '')"
_ROUTE_VALUES = ", ".join(f"('{m}', {_SEG(repr(p))}, '{h}', {k})" for m, p, h, k in _ROUTES)


@query(rf"""WITH {CALLS_SQL}, routes(ev, route, handler, seq) AS (VALUES {_ROUTE_VALUES}),
tries AS (SELECT call_id, method, {_SEG('path')} AS segs, 1 AS turn FROM calls UNION ALL SELECT call_id, method, list_append({_SEG('path')}, '#'), 0 FROM calls WHERE path LIKE '%/'),
steps AS (SELECT t.call_id, turn, seq, handler, i, len(segs) AS ls, len(route) AS lr, route[i] AS seg, segs[i] AS got FROM tries t JOIN routes ON method IS NULL OR ev = method OR ev = 'ANY', range(1, 4) r(i) WHERE i <= len(route) AND len(segs) <= len(route)),
scores AS (SELECT call_id, turn, seq, handler, sum(CASE WHEN got IS NULL THEN CASE WHEN seg LIKE '%?}}' THEN 0 ELSE -1000 END WHEN got = '#' AND seg NOT LIKE '{{%}}' THEN -1000 WHEN contains(got, '{{') THEN CASE WHEN seg LIKE '{{%}}' THEN 1 ELSE 0 END
  WHEN seg LIKE '{{%}}' THEN 0 WHEN lower(seg) = lower(got) THEN 2 ELSE -1000 END) AS score FROM steps GROUP BY ALL),
best AS (SELECT call_id, handler FROM scores WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY turn, score DESC, seq) = 1)
SELECT call_id, handler FROM calls LEFT JOIN best USING (call_id)""")
def endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    nations = P.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("service"))
    routes = spark.createDataFrame(list(_ROUTES), "method string, path string, handler string, ep_seq long")
    return services.match_endpoints(c, nations.crossJoin(routes)).select("call_id", "handler")  # five routes for each nation


@query("""SELECT 'n' || n_nationkey AS "from", r_name AS "to", 'http' AS type, count(*)::BIGINT AS count FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 GROUP BY ALL""")
def service_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders").join(P.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = P.table(spark, sf_dir, "nation")
    c = o.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("service"), F.concat(F.lit("Host"), F.col("c_nationkey").cast("string")).alias("host"), F.lit(80).alias("port"), F.lit("http").alias("type"), F.when(F.col("o_orderkey") % 5 == 0, "asset").otherwise("http").alias("kind"), (F.col("o_orderkey") % 7 == 0).alias("commented"))
    r = P.table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    s = r.groupBy(F.col("r_name").alias("name")).agg(F.collect_list(F.concat(F.lit("host"), F.col("n_nationkey").cast("string"))).alias("hostnames"))
    return services.service_edges(services.resolve_services(c, s))


@query(r"""WITH code AS (SELECT 's' || p_partkey % 5 AS service, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, '/part/{*}/' || p_partkey % 40 AS path FROM part),
doc AS (SELECT 's' || p_partkey % 5 AS service, CASE p_partkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/part/{*}/' || p_partkey % 50 AS path FROM part WHERE p_partkey % 7 <> 0),
f AS (SELECT 'CONTRACT_DUPLICATE_ENDPOINT' AS type, 'medium' AS severity, service, method, path FROM doc GROUP BY service, method, path HAVING count(*) > 1 UNION ALL SELECT 'CODE_DUPLICATE_ENDPOINT', 'high', service, method, path FROM code GROUP BY service, method, path HAVING count(*) > 1
  UNION ALL (SELECT DISTINCT 'CONTRACT_ENDPOINT_MISSING_IN_CODE', 'high', service, method, path FROM doc ANTI JOIN code USING (service, path)) UNION ALL (SELECT DISTINCT 'CODE_ENDPOINT_NOT_IN_CONTRACT', 'medium', service, method, path FROM code c WHERE (service, path) NOT IN (SELECT (service, path) FROM doc))
  UNION ALL (SELECT DISTINCT 'HTTP_METHOD_MISMATCH', 'high', service, method, path FROM doc d WHERE (service, path) IN (SELECT (service, path) FROM code) AND (service, method, path) NOT IN (SELECT (service, method, path) FROM code))) FROM f""")
def page_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    s = F.concat(F.lit("s"), (k % 5).cast("string")).alias("service")
    code = p.select(s, F.when(k % 3 == 0, "get").when(k % 3 == 1, "POST").otherwise("Put").alias("method"), F.concat(F.lit("/Part/{id}/"), (k % 40).cast("string"), F.lit("/")).alias("path"))
    doc = p.where(k % 7 != 0).select(s, F.when(k % 2 == 0, "GET").otherwise("post").alias("method"), F.concat(F.lit("/part/:id/"), (k % 50).cast("string")).alias("path"))
    return services.contract_check(code, doc)


@query(f"""WITH {P.NODES_SQL}, points AS (SELECT DISTINCT 'src/' || layer || '/' || seg || '.php' AS file, l AS line FROM (VALUES ('Domain'), ('Application'), ('Gone')) a(layer), (SELECT DISTINCT c_mktsegment AS seg FROM customer) b, range(1, 400, 7) r(l))
SELECT file, line, (SELECT n.id FROM nodes n WHERE n.file = points.file AND n.line <= points.line AND n.line + n.node_seq % 20 >= points.line ORDER BY n.line DESC, n.node_seq LIMIT 1) AS id FROM points""")
def locate_node_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir).withColumn("metadata", F.col("metadata"))
    end = (F.col("line") + F.col("node_seq") % 20).cast("int")
    meta = F.struct(*((end if f == "endLine" else F.col("metadata")[f]).alias(f) for f in nodes.schema["metadata"].dataType.names))
    segs = P.table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    points = segs.select(F.explode(F.array(F.lit("Domain"), F.lit("Application"), F.lit("Gone"))).alias("layer"), "c_mktsegment").select(F.concat(F.lit("src/"), "layer", F.lit("/"), "c_mktsegment", F.lit(".php")).alias("file"), F.explode(F.sequence(F.lit(1), F.lit(399), F.lit(7))).alias("line"))
    return services.locate(points.withColumn("line", F.col("line").cast("long")), nodes.withColumn("metadata", meta)).select("file", "line", "id")


_URLS = "urls AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


@query(f"WITH {_URLS} SELECT page_id, host, path, CASE WHEN page_id % 3 = 0 OR page_id % 3 = 1 AND regexp_extract(path, '\\.([^./]*)$', 1) IN ('png', 'js', 'pdf') THEN 'asset' ELSE 'http' END AS kind FROM urls")
def url_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page's host is taken as one that only serves static files."""
    p = P.table(spark, sf_dir, "pages").withColumn("u", scalar.url_parts(F.col("url")))
    host = F.when(F.col("page_id") % 3 == 0, F.lit("unpkg.com")).otherwise(F.col("u.host"))
    return p.select("page_id", F.col("u.host").alias("host"), F.col("u.path").alias("path"), scalar.url_kind(host, F.col("u.path")).alias("kind"))


@query(f"WITH {_URLS} SELECT host AS service, count(DISTINCT path)::BIGINT AS pages, count(*)::BIGINT AS urls FROM urls GROUP BY 1")
def website_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "pages").withColumn("u", scalar.url_parts(F.col("url")))
    return maps.website(p.select("u.host", "u.path"))


@query("""WITH t AS (SELECT 's' || c_nationkey AS service, count(DISTINCT o_orderpriority) AS targets FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 4 <> 0 GROUP BY 1), c AS (SELECT 's' || s_nationkey AS service, count(DISTINCT s_suppkey) AS parts FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1)
SELECT coalesce(t.service, c.service) AS service, coalesce(targets, 0)::BIGINT AS targets, coalesce(parts, 0)::BIGINT AS parts, CASE WHEN parts IS NULL THEN 'missing' WHEN targets IS NULL THEN 'partial' ELSE 'complete' END AS coverage FROM t FULL JOIN c ON t.service = c.service""")
def deployment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    o = P.table(spark, sf_dir, "orders").join(P.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 4 <> 0")
    e = o.select(name("c_nationkey").alias("from"), F.col("o_orderpriority").alias("to"), F.lit("http").alias("type"))
    c = P.table(spark, sf_dir, "supplier").where("s_nationkey % 3 <> 0").select(name("s_nationkey").alias("service"), F.col("s_suppkey").alias("part"))
    return maps.deployment(e, c)
