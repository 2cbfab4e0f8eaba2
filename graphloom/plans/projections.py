"""Graphs over the star-schema tables, in Spark and as DuckDB SQL with the same rows.

``dense``: a customer hands an order on to the customer of the next order.  ``sparse``: only each
customer's first order counts.  ``keys``: foreign keys between the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import METADATA, DependencyGraph

# Order priorities stand for edge types.
EDGE_TYPES = {
    "1-URGENT": "method_call",
    "2-HIGH": "static_call",
    "3-MEDIUM": "direct_instantiation",
    "4-NOT SPECIFIED": "interface_implementation",
    "5-LOW": "property_access",
}
LAYERS = ("Domain", "Application", "Infrastructure", "Other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    cls = F.concat(F.lit("Shop\\"), layer, F.lit("\\N"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"))
    method = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return c.select(
        F.col("c_custkey").cast("long").alias("node_seq"),
        F.concat(cls, F.lit("::"), method).alias("id"),
        cls.alias("class"),
        method.alias("method"),
        F.concat(F.lit("src/"), layer, F.lit("/"), F.col("c_mktsegment"), F.lit(".php")).alias("file"),
        (F.col("c_custkey") % 1000 + 1).cast("int").alias("line"),
        F.lit("php").alias("language"),
        F.lit("method").alias("type"),
        F.lit(None).cast("string").alias("qualifier"),
        F.when(F.col("c_custkey") % 7 == 0, "hidden").otherwise("public").alias("visibility"),
        F.lit(True).alias("visibility_evaluated"),
        F.lit(None).cast(METADATA).alias("metadata"),
    )


def _next_customer(orders: DataFrame) -> DataFrame:
    """Each order with the customer of the next one by (date, key).

    Orders are windowed within a day; the last of a day looks up the first of the next day, in a
    table with one row per day.  So no window holds all orders.
    """
    day = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    days = orders.groupBy("o_orderdate").agg(F.min_by("o_custkey", "o_orderkey").alias("opens"))
    follows = days.select("o_orderdate", F.lead("opens").over(Window.orderBy("o_orderdate")).alias("opens_next"))
    within = orders.withColumn("after", F.lead("o_custkey").over(day))
    return within.join(follows, "o_orderdate").withColumn("next_key", F.coalesce("after", "opens_next")).where("next_key is not null")


def _typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("node_seq").alias("ka"), F.col("id").alias("src")), nodes.select(F.col("node_seq").alias("kb"), F.col("id").alias("dst"), "method")
    kind = F.coalesce(*(F.when(F.col("prio") == k, F.lit(v)) for k, v in EDGE_TYPES.items()))
    return edges.join(a, "ka").join(b, "kb").select("edge_seq", "src", "dst", "method", kind.alias("type"))


def dense(spark: SparkSession, sf_dir: str, where: str = "true") -> DependencyGraph:
    nodes = customer_nodes(spark, sf_dir)
    hops = _next_customer(table(spark, sf_dir, "orders").where(where)).select(F.col("o_orderkey").cast("long").alias("edge_seq"), F.col("o_custkey").alias("ka"), F.col("next_key").alias("kb"), F.col("o_orderpriority").alias("prio"))
    return DependencyGraph(nodes, _typed(hops, nodes))


def sparse(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    nodes = customer_nodes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select(F.col("f.o_orderkey").alias("o_orderkey"))
    hops = _next_customer(orders).join(first, "o_orderkey").select(F.col("o_orderkey").cast("long").alias("edge_seq"), F.col("o_custkey").alias("ka"), F.col("next_key").alias("kb"), F.col("o_orderpriority").alias("prio"))
    return DependencyGraph(nodes, _typed(hops, nodes))


def keys(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    """Foreign keys: customer -> nation -> region, supplier -> nation, part -> supplier; acyclic."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "lineitem")}
    id_of = lambda kind, col: F.concat(F.lit(kind), F.lit("::k"), F.col(col).cast("string"))
    links = (
        t["nation"].select(id_of("nation", "n_nationkey").alias("src"), id_of("region", "n_regionkey").alias("dst"))
        .union(t["customer"].select(id_of("customer", "c_custkey"), id_of("nation", "c_nationkey")))
        .union(t["supplier"].select(id_of("supplier", "s_suppkey"), id_of("nation", "s_nationkey")))
        .union(t["lineitem"].select(id_of("part", "l_partkey"), id_of("supplier", "l_suppkey")))
        .distinct()
    )
    edges = links.select(F.xxhash64("src", "dst").alias("edge_seq"), "src", "dst", F.lit("k").alias("method"), F.lit("method_call").alias("type"))
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    null = lambda kind: F.lit(None).cast(kind)
    nodes = ids.select(
        F.xxhash64("id").alias("node_seq"), "id", F.substring_index("id", "::", 1).alias("class"), F.substring_index("id", "::", -1).alias("method"), F.lit("").alias("file"), null("int").alias("line"), F.lit("php").alias("language"),
        F.lit("method").alias("type"), null("string").alias("qualifier"), F.lit("public").alias("visibility"), F.lit(True).alias("visibility_evaluated"), F.lit(None).cast(METADATA).alias("metadata"),
    )
    return DependencyGraph(nodes, edges)


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EDGE_TYPES.items())
_LAYER = "CASE c_nationkey % 4 WHEN 0 THEN 'Domain' WHEN 1 THEN 'Application' WHEN 2 THEN 'Infrastructure' ELSE 'Other' END"

#: CTEs nodes and edges for DuckDB.  Backslashes in its strings are plain.
NODES_SQL = rf"""nodes AS (SELECT c_custkey AS node_seq, class || '::' || method AS id, class, method, 'src/' || layer || '/' || c_mktsegment || '.php' AS file,
  (c_custkey % 1000 + 1)::INTEGER AS line, 'php' AS language, 'method' AS type, CASE WHEN c_custkey % 7 = 0 THEN 'hidden' ELSE 'public' END AS visibility, layer
  FROM (SELECT *, 'Shop\' || layer || '\N' || c_nationkey || c_mktsegment AS class, 'c' || c_custkey AS method FROM (SELECT *, {_LAYER} AS layer FROM customer)))"""


def hops_sql(where: str = "TRUE", first: bool = False) -> str:
    only = " WHERE first = 1" if first else ""
    return f"""hop AS (SELECT * FROM (SELECT o_orderkey AS edge_seq, o_custkey AS ka, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS kb, o_orderpriority AS prio,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first FROM orders WHERE {where}){only}),
edges AS (SELECT edge_seq, a.id AS src, b.id AS dst, b.method AS method, CASE prio {_CASES} END AS type, a.class AS src_class, b.class AS dst_class FROM hop JOIN nodes a ON a.node_seq = ka JOIN nodes b ON b.node_seq = kb)"""


DENSE_SQL = f"WITH RECURSIVE {NODES_SQL}, {hops_sql()}"
SPARSE_SQL = f"WITH RECURSIVE {NODES_SQL}, {hops_sql(first=True)}"
