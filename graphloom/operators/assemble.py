"""From raw parser rows to a graph: dedupe, edge resolution, id collisions, routes, staleness (ETL1-ETL12, POL1-POL2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import node_id
from graphloom.operators import iterate


def visibility(nodes: DataFrame, decide: Column) -> DataFrame:
    """ETL1: applies a policy column (public or hidden; null: public) and marks the rows as evaluated."""
    return nodes.withColumn("visibility", F.coalesce(decide, F.lit("public"))).withColumn("visibility_evaluated", F.lit(True))


def dedupe(nodes: DataFrame) -> DataFrame:
    """ETL2: one row per id: the place of the first, the content of the last; repeated tells ids that were there twice."""
    content = [c for c in nodes.columns if c not in ("id", "node_seq")]
    last = F.max_by(F.struct(*content), "node_seq").alias("c")
    return nodes.groupBy("id").agg(F.min("node_seq").alias("node_seq"), last, (F.count("*") > 1).alias("repeated")).select("id", "node_seq", "c.*", "repeated")


def resolve_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """ETL3: includes stay if their target is known; function calls also if the global function of that name is, re-pointed; other edges always stay."""
    ids = known.select(F.col("id").alias("dst")).distinct().withColumn("there", F.lit(True))
    globals_ = known.where(F.col("id").startswith("func:")).select(F.col("id").alias("again")).distinct().withColumn("elsewhere", F.lit(True))
    name = F.substring_index(F.regexp_replace("dst", "^func:", ""), "\\", -1)
    rows = edges.withColumn("again", F.concat(F.lit("func:"), name)).join(ids, "dst", "left").join(globals_, "again", "left")
    keep = F.when(F.col("type") == "include", F.col("there")).when(F.col("type") == "function_call", F.coalesce("there", "elsewhere")).otherwise(F.lit(True))
    target = F.when((F.col("type") == "function_call") & F.col("there").isNull(), F.col("again")).otherwise(F.col("dst"))
    return rows.where(keep).withColumn("dst", target).select(*edges.columns)


def qualify(nodes: DataFrame) -> DataFrame:
    """ETL4: ids declared in more than one file get the file's relative path as qualifier."""
    many = nodes.where("type <> 'file'").groupBy("id").agg(F.count_distinct("file").alias("files")).where("files > 1").select("id", F.lit(True).alias("many"))
    rows = nodes.join(many, "id", "left").withColumn("qualifier", F.when(F.col("many") & (F.col("type") != "file"), F.coalesce(F.col("metadata.relPath"), F.col("file"))).otherwise(F.col("qualifier")))
    made = node_id(F.col("class"), F.col("method"), F.col("language"), F.col("type"), F.col("qualifier"))
    return rows.withColumn("id", F.when(F.col("many"), made).otherwise(F.col("id"))).select(*nodes.columns)


def resolve_ambiguous(references: DataFrame, candidates: DataFrame, includes: DataFrame) -> DataFrame:
    """ETL5, ETL6: (src_file, name) to candidate ids (name, id, file).

    A candidate in the same file wins; else the only one reachable over includes; else all, marked ambiguous.
    """
    closure = iterate.reach(includes).select(F.col("a").alias("src_file"), F.col("b").alias("file"), F.lit(True).alias("reachable"))
    rows = references.join(candidates, "name").join(closure, ["src_file", "file"], "left")
    per = Window.partitionBy("src_file", "name")
    own = F.max((F.col("file") == F.col("src_file")).cast("int")).over(per) == 1
    reach = F.count("reachable").over(per)
    rows = rows.withColumn("own", own).withColumn("n", reach)
    keep = F.when(F.col("own"), F.col("file") == F.col("src_file")).when(F.col("n") == 1, F.col("reachable")).otherwise(F.lit(True))
    return rows.where(keep).select("src_file", "name", "id", (~F.col("own") & (F.col("n") != 1)).alias("ambiguous"))


def included_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """ETL7: files that are included and scanned but no node yet."""
    wanted = edges.where("type = 'include'").select(F.col("dst").alias("id")).distinct()
    return wanted.join(nodes.select("id"), "id", "left_anti").join(files.select(F.concat(F.lit("file:"), "path").alias("id"), "path"), "id")


def resolve_routes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ETL8: edges to http:METHOD:path get a further edge to the node that serves the route.

    Equal keys are joined; the rest are compared with the route patterns ({p} is one segment) of
    the same method and number of segments, so no call meets every route.  The first pattern wins;
    a later node takes over an equal key; edges to oneself are left out.
    """
    served = nodes.where("metadata.http_path is not null").select("id", "node_seq", F.upper(F.coalesce("metadata.http_method", F.lit("GET"))).alias("verb"), F.col("metadata.http_path").alias("route"))
    served = served.groupBy("verb", "route").agg(F.max_by("id", "node_seq").alias("target"), F.min("node_seq").alias("seq"))
    calls = edges.where(F.col("dst").startswith("http:")).select("edge_seq", "src", "dst", "method", F.upper(F.split_part("dst", F.lit(":"), F.lit(2))).alias("verb"), F.regexp_replace("dst", "^http:[^:]*:", "").alias("path"))
    exact = calls.join(served.withColumnRenamed("route", "path"), ["verb", "path"])
    left = calls.join(served.withColumnRenamed("route", "path"), ["verb", "path"], "left_anti").withColumn("parts", F.size(F.split("path", "/")))
    shapes = served.where(F.col("route").contains("{")).withColumn("parts", F.size(F.split("route", "/"))).withColumn("pattern", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("route", r"([.+*?^$()\[\]|\\])", r"\\$1"), r"\{[^}]+\}", "[^/]+"), F.lit("$")))
    by_shape = left.join(shapes, ["verb", "parts"]).where(F.expr("path rlike pattern")).groupBy("edge_seq", "src", "dst", "method").agg(F.min_by("target", "seq").alias("target"))
    new = exact.select("edge_seq", "src", "method", "target").union(by_shape.select("edge_seq", "src", "method", "target")).where("src <> target")
    return edges.union(new.select("edge_seq", "src", F.col("target").alias("dst"), "method", F.lit("http_call").alias("type")).select(*edges.columns))


def resolve_imports(edges: DataFrame, exports: DataFrame) -> DataFrame:
    """ETL9: edges to import keys point at the exporting node: (key, id, kind, seq); of classes the first, of functions the last."""
    classes = exports.where("kind = 'class'").groupBy("key").agg(F.min_by("id", "seq").alias("target"))
    functions = exports.where("kind <> 'class'").groupBy("key").agg(F.max_by("id", "seq").alias("other"))
    rows = edges.join(classes, edges["dst"] == classes["key"], "left").drop("key").join(functions, edges["dst"] == functions["key"], "left").drop("key")
    return rows.withColumn("dst", F.coalesce("target", "other", "dst")).select(*edges.columns)


def to_parse(files: DataFrame, cached: DataFrame) -> DataFrame:
    """ETL10: files whose (path, fingerprint) is not cached."""
    return files.join(cached.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti")


def fingerprint(path: Column, content: Column, parser: str) -> Column:
    """ETL10, ETL11: a file's identity for reuse."""
    return F.sha1(F.concat_ws("|", path, F.sha2(content, 256), F.lit(parser)))


def staleness(old: DataFrame, new: DataFrame, in_scope: Column | None = None) -> DataFrame:
    """ETL12: (path, status): changed, new or deleted; a file out of scope is not deleted."""
    rows = old.select("path", F.col("fingerprint").alias("o")).join(new.select("path", F.col("fingerprint").alias("n")), "path", "full_outer")
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed")
    rows = rows.withColumn("status", status).where("status is not null")
    return (rows if in_scope is None else rows.where((F.col("status") != "deleted") | in_scope)).select("path", "status")


def compose_policies(nodes: DataFrame, policies: Sequence[tuple[str, Column]], strict: bool = True) -> DataFrame:
    """POL1, POL2: every policy's decision (allow, deny or null), as a list of (policy, decision), and what follows.

    Allow against deny is an error if strict, else hidden.
    """
    decisions = F.array(*(F.struct(F.lit(name).alias("policy"), d.alias("decision")) for name, d in policies))
    allowed, denied = F.exists(decisions, lambda x: F.coalesce(x["decision"] == "allow", F.lit(False))), F.exists(decisions, lambda x: F.coalesce(x["decision"] == "deny", F.lit(False)))
    clash = F.raise_error(F.concat(F.lit("policies disagree on "), F.col("id"))).cast("string") if strict else F.lit("hidden")
    return nodes.withColumn("decisions", decisions).withColumn("visibility", F.when(allowed & denied, clash).when(denied, "hidden").otherwise("public"))
