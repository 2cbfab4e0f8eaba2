"""Service maps: who calls whom over HTTP and scripts, contracts, innermost nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import normal_path


def resolve_services(calls: DataFrame, services: DataFrame) -> DataFrame:
    """Calls (…, host, port) with the service they go to: by host:port, else by host, whatever the case."""
    names = services.select("name", F.explode("hostnames").alias("h")).groupBy(F.lower("h").alias("h")).agg(F.min("name").alias("name"))
    both = names.select(F.col("h").alias("hp"), F.col("name").alias("by_port"))
    host = names.select(F.col("h").alias("hh"), F.col("name").alias("by_host"))
    rows = calls.withColumn("hh", F.lower("host")).withColumn("hp", F.concat_ws(":", F.lower("host"), F.col("port").cast("string")))
    return rows.join(both, "hp", "left").join(host, "hh", "left").withColumn("target", F.coalesce("by_port", "by_host")).select(*calls.columns, "target")


def resolve_scripts(calls: DataFrame, files: DataFrame, services: DataFrame) -> DataFrame:
    """Script calls (…, path): the service that has the file, else the first whose root the path is below.

    finding is SCRIPT_NOT_FOUND without a service and SCRIPT_NOT_SCANNED without the file.  Roots are
    joined by equality with each folder above the path.
    """
    exact = files.groupBy("path").agg(F.min("service").alias("by_file"))
    roots = services.groupBy(F.rtrim("root", F.lit("/")).alias("folder")).agg(F.min(F.struct("seq", "name")).alias("s"))
    rows = calls.withColumn("k", F.monotonically_increasing_id())
    parts = F.split("path", "/")
    above = rows.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    below = above.join(roots, "folder").groupBy("k").agg(F.min("s").alias("s"))
    out = rows.join(exact, "path", "left").join(below, "k", "left").withColumn("target", F.coalesce("by_file", "s.name"))
    finding = F.when(F.col("target").isNull(), "SCRIPT_NOT_FOUND").when(F.col("by_file").isNull(), "SCRIPT_NOT_SCANNED")
    return out.select(*calls.columns, "target", finding.alias("finding"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


#: Stands for a parameter that a path ending in a slash is about to get; no path has this text.
TRAILING = "\u0000"


def path_score(call: Column, route: Column) -> Column:
    """How well a call's segments fit a route's; null: not at all.

    2 for an equal segment, 1 for a parameter that meets a value known only at run time, 0 for other
    parameters and for run-time values; an optional parameter may be missing at the end.
    """

    def one(seg: Column, got: Column) -> Column:
        param = seg.startswith("{") & seg.endswith("}")
        runtime = got.contains("{")
        return (
            F.when(got.isNull(), F.when(seg.endswith("?}"), 0).otherwise(-1000))
            .when((got == TRAILING) & ~param, -1000)
            .when(runtime, F.when(param, 1).otherwise(0))
            .when(param, 0)
            .when(F.lower(seg) == F.lower(got), 2)
            .otherwise(-1000)
        )

    scores = F.transform(route, lambda seg, i: one(seg, F.get(call, i)))
    total = F.aggregate(scores, F.lit(0), lambda a, x: a + x)
    return F.when((F.size(call) <= F.size(route)) & (total >= 0), total)


def match_endpoints(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls (call_id, service, method, path) with the handler of the best endpoint of their service.

    Endpoints (service, method, path, handler, ep_seq) must have the call's method or ANY; the
    highest score wins, then the first.  A path that ends in a slash first tries one parameter more.
    Candidates are joined on the service and on the first segment, or on routes that begin with a
    parameter, so calls don't meet every endpoint.
    """
    own = segments(F.col("path"))
    c = calls.select("call_id", "service", F.upper("method").alias("verb"), own.alias("segs"), F.col("path").endswith("/").alias("slash")).where(F.size("segs") > 0)
    tries = c.where("slash").withColumn("segs", F.concat("segs", F.array(F.lit(TRAILING)))).withColumn("turn", F.lit(0)).union(c.withColumn("turn", F.lit(1)))
    head = F.lower(F.get("segs", F.lit(0)))
    tries = tries.withColumn("head", F.explode(F.array_distinct(F.when(head.contains("{"), F.array(F.lit("*"))).otherwise(F.array(head, F.lit("{"))))))
    e = endpoints.select("service", F.upper("method").alias("ev"), segments(F.col("path")).alias("route"), "handler", "ep_seq")
    first = F.lower(F.get("route", F.lit(0)))
    e = e.withColumn("head", F.explode(F.array(F.when(first.startswith("{"), F.lit("{")).otherwise(first), F.lit("*"))))
    rows = tries.join(e, ["service", "head"]).where(F.col("verb").isNull() | (F.col("ev") == F.col("verb")) | (F.col("ev") == "ANY")).withColumn("score", path_score(F.col("segs"), F.col("route"))).where("score is not null")
    best = rows.groupBy("call_id").agg(F.min(F.struct("turn", (-F.col("score")).alias("s"), "ep_seq", "handler")).alias("b"))
    return calls.join(best, "call_id", "left").select(*calls.columns, F.col("b.handler").alias("handler"))


def match_files(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """.php paths (call_id, path) with the shortest node id whose file ends in them; joined on the file's name."""
    c = calls.where(F.col("path").endswith(".php")).withColumn("name", F.substring_index("path", "/", -1))
    n = nodes.select(F.col("id"), "file", F.substring_index("file", "/", -1).alias("name"))
    hit = c.join(n, "name").where(F.col("file").endswith(F.ltrim("path", F.lit("/")))).groupBy("call_id").agg(F.min(F.struct(F.length("id").alias("l"), "id")).alias("s"))
    return calls.join(hit, "call_id", "left").select(*calls.columns, F.col("s.id").alias("id"))


def service_edges(calls: DataFrame) -> DataFrame:
    """(from, to, type, count) of resolved calls; assets and commented calls don't count."""
    kept = calls.where("target is not null and coalesce(kind, '') <> 'asset' and not coalesce(commented, false)")
    return kept.groupBy(F.col("service").alias("from"), F.col("target").alias("to"), "type").agg(F.count("*").alias("count"))


def contract_check(code: DataFrame, contract: DataFrame) -> DataFrame:
    """(type, severity, service, method, path): duplicates on either side, endpoints on one side alone, other methods."""
    keyed = lambda df: df.select("service", F.upper("method").alias("method"), normal_path(F.col("path")).alias("path"))
    a, b = keyed(code), keyed(contract)
    key = ["service", "method", "path"]

    def finding(df: DataFrame, kind: str, severity: str) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), *key)

    twice = lambda df: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    ad, bd = a.distinct(), b.distinct()
    paths = ad.select("service", "path").distinct(), bd.select("service", "path").distinct()
    missing = bd.join(ad, key, "left_anti")
    extra = ad.join(bd, key, "left_anti")
    out = finding(twice(b), "CONTRACT_DUPLICATE_ENDPOINT", "medium").union(finding(twice(a), "CODE_DUPLICATE_ENDPOINT", "high"))
    out = out.union(finding(missing.join(paths[0], ["service", "path"], "left_anti"), "CONTRACT_ENDPOINT_MISSING_IN_CODE", "high"))
    out = out.union(finding(extra.join(paths[1], ["service", "path"], "left_anti"), "CODE_ENDPOINT_NOT_IN_CONTRACT", "medium"))
    return out.union(finding(missing.join(paths[0], ["service", "path"], "left_semi"), "HTTP_METHOD_MISMATCH", "high"))


def locate(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each (file, line) the node that starts last at or before the line and has not ended; else the file's node; else null."""
    n = nodes.where("type <> 'file' and line is not null").select(F.col("id"), "file", F.col("line").alias("start"), F.col("metadata.endLine").alias("end"), "node_seq")
    rows = points.select("file", "line").distinct()
    inside = rows.join(n, "file").where("start <= line and (end is null or end >= line)").groupBy("file", "line").agg(F.max_by("id", F.struct("start", (-F.col("node_seq")).alias("s"))).alias("inner"))
    whole = nodes.where("type = 'file'").groupBy("file").agg(F.min_by("id", "node_seq").alias("whole"))
    return points.join(inside, ["file", "line"], "left").join(whole, "file", "left").withColumn("id", F.coalesce("inner", "whole")).drop("inner", "whole")


def match_docker(services: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers (container, keys) to services (name, root, …) by an equal name among their keys, else by build context below the root."""
    by_key = containers.select("container", F.explode("keys").alias("k")).join(services.select(F.lower("name").alias("k"), "name"), "k").groupBy("container").agg(F.min("name").alias("a"))
    parts = F.split("context", "/")
    above = containers.where("context is not null").select("container", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    by_root = above.join(services.select("name", "root"), "root").groupBy("container").agg(F.min("name").alias("b"))
    return containers.join(by_key, "container", "left").join(by_root, "container", "left").withColumn("service", F.coalesce("a", "b")).drop("a", "b")


def _as_edge(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("to"))


def infra_edges(services: DataFrame) -> DataFrame:
    """Edges from the arrays of composed services: image, networks, volumes, env_files, env_keys, depends_on, hosts."""
    kinds = (("built_from", "image"), ("attached_to_network", "networks"), ("mounts_volume", "volumes"), ("uses_env_file", "env_files"), ("uses_env_key", "env_keys"), ("depends_on", "depends_on"), ("resolves_to", "hosts"))
    parts = F.flatten(F.array(*(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _as_edge(kind)) for kind, c in kinds)))
    return services.select(F.col("name").alias("from"), F.explode(parts).alias("e"), "source").select("from", "e.to", "e.type", "source")
