"""Maps of a project: areas, entry points, boundaries, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph
from graphloom.operators.query import FlowQuery


def area_of(class_: Column, file: Column, type_: Column) -> Column:
    """The first two segments of a class name, or a file's folder."""
    by = lambda sep: F.array_join(F.slice(F.split(class_, sep), 1, 2), "\\" if sep == r"\\" else ".")
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    folder = F.when(folder == "", "(root)").otherwise(folder)
    return F.when(type_ == "file", folder).when(class_.contains("\\"), by(r"\\")).when(class_.contains("."), by(r"\.")).when(F.coalesce(class_, F.lit("")) != "", class_).otherwise("(root)")


def with_area(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("area", area_of(F.col("class"), F.col("file"), F.col("type")))


def area_rollup(graph: DependencyGraph, samples: int = 5) -> DataFrame:
    """Per area its nodes, entry points, languages and first ids."""
    called = graph.edges.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    rows = with_area(graph.nodes).join(called, "id", "left")
    counts = rows.groupBy("area").agg(F.count("*").alias("nodes"), F.count(F.when(F.col("called").isNull(), 1)).alias("entrypoints"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    nth = F.row_number().over(Window.partitionBy("area").orderBy("node_seq"))
    first = rows.withColumn("k", nth).where(F.col("k") <= samples).groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("samples"))
    return counts.join(first, "area").orderBy(F.col("nodes").desc(), F.col("entrypoints").desc(), "area")


def namespaces(graph: DependencyGraph, n: int = 5) -> DataFrame:
    """The namespaces (first two segments) with most classes."""
    ns = F.array_join(F.slice(F.split("class", r"\\"), 1, 2), "\\")
    return graph.nodes.groupBy(ns.alias("namespace")).agg(F.count_distinct("class").alias("classes")).orderBy(F.col("classes").desc(), "namespace").limit(n)


def dominant_language(graph: DependencyGraph) -> DataFrame:
    """The most frequent language."""
    return graph.nodes.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "language").limit(1)


def script_type(path: Column) -> Column:
    """Scripts in these folders are run by hand."""
    return F.when(path.rlike(r"(^|/)(bin|scripts|cli|console|cron|tools)/"), "cli").otherwise("http")


def entry_type(cli: bool = False) -> Column:
    """L14 (map) or L15 (command line): the kind of an entry point over node columns."""
    meta, c, m, lang = F.col("metadata"), F.col("class"), F.col("method"), F.col("language")
    kind = meta["entrypoint_type"]
    has = lambda p: F.coalesce(F.exists(meta["attributes"], lambda a: a.rlike(p)), F.lit(False))
    file, lm, lc = F.lower(F.col("file")), F.lower(m), F.lower(c)
    ts = lang.isin("typescript", "javascript")
    web = (file.contains("/api/") | file.contains("/routes/") | file.rlike(r"/route\.tsx?$")) & lm.isin("handler", "loader", "action", "middleware")
    out = F.when(F.col("type") == "file", script_type(F.col("file")))
    out = out.when(kind == "http", "http").when(kind.isin("cli", "script"), "cli").when(kind == "async", "event").when(kind == "ui", "custom" if cli else "ui").when(kind.isNotNull(), "custom")
    if not cli:
        out = out.when(meta["http_path"].isNotNull() | meta["http_method"].isNotNull(), "http")
    out = out.when(has("Route|Get|Post|Put|Patch|Delete|ApiResource"), "http").when(has("AsCommand"), "cli").when(has("WpHook|WpAction|WpFilter"), "wp_hook" if cli else "event")
    out = out.when(c.endswith("Controller") | c.endswith("Action"), "http")
    out = out.when(ts & (m.isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS") | web | lc.endswith("controller") | lc.contains(".routes.")), "http")
    out = out.when(ts & lm.isin("main", "start", "bootstrap", "serve", "run", "runserver", "listen"), "cli")
    out = out.when(ts & (file.endswith(".tsx") | file.contains("/components/") | file.contains("/routes/")) & m.rlike("^[A-Z]"), "ui")
    out = out.when((m == "handle") & (c.endswith("Command") | c.contains("\\Command\\")), "cli").when(c.endswith("Listener") | c.endswith("Subscriber") | c.endswith("Handler"), "event")
    return out.when(c.contains("Livewire") | c.endswith("Component"), "livewire" if cli else "ui").otherwise("custom")


def actionable_entrypoints(graph: DependencyGraph) -> DataFrame:
    """Entry points that are no magic methods and have a known kind, by id."""
    rows = FlowQuery(graph).entrypoints().to_df().where(~((F.col("type") == "method") & F.col("method").startswith("__"))).withColumn("entry_type", entry_type())
    return rows.where("entry_type <> 'custom'").orderBy("id")


def http_boundaries(graph: DependencyGraph) -> DataFrame:
    """Calls to targets outside the graph, by host."""
    out = graph.edges.where("type = 'http_call'").join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
    host = F.coalesce(F.try_parse_url(F.regexp_replace("dst", "^http:[A-Z]*:", ""), F.lit("HOST")), F.lit("(relative)"))
    return out.groupBy(host.alias("host")).agg(F.count("*").alias("calls"), F.count_distinct("src").alias("callers"), F.count_distinct("dst").alias("targets"))


def related_areas(graph: DependencyGraph, area: str) -> DataFrame:
    """Other areas by the edges that connect them with this one; both ends must be nodes."""
    a = with_area(graph.nodes).select(F.col("id").alias("src"), F.col("area").alias("sa"))
    b = with_area(graph.nodes).select(F.col("id").alias("dst"), F.col("area").alias("sb"))
    x = graph.edges.join(a, "src").join(b, "dst")
    other = x.where((F.col("sa") == area) & (F.col("sb") != area)).select(F.col("sb").alias("area")).union(x.where((F.col("sb") == area) & (F.col("sa") != area)).select("sa"))
    return other.groupBy("area").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "area")


def deployment(edges: DataFrame, compose: DataFrame) -> DataFrame:
    """Per service its distinct targets (edges: from, to, type) and composed parts (service, part), with coverage."""
    targets = edges.where("to is not null").groupBy(F.col("from").alias("service")).agg(F.count_distinct("to").alias("targets"))
    parts = compose.groupBy("service").agg(F.count_distinct("part").alias("parts"))
    rows = targets.join(parts, "service", "full_outer").select("service", F.coalesce("targets", F.lit(0).cast("long")).alias("targets"), F.coalesce("parts", F.lit(0).cast("long")).alias("parts"))
    return rows.withColumn("coverage", F.when(F.col("parts") == 0, "missing").when(F.col("targets") == 0, "partial").otherwise("complete"))


def website(pages: DataFrame) -> DataFrame:
    """Per host of (host, path) its distinct pages and all of its addresses."""
    return pages.groupBy(F.col("host").alias("service")).agg(F.count_distinct("path").alias("pages"), F.count("*").alias("urls"))


def devops(inconsistencies: DataFrame) -> DataFrame:
    """Findings by stage; high severity blocks, medium is a risk."""
    t = F.lower("type")
    stage = F.when(t.contains("schema"), "build").when(t.contains("contract"), "test").when(t.contains("breaking"), "deploy").otherwise("test")
    return inconsistencies.groupBy(stage.alias("stage")).agg(F.count(F.when(F.col("severity") == "high", 1)).alias("blockers"), F.count(F.when(F.col("severity") == "medium", 1)).alias("risks"))


# ---- catalogue rollups (L28) and what is looked up in them


def catalogue_services(nodes: DataFrame, services: DataFrame) -> DataFrame:
    """Per service (name, root) its nodes, files, classes and languages; a node belongs to the deepest root above its file."""
    parts = F.split(F.regexp_replace("file", "^/+", ""), "/")
    above = nodes.select("id", "class", "file", "language", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "root"))
    roots = services.select(F.col("name").alias("service"), F.regexp_replace(F.rtrim("root", F.lit("/")), "^/+", "").alias("root"))
    owned = above.join(roots, "root").groupBy("id", "class", "file", "language").agg(F.max_by("service", F.struct("depth", "service")).alias("service"))
    counts = owned.groupBy("service").agg(F.count("*").alias("nodes"), F.count_distinct("file").alias("files"), F.count_distinct("class").alias("classes"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    names = services.select(F.col("name").alias("service")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return names.join(counts, "service", "left").select("service", zero("nodes"), zero("files"), zero("classes"), F.coalesce("languages", F.lit("")).alias("languages"))


def catalogue_entrypoints(entries: DataFrame, samples: int = 5) -> DataFrame:
    """Entry points (service, entry_type, id) by service and type, with the first ids by name."""
    nth = F.row_number().over(Window.partitionBy("service", "entry_type").orderBy("id"))
    rows = entries.withColumn("k", nth)
    first = rows.where(F.col("k") <= samples).groupBy("service", "entry_type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return entries.groupBy("service", "entry_type").agg(F.count("*").alias("n")).join(first, ["service", "entry_type"])


def catalogue_boundaries(edges: DataFrame) -> DataFrame:
    """Per pair of services (from, to, type, count) the kinds of calls that cross, and how many."""
    crossing = edges.where("`from` <> `to`")
    return crossing.groupBy("from", "to").agg(F.sum("count").alias("calls"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def integration_points(edges: DataFrame) -> DataFrame:
    """Services by how many others they call and are called by; the node that calls is not kept."""
    crossing = edges.where("`from` <> `to`").select("from", "to").distinct()
    out = crossing.groupBy(F.col("from").alias("service")).agg(F.count("*").alias("calls"))
    into = crossing.groupBy(F.col("to").alias("service")).agg(F.count("*").alias("called_by"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.join(into, "service", "full_outer").select("service", zero("calls"), zero("called_by"), F.lit(None).cast("string").alias("from_node"))


def lookup_service(services: DataFrame, boundaries: DataFrame, name: str) -> DataFrame:
    """A service's row beside what it calls and what calls it: (service, direction, other, calls)."""
    known = services.where(F.lower("service") == name.lower()).select("service")
    out = boundaries.join(known, boundaries["from"] == known["service"]).select("service", F.lit("out").alias("direction"), F.col("to").alias("other"), "calls")
    into = boundaries.join(known, boundaries["to"] == known["service"]).select("service", F.lit("in"), F.col("from"), "calls")
    return out.union(into)


def lookup_boundary(boundaries: DataFrame, a: str, b: str) -> DataFrame:
    """The calls between two services, in either direction."""
    ends = [a.lower(), b.lower()]
    return boundaries.where(F.lower("from").isin(*ends) & F.lower("to").isin(*ends))


def lookup_path(paths: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Critical paths (root, depth, path) that a name takes part in, longest first (a top-k report)."""
    return paths.where(F.lower("path").contains(needle.lower())).orderBy(F.col("depth").desc(), "root").limit(limit)
