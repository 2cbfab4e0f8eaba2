"""Code that nothing calls: orphans, suspicious leaves, and how sure that is."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph, class_of, method_of
from graphloom.operators.metrics import fans

# Parts of class::method that mark an entry point.
ENTRY_PARTS = ("Controller", "Command", "DTO", "Handler", "Listener", "Job", "Migration", "Seeder", "Test", "__construct", "__invoke")
# Methods that frameworks call.
FRAMEWORK_METHODS = (
    "render", "mount", "hydrate", "dehydrate", "updating", "updated", "register", "boot", "schedule", "commands", "handle", "terminate", "authorize", "rules", "messages", "attributes",
    "prepareForValidation", "booted", "creating", "created", "deleting", "deleted", "casts", "redirectTo", "resolveRouteBinding", "resolveChildRouteBinding",
)
# Parts that mark helpers, parts that mark a public surface.
UTILITY_PARTS = ("Helper", "Util", "Support", "toArray", "toJson", "toString", "__toString", "jsonSerialize")
PUBLIC_PARTS = ("DTO::", "Query::", "Repository::")
# Attributes that mark an entry point.
ENTRY_ATTRIBUTES = (
    "Route", "Get", "Post", "Put", "Delete", "Patch", "Head", "Options", "Any", "Controller", "AsCommand", "AsController", "EventListener", "AsEventListener", "Scheduled", "Schedule",
    "Component", "IsPage", "ApiResource", "On", "Computed", "Locked", "Url",
)
# Return types of relations that are called by reflection.
RELATION_TYPES = ("HasMany", "HasOne", "BelongsTo", "BelongsToMany", "HasOneThrough", "HasManyThrough", "MorphTo", "MorphMany", "MorphOne", "MorphToMany", "MorphedByMany")
# Method names that are called by reflection, as patterns.
REFLECTED = ("^get[A-Z][a-zA-Z0-9]*Property$", "^(updated|updating)[A-Z][a-zA-Z0-9]*$", "^(get|set)[A-Z][a-zA-Z0-9]*Attribute$")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def _target() -> Column:
    """class::method without the qualifier."""
    return F.concat("class", F.lit("::"), "method")


def is_entry(patterns: Sequence[str] = ()) -> Column:
    """A20, over nodes with the columns interface_class and satisfies of with_interfaces()."""
    t, m, meta = _target(), F.col("method"), F.col("metadata")
    returned = F.substring_index(meta["returnType"], "\\", -1)
    return _any(
        [
            m == "__model", meta["isInterface"], F.col("interface_class"), m.rlike("^__[a-z_]+__$"), meta["entrypoint_type"].isNotNull(),
            *(t.contains(p) for p in ENTRY_PARTS), m.isin(*FRAMEWORK_METHODS), m.rlike("^scope[A-Z]"), F.arrays_overlap(meta["attributes"], F.array(*map(F.lit, ENTRY_ATTRIBUTES))),
            *(m.rlike(p) for p in REFLECTED), returned.isin(*RELATION_TYPES), F.col("satisfies"), m.rlike("^(for|from)[A-Z]"), *(t.contains(p) for p in PUBLIC_PARTS), *(t.contains(p) for p in patterns),
        ]
    )


def is_utility() -> Column:
    """A21."""
    t, m = _target(), F.col("method")
    return _any([*(t.contains(p) for p in UTILITY_PARTS), F.col("metadata.returnType").isin("static", "self"), m.rlike("^with[A-Z]")])


def with_interfaces(graph: DependencyGraph) -> DataFrame:
    """Nodes with fan_in and fan_out, and whether the class is an interface, the method satisfies one, and others call the class."""
    links = graph.edges.where("type = 'interface_implementation'").where(F.col("dst").endswith("::__interface")).select(class_of(F.col("src")).alias("class"), class_of(F.col("dst")).alias("interface")).distinct()
    known = links.select(F.col("interface").alias("class")).distinct().withColumn("interface_class", F.lit(True))
    declared = links.join(graph.nodes.select(F.col("class").alias("interface"), "method"), "interface").select("class", "method").distinct().withColumn("satisfies", F.lit(True))
    # A class is called from outside where an edge from another class ends in one of its ids.
    outside = graph.edges.where(class_of(F.col("src")) != class_of(F.col("dst"))).select(class_of(F.col("dst")).alias("class")).distinct().withColumn("called", F.lit(True))
    return fans(graph).join(known, "class", "left").join(declared, ["class", "method"], "left").join(outside, "class", "left")


def _twentieths(points: list[tuple[Column, int]], base: int) -> Column:
    """Sums of twentieths, so that thresholds in tenths are exact."""
    total = F.lit(base)
    for test, value in points:
        total = total + F.when(F.coalesce(test, F.lit(False)), value).otherwise(0)
    return total


def orphan_confidence() -> Column:
    """A23."""
    t, m = _target(), F.col("method")
    never = _any([m.isin(*FRAMEWORK_METHODS), t.contains("Livewire") & m.isin("render", "mount"), *(m.rlike(p) for p in REFLECTED)])
    points = [
        (F.col("fan_out") == 0, 6), (~t.contains("Infrastructure") & ~t.contains("Bootstrap"), 2), (~t.contains("__"), 2), (F.col("called"), -4), (F.col("metadata.isStatic"), -3),
    ]
    return F.when(never, 0.0).otherwise(F.least(F.lit(20), _twentieths(points, 10)) / F.lit(20.0))


def confidence_level(c: Column) -> Column:
    """A25."""
    return F.when(c >= 0.8, "VERY_HIGH").when(c >= 0.6, "HIGH").when(c >= 0.4, "MEDIUM").otherwise("LOW")


def orphans(graph: DependencyGraph, patterns: Sequence[str] = ()) -> DataFrame:
    """Nodes that are no file, that nothing calls, and that are neither entry points nor helpers."""
    found = with_interfaces(graph).where("type <> 'file' and fan_in = 0").where(~is_entry(patterns)).where(~is_utility()).withColumn("confidence", orphan_confidence())
    c = F.col("confidence")
    reason = F.when(F.col("fan_out") == 0, "never called, calls nothing").otherwise(F.concat(F.lit("never called, calls "), F.col("fan_out").cast("string"), F.lit(" others")))
    return found.select("id", "node_seq", reason.alias("reason"), "confidence", F.round(c * 100).cast("int").alias("percent"), confidence_level(c).alias("level"), (c >= 0.8).alias("safe_to_remove"))


def suspicious_leaves(graph: DependencyGraph, patterns: Sequence[str] = ()) -> DataFrame:
    """Nodes that call nothing and are neither entry points nor helpers."""
    found = with_interfaces(graph).where("fan_out = 0").where(~is_entry(patterns)).where(~is_utility())
    points = [(F.col("fan_in") == 0, 8), (F.col("method").rlike("^(get|is|has|to|from)"), -4)]
    return found.select("id", "fan_in", (F.greatest(F.lit(0), F.least(F.lit(20), _twentieths(points, 6))) / F.lit(20.0)).alias("confidence"))


def orphan_stats(found: DataFrame) -> DataFrame:
    """Total, and how many are sure by either threshold."""
    return found.agg(F.count("*").alias("total"), F.count(F.when(F.col("confidence") > 0.7, 1)).alias("high_confidence"), F.count(F.when(F.col("confidence") >= 0.6, 1)).alias("high_or_more"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"))


def audit(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Evidence for each orphan in texts (scope, content): mentions by full name, short name and call.

    scope is internal, external, tests or docs.  Mentions are extracted once from the texts and
    joined by name, so texts aren't compared with every orphan.
    """
    pattern = r"([A-Za-z_\\][A-Za-z0-9_\\]*::[A-Za-z_]\w*)|->([A-Za-z_]\w*)\("
    hits = texts.select("scope", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(pattern), 1), F.transform(F.regexp_extract_all("content", F.lit(pattern), 2), lambda x: F.concat(F.lit("->"), x))))).alias("name")).where("name not in ('', '->')").distinct()
    cls, m = class_of(F.col("id")), method_of(F.col("id"))
    names = found.select("id", "safe_to_remove", F.explode(F.array_distinct(F.array("id", F.concat(F.substring_index(cls, "\\", -1), F.lit("::"), m), F.concat(F.lit("->"), m)))).alias("name"))
    count = [F.count(F.when(F.col("scope") == s, 1)).alias(s) for s in ("internal", "external", "tests", "docs")]
    seen = names.join(hits, "name", "left").groupBy("id", "safe_to_remove").agg(*count)
    verdict = F.when(F.col("internal") + F.col("external") > 0, "false_positive").when(F.col("safe_to_remove") & (F.col("tests") + F.col("docs") == 0), "abandoned").otherwise("investigate")
    return seen.withColumn("class", verdict)
