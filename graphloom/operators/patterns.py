"""Design patterns told from names, methods and interface edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph, class_of, method_of, short_name

# Method names and prefixes, and class suffixes, that tell a pattern.
REPOSITORY_PREFIXES = ("find", "get", "list", "search")
REPOSITORY_METHODS = ("save", "delete", "update", "create", "persist", "remove", "all", "paginate")
FACTORY_PREFIXES = ("create", "make", "build", "new", "from")
FACTORY_METHODS = ("of", "for")
STRATEGY_SUFFIXES = ("Strategy", "Policy", "Handler", "Processor", "Calculator", "Resolver", "Provider", "Adapter", "Interface")
OBSERVER_SUFFIXES = ("Observer", "Listener", "Subscriber")
OBSERVER_METHODS = ("created", "creating", "updated", "updating", "deleted", "deleting", "saved", "saving", "restored", "restoring", "forceDeleted", "handle", "onEvent", "notify", "update")
COMMAND_SUFFIXES = ("Command", "Job", "Handler", "Action")
ADAPTER_SUFFIXES = ("Adapter", "Gateway", "Bridge", "Wrapper")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _named(m: Column, prefixes: tuple[str, ...], names: tuple[str, ...]) -> Column:
    return _any([m.startswith(p) for p in prefixes] + [m.isin(*names)])


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    return _any([short_name(name).endswith(s) for s in suffixes])


def _methods(graph: DependencyGraph) -> DataFrame:
    """(class, m): methods of classes, without synthetic ones."""
    named = graph.nodes.select(class_of(F.col("id")).alias("class"), method_of(F.col("id")).alias("m"))
    return named.where("class <> '' and m is not null").where(~F.col("m").startswith("__"))


def _implements(graph: DependencyGraph) -> DataFrame:
    return graph.edges.where("type = 'interface_implementation'").select(class_of(F.col("src")).alias("class"), class_of(F.col("dst")).alias("interface")).where("class <> '' and interface <> ''")


def repositories(graph: DependencyGraph) -> DataFrame:
    """Classes named Repository with two persistence methods; HIGH if an interface of that name is implemented."""
    found = _methods(graph).where(_ends(F.col("class"), ("Repository",))).where(_named(F.col("m"), REPOSITORY_PREFIXES, REPOSITORY_METHODS)).groupBy("class").agg(F.count("*").alias("methods")).where("methods >= 2")
    paired = _implements(graph).where(F.col("interface").contains("Repository")).select("class").distinct().withColumn("paired", F.lit(True))
    return found.join(paired, "class", "left").select("class", "methods", F.when(F.col("paired"), "HIGH").otherwise("MEDIUM").alias("confidence"))


def factories(graph: DependencyGraph) -> DataFrame:
    """Classes named Factory with a creating method, or any class with two."""
    found = _methods(graph).where(_named(F.col("m"), FACTORY_PREFIXES, FACTORY_METHODS)).groupBy("class").agg(F.count("*").alias("methods"))
    named = short_name(F.col("class")).contains("Factory")
    return found.where(named | (F.col("methods") >= 2)).select("class", "methods", F.when(named, "HIGH").otherwise("MEDIUM").alias("confidence"))


def strategies(graph: DependencyGraph, suffixes: tuple[str, ...] = STRATEGY_SUFFIXES) -> DataFrame:
    """Interfaces of exchangeable behaviour with two implementing edges or more."""
    found = _implements(graph).groupBy("interface").agg(F.count("*").alias("implementations")).where("implementations >= 2")
    return found.where(_ends(F.col("interface"), suffixes)) if suffixes else found


def observers(graph: DependencyGraph) -> DataFrame:
    """L11."""
    found = _methods(graph).where(_ends(F.col("class"), OBSERVER_SUFFIXES)).where(_named(F.col("m"), ("on",), OBSERVER_METHODS)).groupBy("class").agg(F.count("*").alias("events"))
    return found.withColumn("subtype", F.when(short_name(F.col("class")).endswith("Subscriber"), "EventSubscriber").otherwise("Observer"))


def commands(graph: DependencyGraph) -> DataFrame:
    """Handle is preferred to execute; synthetic methods are not seen, so __invoke never counts."""
    found = _methods(graph).where(_ends(F.col("class"), COMMAND_SUFFIXES)).groupBy("class").agg(F.collect_set("m").alias("ms"))
    executor = F.coalesce(*(F.when(F.array_contains("ms", m), m) for m in ("handle", "execute")))
    return found.select("class", executor.alias("executor")).where("executor is not null")


def adapters(graph: DependencyGraph) -> DataFrame:
    """L13."""
    return _implements(graph).where(_ends(F.col("class"), ADAPTER_SUFFIXES)).groupBy("class").agg(F.count("*").alias("interfaces"))
