"""The data model: nodes, edges and symbols as DataFrames, and the derived node id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("params", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))),
        T.StructField("returnType", T.StringType()),
        T.StructField("endLine", T.IntegerType()),
        T.StructField("attributes", T.ArrayType(T.StringType())),
        T.StructField("isInterface", T.BooleanType()),
        T.StructField("isTrait", T.BooleanType()),
        T.StructField("isStatic", T.BooleanType()),
        T.StructField("relPath", T.StringType()),
        T.StructField("http_method", T.StringType()),
        T.StructField("http_path", T.StringType()),
        T.StructField("entrypoint_type", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    ]
)

NODES = T.StructType(
    [
        T.StructField("node_seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("qualifier", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("visibility_evaluated", T.BooleanType()),
        T.StructField("metadata", METADATA),
    ]
)

EDGES = T.StructType([T.StructField("edge_seq", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("src", "dst", "method", "type"))])

SYMBOLS = T.StructType(
    [
        T.StructField("symbol_seq", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("id", "name", "kind", "file")),
        T.StructField("line", T.IntegerType()),
        T.StructField("source_module", T.StringType()),
    ]
)

#: The class part and the member part of an id are set apart by this.
SEP = "::"


def node_id(class_: Column, method: Column, language: Column, type_: Column, qualifier: Column) -> Column:
    """M2: the id of a node; a qualifier stands on the class side, other languages than php are a prefix."""
    at = F.when(qualifier.isNotNull(), F.concat(F.lit("@"), qualifier)).otherwise(F.lit(""))
    own = F.when(F.coalesce(class_, F.lit("")) != "", F.concat(class_, F.lit("\\"))).otherwise(F.lit(""))
    body = (
        F.when(type_ == "file", F.concat(F.lit("file:"), class_))
        .when(type_ == "function", F.concat(F.lit("func:"), own, method, at))
        .otherwise(F.concat(class_, at, F.lit(SEP), method))
    )
    return F.when(language.isNull() | (language == "php"), body).otherwise(F.concat(language, F.lit(":"), body))


def class_of(id_: Column) -> Column:
    """The text before the first ``::``."""
    return F.substring_index(id_, SEP, 1)


def method_of(id_: Column) -> Column:
    """The text after the first ``::``; null if there is none."""
    return F.when(id_.contains(SEP), F.substring(id_, F.locate(SEP, id_) + 2, F.length(id_)))


def short_name(name: Column) -> Column:
    """The last segment of a name with backslashes."""
    return F.substring_index(name, "\\", -1)


@dataclass(frozen=True)
class DependencyGraph:
    """M5: nodes, edges and symbols.  Edges may point at ids that are no node."""

    nodes: DataFrame
    edges: DataFrame
    symbols: DataFrame | None = field(default=None)

    @classmethod
    def from_rows(cls, spark: SparkSession, nodes: Sequence[dict], edges: Sequence[tuple], symbols: Sequence[dict] = ()) -> DependencyGraph:
        """A graph from literals.

        nodes: dicts with class and method, and any other node column; edges: (src, dst[, type[, method]]).
        """
        rows = []
        for k, n in enumerate(nodes):
            row = {"node_seq": k + 1, "language": "php", "type": "method", "visibility": "public", "visibility_evaluated": False, "file": "", **n}
            rows.append(tuple(row.get(f.name) if f.name != "metadata" or row.get("metadata") is None else tuple(row["metadata"].get(g.name) for g in METADATA) for f in NODES))
        frame = spark.createDataFrame(rows, NODES)
        made = node_id(F.col("class"), F.col("method"), F.col("language"), F.col("type"), F.col("qualifier"))
        frame = frame.withColumn("id", F.coalesce("id", made))
        links = [(k + 1, e[0], e[1], e[3] if len(e) > 3 else "call", e[2] if len(e) > 2 else "method_call") for k, e in enumerate(edges)]
        marks = [tuple({"symbol_seq": k + 1, **s}.get(f.name) for f in SYMBOLS) for k, s in enumerate(symbols)]
        return cls(frame, spark.createDataFrame(links, EDGES), spark.createDataFrame(marks, SYMBOLS))

    def problems(self) -> DataFrame:
        """Rows that break the model: (id, problem)."""
        n = self.nodes
        made = node_id(n["class"], n["method"], n["language"], n["type"], n["qualifier"])
        found = n.select("id", F.when((F.coalesce("class", F.lit("")) == "") & (n["type"] != "function"), "empty class").when(F.coalesce("method", F.lit("")) == "", "empty method").when(n["line"] < 1, "line below 1").when(~n["id"].eqNullSafe(made), "id is not the derived one").alias("problem"))
        twice = n.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit("id is not unique").alias("problem"))
        return found.where("problem is not null").unionByName(twice)


def node_ids(graph: DependencyGraph) -> DataFrame:
    return graph.nodes.select("id").distinct()
