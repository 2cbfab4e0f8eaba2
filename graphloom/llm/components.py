"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common as C

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Edges that a task contracts together.
BATCH = 1 << 20


def _contract(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The same components as stars: (id, smallest id) of every id but the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        while True:  # follow roots to their ends
            further = low[low]
            if (further == low).all():
                break
            low = further
        new = low[root]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(ids))
    return pa.record_batch([pa.array(ids[keep]), pa.array(ids[root[keep]])], schema=_EDGES)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
        n += batch.num_rows
        if n >= BATCH:
            yield _contract(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield _contract(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(low.select("u", "m")).where("a <> b")


def _stars(edges: DataFrame) -> DataFrame:
    """Every task turns its edges into stars, which keeps components and drops repeated edges; written to the shared folder."""
    return C.materialize(edges.mapInArrow(_contracted, "a long, b long"), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable; edges has the long columns a and b.

    Ids without an edge to another are left out.  Rounds end when every id has one star; their
    number grows with the logarithm of the longest path.
    """
    edges = _stars(edges.select("a", "b").where("a <> b"))
    while True:
        ends = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("ids")).first()
        inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi") if ends["n"] else None
        if not ends["n"] or (ends["n"] == ends["ids"] and inner.isEmpty()):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        edges = _stars(_small_star(_large_star(edges)))
