"""The bounded sample of labelled rows, and fitting a classifier on it away from the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import common as C

#: Documents of each label in a sample, their characters in total, and those of one document, at most.
SAMPLE, SAMPLE_CHARS, LONGEST = 2000, 24_000_000, 400_000

_MODEL = pa.schema([("model", pa.binary())])


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, text and y of at most per_label documents of each label, and of ``chars`` characters; held-out rows are left out.

    Documents come in the order of a hash of their id.  Of rows that share a doc_id the smallest text
    and the larger label count, so the sample has one row per document whatever is repeated.  The
    sampled ids are few by construction, so they are broadcast and the texts aren't shuffled before
    they are few too.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    rows = C.keyed_documents(docs).where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))  # 2 * per_label rows at most
    return rows.withColumn("before", before).where(F.col("before") <= chars).select("doc_id", "text", "y")


def fitted(docs: DataFrame, labels: DataFrame, label: str, fit: Callable[[list[str], list[int]], object]) -> bytes:
    """The pickled model that ``fit`` makes of the sample's texts and labels, in one task of an executor.

    The sample is bounded, so it fits a task; the driver sees the finished model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True))
        model = fit([r[1] for r in rows], [r[2] for r in rows])
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], schema=_MODEL)

    found = sample(docs, labels, label).repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found["model"]) if found else pickle.dumps(fit([], []))
