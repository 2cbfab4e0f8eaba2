"""What the operators of this subpackage share: tables, scratch folders, words and hashes.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` in the UTF-8 text.  All hashing works on flat
numpy arrays over a slice of an Arrow batch, so the cost per byte is a few array operations.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut, scratch  # noqa: F401

#: Text bytes that one numpy pass handles at a time.
SLICE_BYTES = 4 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """The rows of df written as Parquet to the shared folder and read again: lineage ends here."""
    return cut(df, label)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark drops the shuffle files of finished steps now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed_documents(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text, and the further columns given; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose column has about ``most`` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(n, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; words first[d]:first[d + 1] are those of row d."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    body = ~WHITE[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = body[:-1]
    starts = np.flatnonzero(body & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = body[1:]
    ends = np.flatnonzero(body & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = np.random.RandomState(20240607).randint(1, 2**63, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_BASE = 0x9E3779B97F4A7C15
_SEQ_BASE = 0xD1342543DE82EF95
_SEQ_INVERSE = pow(_SEQ_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    at = np.arange(len(raw), dtype=np.int64)
    at[: starts[0]] = 0
    spread = np.diff(np.append(starts, len(raw)))
    at[starts[0] :] -= np.repeat(starts, spread)
    value = _BYTE[raw]
    value[WHITE[raw]] = 0
    value *= _powers(_WORD_BASE, int(at.max()) + 1)[at]
    return mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling; entry i covers h[i:i+k] (len(h) - k + 1 entries)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, span = np.zeros(n, np.uint64), 0, h.copy(), 1
    rest = k
    while rest:
        if rest & 1:
            out += power[done : done + n] * np.uint64(pow(_SEQ_BASE, done, 2**64))
            done += span
        rest >>= 1
        if rest:
            power = power[:-span] + power[span:] * np.uint64(pow(_SEQ_BASE, span, 2**64))
            span *= 2
    return mix(out)


def span_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of h[lo:hi] for many spans of any length, from prefix sums."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_SEQ_BASE, len(h)), out=total[1:])
    inverse = _powers(_SEQ_INVERSE, len(h) + 1)
    return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of n items, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)
