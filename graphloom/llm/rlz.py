"""Substring dedup by relative Lempel-Ziv parsing.

Every document is cut, by its own words, into overlapping *reference blocks*: each window of
``window`` words picks its smallest k-gram as anchor, and neighbouring windows with one anchor
form a block.  Equal passages hold equal blocks wherever they stand, so an index of all blocks of
the corpus (block hash -> earliest place) lets each document be factored greedily from left to right:
a block seen earlier starts a factor (source document, source start, length), blocks that go on from
there in the same source extend it, and a factor of ``window`` words or more is a duplicate span.
Only blocks at factor boundaries (their anchor is known elsewhere, with other surroundings) are
checked window by window; windows seen earlier are factors of their own or extend one.

Why this is exact: a window seen earlier either lies in a block seen earlier, or in the first
copy of a block whose anchor has other blocks too; exactly the latter have their windows compared.

Hot passages: each task sends one row per distinct block and group of documents, so a passage in a
third of all documents costs one row per task.  No group is collected; places meet in windowed
minima over (anchor) or (anchor, window).

Defined cases: a null or empty text has no words (n_words 0, hash of the empty string); texts
under ``window`` words are kept; rows that share a doc_id are one document and never remove each
other's words; a null doc_id sorts first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import common as C

WINDOW = 20
#: Words of an anchor.
ANCHOR = 5
#: Text bytes over which a task joins equal blocks before it sends them.
GROUP_BYTES = 48 << 20

#: A block: anchor, hash, place and windows; a block that its task saw earlier has that place as its source.
_ROWS = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("alone", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("source", pa.int64()), ("at", pa.int32())])
_ROWS_SQL = "a long, s long, alone long, doc long, lo int, n int, source long, at int"


def blocks(h: np.ndarray, first: np.ndarray, window: int, anchor: int):
    """(row, anchor hash, start, number of windows) of each block; starts count from the slice's first word."""
    spread = window - anchor + 1
    n = len(h)
    if n < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = C.run_hashes(h, anchor)
    best, span = np.arange(len(grams)), 1
    while span < spread:
        step = min(span, spread - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        span += step
    row = C.row_of(first, n)
    start = np.flatnonzero(np.arange(n - window + 1) + window <= first[row[: n - window + 1] + 1])
    if not len(start):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, of = best[start], row[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    return of[head], grams[at[head]], start[head], np.diff(np.append(head, len(start)))


def _first_of_task(a, s, doc, lo, n) -> pa.RecordBatch:
    """One row for each distinct (a, s), its earliest; later ones are marked as seen and stay alone."""
    order = np.lexsort((lo, doc, s, a))
    a, s, doc, lo, n = a[order], s[order], doc[order], lo[order], n[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else np.zeros(0, np.int64)
    same = (doc == doc[head]) & (lo == lo[head])
    again = ~same
    alone = np.where(again, doc * 31 + lo + 1, 0)  # seen rows are dealt out by document, not by block
    source, at = (pa.array(x, mask=same) for x in (doc[head], lo[head].astype(np.int32)))
    return pa.record_batch([a.view(np.int64), s.view(np.int64), alone, doc, lo.astype(np.int32), n.astype(np.int32), source, at], schema=_ROWS)


def _gathered(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for nbytes, *cols in parts:
        held.append(cols)
        size += nbytes
        if size >= GROUP_BYTES:
            yield _first_of_task(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _first_of_task(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _block_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in C.slices(batches):
                raw, offsets = C.utf8(b.column("text"))
                starts, ends, first = C.word_spans(raw, offsets)
                h = C.word_hashes(raw, starts, ends)
                row, a, lo, n = blocks(h, first, window, anchor)
                s = C.span_hashes(h, lo, lo + n + window - 1)
                doc = b.column("doc").to_numpy(zero_copy_only=False)[row]
                yield len(raw), a, s, doc, lo - first[row], n

        yield from _gathered(parts())

    return run


def _boundary_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in C.slices(batches):
                raw, offsets = C.utf8(b.column("text"))
                starts, ends, first = C.word_spans(raw, offsets)
                h = C.word_hashes(raw, starts, ends)
                row, a, lo, n = blocks(h, first, window, anchor)
                base, flat = _lists(b.column("pending"))
                want = np.repeat(np.arange(len(base) - 1), np.diff(base)) * (1 << 32) + flat
                pick = np.isin(row * (1 << 32) + (lo - first[row]), want)
                row, a, lo, n = row[pick], a[pick], lo[pick], n[pick]
                each = np.repeat(np.arange(len(lo)), n)
                at = np.repeat(lo, n) + (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                grams = C.run_hashes(h, window)
                doc = b.column("doc").to_numpy(zero_copy_only=False)[row[each]]
                yield len(raw), a[each], grams[at] if len(at) else np.zeros(0, np.uint64), doc, at - first[row[each]], np.ones(len(at), np.int64)

        yield from _gathered(parts())

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of an integer list column; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(sizes)), flat


def _spans(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, lo, n, source, at) of a column of lists of spans; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.drop_null().flatten()
    return np.repeat(np.arange(len(sizes)), sizes), *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n", "source", "at"))


def _decided(rows: DataFrame) -> DataFrame:
    """For each row the earlier place of its (a, s), if it has one (source, at), and whether its anchor has other blocks (other)."""
    place = F.struct("doc", "lo")
    by_anchor, by_block = Window.partitionBy("a", "alone"), Window.partitionBy("a", "alone", "s")
    first = F.min(place).over(by_block)
    seen = F.when(F.col("source").isNotNull(), F.struct(F.col("source").alias("doc"), F.col("at").alias("lo"))).when(place > first, first)
    found = rows.select("doc", "lo", "n", seen.alias("seen"), (F.min("s").over(by_anchor) != F.max("s").over(by_anchor)).alias("other"))
    return found.select("doc", "lo", "n", F.col("seen.doc").alias("source"), F.col("seen.lo").alias("at"), "other")


def factors(row: np.ndarray, lo: np.ndarray, size: np.ndarray, source: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, source document, source start) of each factor: blocks in order, each extending the one before it where it goes on in the same source."""
    order = np.lexsort((size, lo, row))
    row, lo, size, source, at = row[order], lo[order], size[order], source[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (at[1:] - lo[1:] != at[:-1] - lo[:-1]) | (lo[1:] > (lo + size)[:-1])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(lo + size, head) if len(head) else lo
    return row[head], lo[head], end - lo[head], source[head], at[head]


def _covered(first: np.ndarray, n_words: int, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the words that the spans (row, lo, hi) cover."""
    depth = np.zeros(n_words + 1, np.int64)
    np.add.at(depth, first[rows] + lo, 1)
    np.add.at(depth, first[rows] + hi, -1)
    return np.cumsum(depth[:-1]) > 0


def _kept_rows(columns: tuple[str, ...], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            raw, offsets = C.utf8(b.column("text"))
            starts, ends, first = C.word_spans(raw, offsets)
            found = [_spans(b.column(name)) for name in ("copied", "single")]
            row, lo, n, source, at = (np.concatenate(x) for x in zip(*found, strict=True))
            row, lo, size, _, _ = factors(row, lo, n + window - 1, source, at)
            gone = _covered(first, len(starts), row, lo, lo + size)
            n_factors = np.bincount(row, minlength=b.num_rows)
            n_words = np.diff(first)
            total = np.append(0, np.cumsum(gone))
            removed = total[first[1:]] - total[first[:-1]]
            # Each kept word with a space after it, in one array; rows are cut out of it.
            kept = np.flatnonzero(~gone)
            size = ends[kept] - starts[kept] + 1
            to = np.append(0, np.cumsum(size))
            index = np.repeat(starts[kept] - to[:-1], size) + np.arange(to[-1])
            flat = raw[np.minimum(index, max(len(raw) - 1, 0))] if len(raw) else raw
            flat = flat.copy()
            flat[to[1:] - 1] = 32
            at = to[np.searchsorted(kept, first)]
            text = [flat[x : max(x, y - 1)].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            cols = {
                "doc_id": b.column("doc_id"), "n_factors": n_factors.astype(np.int64), "n_words": n_words.astype(np.int64), "n_removed": removed.astype(np.int64),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in text], "kept_text": pa.array([x.decode() for x in text], pa.string()),
            }
            if "row" in columns:
                cols["row"] = b.column("row")
            yield pa.record_batch([cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c]) for c in columns], names=list(columns))

    return run


_OUT = {"doc_id": T.LongType(), "n_factors": T.LongType(), "n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType(), "kept_text": T.StringType()}


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, columns: tuple[str, ...] = ("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")) -> DataFrame:
    """Words covered by a window of ``window`` words that also starts earlier are removed.

    One row per input row.  n_factors counts the factors of its parse.  ``columns`` may also name
    kept_text (the words left, joined by one space) and row (a struct of the input row's columns).
    """
    carried = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    kinds = T.StructType([T.StructField(c, docs.schema if c == "row" else _OUT[c]) for c in columns])
    docs = C.keyed_documents(docs, carried).withColumn("doc", F.coalesce("doc_id", F.lit(-(2**62))))
    rows = docs.select("doc", "text").mapInArrow(_block_rows(window, anchor), _ROWS_SQL)
    found = _decided(rows).where("source is not null or other")
    span = F.struct("lo", "n", "source", "at")
    per_doc = found.groupBy("doc").agg(
        F.collect_list(F.when(F.col("source").isNotNull(), span)).alias("copied"),
        F.collect_list(F.when(F.col("source").isNull(), F.col("lo").cast("long"))).alias("pending"),
    )
    per_doc = C.materialize(per_doc, "rlz-factors")
    text = docs.select("doc", "text")
    open_ends = per_doc.where(F.size("pending") > 0).select("doc", "pending")
    edge = text.join(open_ends, "doc").select("doc", "text", "pending").mapInArrow(_boundary_rows(window, anchor), _ROWS_SQL)
    singles = _decided(edge).where("source is not null").groupBy("doc").agg(F.collect_list(span).alias("single"))
    keep = ["doc_id", "text", "copied", "single"] + ["row"] * ("row" in columns)
    joined = docs.join(per_doc.select("doc", "copied"), "doc", "left").join(singles, "doc", "left").select(*keep)
    return joined.mapInArrow(_kept_rows(columns, window), kinds)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, where a text that lost words is the words left; n_chars follows the text."""
    found = dedup_substrings(docs, window, columns=("n_removed", "kept_text", "row"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
