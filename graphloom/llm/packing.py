"""Packing documents into sequences by cutting-stock column generation.

Every document becomes whole sequences of ``capacity`` ids and one shorter rest.  Rests of one
length class (``WIDTH`` ids wide, counted at its upper end) are interchangeable, so the task is a
cutting-stock problem over the histogram of classes (at most ``capacity / WIDTH`` numbers, whatever
the corpus holds): a linear program over patterns, solved by the revised simplex method, where a
knapsack dynamic program prices new patterns.  Patterns are rounded down, what is left (a few rests
per pattern) is packed best fit, and the pieces, ranked within their class, take the places of the
patterns by arithmetic on their rank.  Padding is what rounding to classes leaves, about
``WIDTH / 2`` ids a rest.

Ranks come from counts per (block of pieces, class), so no class is gathered in one task.

Defined cases: a null or empty text has the end id alone; repeated rows are packed each by itself;
a null doc_id is carried as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import common as C
from graphloom.llm import tokens

CAPACITY = 1024
#: Columns are generated until the program is within this share of its lower bound, or so many were.
GAP, MOST_COLUMNS = 0.001, 3000
#: Ids that a length class spans; divides the capacity.
WIDTH = 8
#: Pieces in a block of documents, about.
BLOCK_PIECES = 4096

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _pieces(tokenizer: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for b in C.slices(batches, most=tokens.SLICE_BYTES):
            raw, offsets = C.utf8(b.column("text"))
            ids, first = tokens.with_end(*enc.encode(raw, offsets), end)
            sizes = np.diff(first)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = first[row] + start
            data = ids.astype("<u4")
            crc = np.fromiter((zlib.crc32(data[x : x + k]) for x, k in zip(at, length, strict=True)), np.int64, len(row))
            yield pa.record_batch([b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc), pa.array(sizes[row])], schema=_PIECES)

    return run


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack over the lengths."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        got = best[c - lengths[:k]] + values[:k]
        j = int(got.argmax())
        if got[j] > best[c - 1] + 1e-12:
            best[c], last[c] = got[j], j
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        pattern[last[c]] += 1
        c -= int(lengths[last[c]])
    return float(best[capacity]), pattern


def cutting_stock(lengths: np.ndarray, need: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, most: int = MOST_COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts) of the program min sum(x), patterns x >= need, x >= 0; lengths ascend.

    Revised simplex from one pattern per length (as many as fit); each step brings in the pattern
    that the knapsack values most at the current prices.
    """
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ need
    for _ in range(most):
        price = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = _price(price, lengths, capacity)
        total = amount.sum()
        if value <= 1 + 1e-9 or total - (need @ price) / value <= gap * total:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-10, amount / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        move = ratio[out]
        amount -= step * move
        amount[out] = move
        np.maximum(amount, 0, out=amount)
    return basis.T[:m], amount


def layout(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where pieces go: ranks rank..rank + size of a length fill sequences from sequence on, per at a time, from offset on.

    Rows: length, rank, size, sequence, per, offset; sorted by (length, rank).
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    used = dict.fromkeys(left, 0)
    sequence = 0

    def place(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for size in sorted(pattern, reverse=True):
            per = pattern[size]
            rows.append((size, used[size], per * times, sequence, per, offset))
            used[size] += per * times
            left[size] -= per * times
            offset += per * size
        sequence += times

    if left.get(capacity):
        place({capacity: 1}, left[capacity])
    short = np.array(sorted(x for x in left if x < capacity and left[x]), np.int64)
    if len(short):
        patterns, amounts = cutting_stock(short, np.array([left[int(x)] for x in short], float), capacity)
        for k in np.argsort(-amounts, kind="stable"):
            pattern = {int(short[i]): int(patterns[k][i]) for i in np.flatnonzero(patterns[k])}
            times = min([int(amounts[k] + 1e-9), *(left[x] // n for x, n in pattern.items())])
            if times:
                place(pattern, times)
        while any(left.values()):  # a few per pattern: the fullest sequence that the rest allows, largest first
            pattern, room = {}, capacity
            for size in sorted((x for x, n in left.items() if n), reverse=True):
                if n := min(left[size], room // size):
                    pattern[size], room = n, room - n * size
            place(pattern, max(1, min(left[x] // n for x, n in pattern.items())))
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("length", "rank", "size", "sequence", "per", "offset"), table.T, strict=True))


_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("slot", pa.int64())])


def _placed(plan: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan["length"] * (1 << 48) + plan["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            kind, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "rank"))
            k = np.searchsorted(key, kind * (1 << 48) + rank, side="right") - 1
            nth = rank - plan["rank"][k]
            sequence = plan["sequence"][k] + nth // plan["per"][k]
            slot = plan["offset"][k] + nth % plan["per"][k] * kind
            yield pa.record_batch([*(b.column(f.name).cast(f.type) for f in _PIECES), pa.array(sequence), pa.array(slot)], schema=_PLACED)

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    keyed = C.keyed_documents(docs)
    pieces = C.materialize(keyed.mapInArrow(_pieces(tokenizer, end, capacity), "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"), "pieces")
    pieces = pieces.withColumn("kind", F.ceil(F.col("length") / WIDTH).cast("int"))
    counts = {r["kind"]: r["n"] for r in pieces.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # capacity / WIDTH rows at most
    kinds = np.array(sorted(counts), np.int64)
    plan = layout(kinds, np.array([counts[int(x)] for x in kinds], np.int64), capacity // WIDTH)
    # Blocks and ranks follow from all of a piece's columns, so a task that runs again ranks alike; pieces that tie are the same.
    blocks = -(-sum(counts.values()) // BLOCK_PIECES) or 1
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(*own), F.lit(blocks)).cast("int"))
    within = F.row_number().over(Window.partitionBy("block", "kind").orderBy(*own)) - 1
    per_block = dealt.groupBy("block", "kind").agg(F.count("*").alias("n"))
    before = per_block.select("block", "kind", (F.sum("n").over(Window.partitionBy("kind").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("within", within).join(before, ["block", "kind"]).withColumn("rank", F.col("within") + F.col("before"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank").mapInArrow(
        _placed(plan), "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    )
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("length").cast("long")
    return placed.select("doc_id", "start", length.alias("length"), "ids_crc32", "doc_tokens", "sequence_id", (F.sum(length).over(in_order) - length).alias("offset"))
