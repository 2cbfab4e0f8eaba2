"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

A document is the set of its distinct word shingles.  Two sets whose overlap reaches ``o`` share at
least l tokens within their first ``n - o + l`` tokens of any global order.  The order here is by
estimated frequency, rarest first, from a fixed-size counting sketch over every document.  Each
document picks its own l: the prefix grows while the estimated candidates of its tokens cost more
than the longer prefix.  Pairs are formed at tokens of the shortest prefixes (l = 1), and must share
correspondingly more tokens of both longer prefixes before they are verified.  Of tokens that stand in
exactly the same documents only the first is kept.  The last round forms a pair at the first token that both
have, so once and not at each token of a passage, and a token at place i of n also bounds what can
still be shared (n - i): a pair whose first token comes too late is dropped, as most pairs of edited copies are.

Equal sets are one class with its smallest doc_id, so copies cost nothing further.  Links only
matter for groups here: star rounds first verify each document against the most central document
it shares tokens with, the groups found are merged, and the last round joins all pairs whose
documents are still in different groups.  So a large group of near copies is never expanded into
its pairs, and no link between groups is missed.  Verification counts the exact overlap.

Defined cases: a null or empty text has the empty set, n_shingles 0, and is its own component;
repeated rows get equal results; rows that share a doc_id are one document, whose links join; a row
with a null doc_id has component null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common as C
from graphloom.llm.components import components

#: Cells of the frequency sketch.
CELLS = 1 << 16
#: Longest extension of a prefix, and the candidates that pay for one more token in it.
MOST_MATCHES, CANDIDATES_PER_TOKEN = 4, 24
#: Earlier tokens that a posting knows; a pair that shares a later one first may be formed more than once.
EARLIER = 64
#: Star rounds before all pairs between groups are joined.
STARS = 2
#: Parts into which the rows of a class of copies are dealt.
SALTS = 16


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of every distinct shingle, by row; A-Z count as a-z."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    starts, ends, first = C.word_spans(raw, offsets)
    h = C.word_hashes(raw, starts, ends)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = C.row_of(first, n)
    at = np.flatnonzero(np.arange(n) + k <= first[row + 1])
    runs = C.run_hashes(h, k)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    rows = np.concatenate([row[at], short])
    values = np.concatenate([runs[at], C.span_hashes(h, first[short], first[short + 1])])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]))
    return rows[new], values[new]


def _per_row(rows: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of the values of each row."""
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    at = np.searchsorted(rows, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def _signatures(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(rows, minlength=n)
    return size, _per_row(rows, n, C.mix(values)).view(np.int64), _per_row(rows, n, C.mix(values ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


_SURVEY = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("g", pa.int64())])


def _survey(k: int):
    """kind 0: size and signature of each document; kind 1: (cell, count) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for b in C.slices(batches):
            rows, values = shingle_sets(*C.utf8(b.column("text")), k)
            cells += np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            size, f, g = _signatures(rows, values, b.num_rows)
            yield pa.record_batch([pa.array(np.zeros(b.num_rows, np.int32)), b.column("doc_id"), pa.array(size), pa.array(f), pa.array(g)], schema=_SURVEY)
        full = np.flatnonzero(cells)
        zero = pa.array(np.zeros(len(full), np.int64))
        yield pa.record_batch([pa.array(np.ones(len(full), np.int32)), pa.array(full), pa.array(cells[full]), zero, zero], schema=_SURVEY)

    return run


def needed(n, percent: int):
    """Least overlap of a set of n with any set that it links to."""
    return -(-n * percent // 100)


_PREFIX = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("matches", pa.int32()), ("central", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _prefixes(k: int, percent: int, sketch: np.ndarray):
    floor = int(sketch.mean()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            rows, values = shingle_sets(*C.utf8(b.column("text")), k)
            often = sketch[(values & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((values, often, rows))
            values, often = values[order], often[order]
            n = np.bincount(rows, minlength=b.num_rows)
            first = np.append(0, np.cumsum(n))
            least = needed(n, percent)
            # Candidates that a token brings, beyond what is chance in a cell of the sketch.
            cost = np.append(0, np.cumsum(np.maximum(often - floor, 0)))
            base = np.minimum(n - least + 1, n)
            brings = cost[first[:-1] + base] - cost[first[:-1]]
            matches = np.ones(len(n), np.int64)
            for m in range(2, MOST_MATCHES + 1):
                longer = np.minimum(n - least + m, n)
                more = cost[first[:-1] + longer] - cost[first[:-1]]
                better = (matches == m - 1) & (m <= least) & (brings > CANDIDATES_PER_TOKEN) & (more // m + CANDIDATES_PER_TOKEN < brings // (m - 1))
                matches[better] = m
            length = np.where(n > 0, np.minimum(n - least + matches, n), 0)
            at = np.append(0, np.cumsum(length))
            pick = np.repeat(first[:-1] - at[:-1], length) + np.arange(at[-1])
            central = (cost[first[:-1] + base] - cost[first[:-1]]) // np.maximum(base, 1)
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(matches.astype(np.int32)), pa.array(central), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values[pick].view(np.int64)))],
                schema=_PREFIX,
            )

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text_a"):
            n = b.num_rows
            one, two = (shingle_sets(*C.utf8(b.column(c)), k) for c in ("text_a", "text_b"))
            rows, values = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
            order = np.lexsort((values, rows))
            rows, values = rows[order], values[order]
            twice = (rows[1:] == rows[:-1]) & (values[1:] == values[:-1])
            both = np.bincount(rows[1:][twice], minlength=n) if len(rows) > 1 else np.zeros(n, np.int64)
            union = np.bincount(rows, minlength=n) - both
            yield pa.record_batch([b.column("a"), b.column("b")], schema=_PAIR).filter(pa.array((100 * both >= percent * union) & (both > 0)))

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(k, percent), "a long, b long")


def _overlap(percent: int, x: str, y: str) -> str:
    """The overlap that a link of two sizes needs."""
    return f"ceil({percent}D * ({x}.n + {y}.n) / {100 + percent} - 1e-9)"


def _may_link(percent: int, x: str, y: str) -> str:
    """If this token is the first that both have, sizes and places allow the overlap that a link needs."""
    return f"least({x}.n - {x}.i, {y}.n - {y}.i) >= {_overlap(percent, x, y)} and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"


def _enough_shared(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share as many tokens as their lengths require.

    Tokens up to the smaller of the two prefix ends are counted in both prefixes; beyond it one side
    has no more than n - length left.
    """
    x, y = (prefixes.select(F.col("doc_id").alias(c), F.struct("n", "tokens").alias(f"s{c}")) for c in ("a", "b"))
    rows = pairs.select("a", "b").join(x, "a").join(y, "b")
    left = "greatest(sa.n - size(sa.tokens), sb.n - size(sb.tokens))"
    return rows.where(f"size(array_intersect(sa.tokens, sb.tokens)) >= {_overlap(percent, 'sa', 'sb')} - {left}").select("a", "b")


def _first_of_alike(few: DataFrame) -> DataFrame:
    """(t, w): of the tokens that stand in exactly the same rows only the first in the order, and how many they are.

    What two rows share first is the first of its kind, so no other token needs to form their pair.
    The sets of rows are told apart by their sizes, least rows and sums of 128 bits of hashes.
    """
    h, g = F.xxhash64("row"), F.xxhash64("row", F.lit(1))
    halves = [x for y in (h, g) for x in (y.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(y, 32))]
    sets = few.groupBy("t").agg(F.count("*").alias("m"), F.min(F.struct("row", "i")).alias("least"), *(F.sum(x).alias(f"h{k}") for k, x in enumerate(halves)))
    return sets.groupBy("m", "least.row", *(f"h{k}" for k in range(len(halves)))).agg(F.min(F.struct("least.i", "t")).alias("f"), F.count("*").alias("w")).select("f.t", "w")


def similarity_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    docs = C.keyed_documents(docs)
    survey = C.materialize(docs.mapInArrow(_survey(k), "kind int, doc_id long, n long, f long, g long"), "shingles")
    sketch = np.zeros(CELLS, np.int64)
    for r in survey.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        sketch[r["doc_id"]] = r["n"]
    sizes = survey.where("kind = 0").select("doc_id", "n", "f", "g")
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    found = docs.where("doc_id is not null").mapInArrow(_prefixes(k, percent, sketch), "doc_id long, n int, matches int, central long, tokens array<long>")
    # Rows that share a doc_id stay apart until they form pairs.
    prefixes = C.materialize(found.where("n > 0").join(reps, "doc_id", "left_semi").withColumn("row", F.monotonically_increasing_id()), "prefixes")
    C.release(docs.sparkSession)
    # Linked sets share a token of both shortest prefixes, so only those form pairs; the longer ones count.
    shortest = F.slice("tokens", F.lit(1), F.size("tokens") - F.col("matches") + 1)
    by_token = prefixes.select("row", F.posexplode(shortest).alias("i", "t"))
    shared = by_token.groupBy("t").agg(F.count("*").alias("m")).where("m > 1").select("t")
    few = C.materialize(by_token.join(shared, "t"), "postings")
    C.release(docs.sparkSession)
    own = few.join(_first_of_alike(few), "t").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "t", "w"))).alias("own"))
    listed = own.join(prefixes.select("row", "doc_id", "n", "central"), "row").select("doc_id", "n", "central", F.transform("own", lambda x: x["t"]).alias("ts"), F.posexplode("own").alias("nth", "o"))
    postings = C.materialize(listed.select("doc_id", "n", "central", "o.*", F.slice("ts", F.lit(1), F.least("nth", F.lit(EARLIER))).alias("before")), "postings")
    involved = postings.select("doc_id").distinct()
    texts = C.materialize(docs.join(involved, "doc_id", "left_semi"), "involved-texts")
    C.release(docs.sparkSession)
    groups, links = None, None

    def grouped() -> DataFrame:
        if groups is None:
            return postings.withColumn("c", F.col("doc_id"))
        rows = postings.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
        return C.materialize(rows, "postings")

    def merged(pairs: DataFrame) -> int:
        """Verifies the pairs and joins the groups that they link; the number of links."""
        nonlocal groups, links
        new = C.materialize(_links(_enough_shared(pairs, prefixes, percent), texts, k, percent), "links")
        count = new.count()
        if count:
            links = new if links is None else links.union(new)
            groups = components(links)
        C.release(docs.sparkSession)
        return count

    for turn in range(STARS):
        now = grouped().drop("before")
        rank = F.col("central") if turn == 0 else F.xxhash64("doc_id", F.lit(turn))
        hub = now.groupBy("t").agg(F.max(F.struct(rank.alias("r"), "doc_id", "n", "i", "c")).alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t", "hub.*").drop("r")
        star = now.alias("x").join(hub.alias("h"), "t").where("x.c <> h.c").where(_may_link(percent, "x", "h"))
        pairs = star.groupBy(F.col("h.doc_id").alias("a"), F.col("x.doc_id").alias("b")).agg(F.sum("x.w").alias("m"))
        merged(pairs.groupBy("b").agg(F.max(F.struct("m", "a")).alias("p")).select(F.col("p.a").alias("a"), "b"))
    now = grouped()
    rest = now.alias("x").join(now.alias("y"), "t").where("x.c < y.c").where(_may_link(percent, "x", "y")).where("not arrays_overlap(x.before, y.before)")
    merged(rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    # Only sets that stand more than once need their class; a class of very many copies is dealt out.
    copied = classes.where("rep <> last").select("n", "f", "g", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = dealt.join(copied, ["n", "f", "g", "salt"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")))
    if groups is not None:
        out = out.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    by_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), by_id.alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of the smallest doc_id of each group; rows without doc_id stay."""
    gone = similarity_groups(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
