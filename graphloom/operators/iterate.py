"""The iterative kernels: bounded traversal, reachability, strongly connected components, peeling.

Every round's state is written to the shared folder (storage.cut), so plans stay short and a lost
executor costs one round.

Components, ancestor counts and layers first shrink the graph with joins; what is left is solved by
one task as soon as it has at most ``LOCAL`` edges, which bounds that task's memory.  Larger rests go
on in rounds of joins, so every size is solved whole and alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import chains
from graphloom.storage import cut

#: Edges of a graph that one task solves, at most (16 bytes each).
LOCAL = 4_000_000
#: Rounds in which vertices without callers or callees are left out before components are sought.
TRIMS = 3
#: Sources whose reach one task marks, as bits beside each vertex.
BITS = 1024
#: Bytes of ids, as they stand in the edges, of a graph whose pairs tasks list, at most.
NAMES = 1 << 28
#: Sources whose reach one task lists, and names in one row of a list.
SOURCES, PIECE = 16_384, 8192

DOWN, UP, BOTH = "downstream", "upstream", "both"


def adjacency(edges: DataFrame, direction: str = DOWN, types: list[str] | None = None) -> DataFrame:
    """(a, b, rank, edge_seq, type): steps from a to b; with both directions downstream steps come first."""
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    down = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("rank"), "edge_seq", "type")
    up = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("rank"), "edge_seq", "type")
    return {DOWN: down, UP: up, BOTH: down.union(up)}[direction]


def bfs(steps: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """K-BFS from every root at once: (root, id, depth, parent, ord, path).

    roots has the column root.  ord numbers a root's vertices of one depth in queue order, so a
    vertex's parent is the one that a queue would have found first.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    steps = cut(steps, "steps")
    found = cut(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("ord"), F.array("root").alias("path")).distinct(), "visited")
    parts, frontier = [found], found
    for depth in range(1, max_depth + 1):
        reach = frontier.select("root", F.col("id").alias("a"), F.col("ord").alias("po"), "path").join(steps, "a")
        reach = reach.join(_union(parts).select("root", F.col("id").alias("b")), ["root", "b"], "left_anti")
        first = reach.groupBy("root", "b").agg(F.min(F.struct("po", "rank", "edge_seq", "a", "path")).alias("s"))
        order = Window.partitionBy("root").orderBy("s.po", "s.rank", "s.edge_seq", "b")
        frontier = cut(first.select("root", F.col("b").alias("id"), F.lit(depth).alias("depth"), F.col("s.a").alias("parent"), F.row_number().over(order).alias("ord"), F.concat("s.path", F.array("b")).alias("path")), "visited")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reach(edges: DataFrame) -> DataFrame:
    """K-REACH: distinct (a, b) where a path of one edge or more leads from a to b.

    With at most LOCAL edges and NAMES bytes of ids, one task covers the graph with chains and sends it,
    compressed, to tasks that list what SOURCES ids each reach: no pair is written or shuffled on the
    way.  Larger graphs are solved by rounds of joins, whose pairs are written in every round.
    """
    links = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "reach")
    size = links.agg(F.count("*").alias("n"), F.sum(F.octet_length("a") + F.octet_length("b")).alias("bytes"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("nulls")).first()
    if size["n"] > LOCAL or size["nulls"] or (size["bytes"] or 0) > NAMES:
        return _doubled(links, size["n"])
    return _listed(links) if size["n"] else links


def _doubled(power: DataFrame, size: int) -> DataFrame:
    """The closure of size distinct (a, b) by rounds of joins.

    Walks are doubled: with all pairs up to 2^k steps and the pairs of exactly 2^k steps, one join
    gives all up to 2^(k+1), so the rounds grow with the logarithm of the longest shortest path.
    """
    known = power
    while size:
        step = power.select(F.col("a").alias("m"), F.col("b").alias("z"))
        grown = cut(known.union(known.join(step, known["b"] == step["m"]).select("a", "z")).distinct(), "reach")
        now = grown.count()
        if now == size:
            return grown
        power = cut(power.join(step, power["b"] == step["m"]).select("a", F.col("z").alias("b")).distinct(), "reach")
        known, size = grown, now
    return known


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the whole graph: names by place in a cover, beginnings of its chains, edges between places."""
    table = pa.Table.from_batches([pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]) for b in batches])
    if not table.num_rows:
        return
    ends = pa.chunked_array(table["a"].chunks + table["b"].chunks).combine_chunks().dictionary_encode()
    names, at = ends.dictionary, ends.indices.to_numpy().astype(np.int64)
    a, b = at[: table.num_rows], at[table.num_rows :]
    order, starts = chains.cover(len(names), a, b)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    graph = {"names": names.take(pa.array(order)), "starts": pa.array(starts), "x": pa.array(place[a]), "y": pa.array(place[b])}
    sink = pa.BufferOutputStream()
    row = pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in graph.values()], names=list(graph))
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    yield pa.record_batch([pa.array([len(np.unique(a))]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["sources", "graph"])


def _listed(links: DataFrame) -> DataFrame:
    """The closure of distinct (a, b), in tasks that each hold the whole graph."""
    spark = links.sparkSession
    graph = cut(links.repartition(1).mapInArrow(_covered, "sources long, graph binary"), "chains")
    tasks = -(-graph.first()["sources"] // SOURCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = pa.ipc.open_stream(batch.column("graph")[k].as_buffer()).read_next_batch()
                names, *numbers = (held.column(c).flatten() for c in ("names", "starts", "x", "y"))
                starts, x, y = (c.to_numpy() for c in numbers)
                search = chains.Search(len(names), starts, x, y)
                # Neighbours on a chain reach much alike, and tasks take turns, so all have their share of long chains.
                sources = np.unique(x)
                blocks = [sources[i : i + search.width] for i in range(0, len(sources), search.width)][batch.column("task")[k].as_py() :: tasks]
                for found in (f for block in blocks for f in search.reached(block)):
                    yield from _rows(names, *found)

    rows = spark.range(tasks, numPartitions=tasks).toDF("task").crossJoin(F.broadcast(graph.select("graph"))).mapInArrow(run, "a string, b array<string>")  # graph is one row
    return rows.select("a", F.explode("b").alias("b"))


def _rows(names: pa.Array, source: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, list of b) of the ranges lo..hi-1 that the sources reach, a bounded number of names at a time."""
    pieces = -(-(hi - lo) // PIECE)
    nth = chains.spread(np.zeros(len(pieces), np.int64), pieces)
    source, lo, hi = (np.repeat(c, pieces) for c in (source, lo, hi))
    lo = lo + nth * PIECE
    hi = np.minimum(hi, lo + PIECE)
    turn = np.cumsum(hi - lo) // (8 * PIECE)
    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(turn)) + 1):
        if len(part):
            offsets = np.append(0, np.cumsum(hi[part] - lo[part])).astype(np.int32)
            reached = names.take(pa.array(chains.spread(lo[part], hi[part])))
            yield pa.record_batch([names.take(pa.array(source[part])), pa.ListArray.from_arrays(pa.array(offsets), reached)], names=["a", "b"])


def _numbered(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) of 64-bit hashes of the ids, without self-loops."""
    return edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")).where("a <> b").distinct()


def _in_one_task(edges: DataFrame, solve: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """solve(a, b) over all edges in a single task; edges are LOCAL at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches]
        if held:
            yield pa.RecordBatch.from_pydict(solve(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return edges.select("a", "b").repartition(1).mapInArrow(run, schema)


def _tarjan(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """(component, id) of the components of two vertices or more; a component is named by its least member."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    order = np.argsort(x, kind="stable")
    first, to = np.searchsorted(x[order], np.arange(len(ids) + 1)).tolist(), y[order].tolist()
    seen, low, on, stack, found, clock = [0] * len(ids), [0] * len(ids), [False] * len(ids), [], [], 0
    for root in range(len(ids)):
        if seen[root]:
            continue
        work = [(root, first[root])]
        while work:
            v, k = work.pop()
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                on[v] = True
                stack.append(v)
            elif k > first[v]:
                low[v] = min(low[v], low[to[k - 1]]) if on[to[k - 1]] else low[v]
            while k < first[v + 1]:
                w = to[k]
                k += 1
                if not seen[w]:
                    work += [(v, k), (w, first[w])]
                    break
                if on[w]:
                    low[v] = min(low[v], seen[w])
            else:
                if low[v] == seen[v]:
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        on[members[-1]] = False
                    if len(members) > 1:
                        found.append(members)
    least = [min(m) for m in found]
    return {"component": ids[[c for c, m in zip(least, found, strict=True) for _ in m]] if found else ids[:0], "id": ids[[w for m in found for w in m]] if found else ids[:0]}


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source is called and whose target calls: others are on no cycle."""
    called, calls = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    return cut(edges.join(called, "a", "left_semi").join(calls, "b", "left_semi").select("a", "b"), "trim")


def _colour_round(edges: DataFrame) -> DataFrame:
    """(component, id) of one component for each colour: the least vertex that reaches a vertex is its colour, and the colour's own component walks back to it."""
    colour = cut(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("c", F.col("v")), "colour")
    while True:
        pushed = edges.join(colour.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("c").alias("m"))
        new = cut(colour.join(pushed, "v", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), "colour")
        moved = not new.where("moved").isEmpty()
        colour = new.select("v", "c")
        if not moved:
            break
    same = cut(edges.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")), "colour")
    found = cut(colour.where("v = c").select("v", "c"), "colour")
    frontier = found
    while not frontier.isEmpty():
        back = same.join(frontier.select(F.col("v").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("v"), "c").distinct()
        frontier = cut(back.join(found, ["v", "c"], "left_anti"), "colour")
        found = cut(found.union(frontier), "colour")
    return found.select(F.col("c").alias("component"), F.col("v").alias("id"))


def strong_components(edges: DataFrame) -> DataFrame:
    """K-SCC: (component, id) of every strongly connected component of two vertices or more, named by its least id.

    A graph of at most LOCAL edges is solved in one task.  From a larger one, vertices that nothing
    calls or that call nothing are trimmed, and rounds of colouring take components out until it is small.
    """
    rest, parts = cut(_numbered(edges), "trim"), []
    size = rest.count()
    for _ in range(TRIMS):
        if size <= LOCAL:
            break
        rest = _trimmed(rest)
        size = rest.count()
    while size > LOCAL:
        found = cut(_colour_round(rest), "colour")
        parts.append(found)
        left = rest.join(found.select(F.col("id").alias("a")), "a", "left_anti").join(found.select(F.col("id").alias("b")), "b", "left_anti")
        rest = _trimmed(left)
        size = rest.count()
    if size:
        parts.append(cut(_in_one_task(rest, _tarjan, "component long, id long"), "components"))
    ids = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("id", F.xxhash64("name"))
    if not parts:
        return ids.where("false").select(F.col("name").alias("component"), F.col("name").alias("id"))
    many = _union(parts).withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1")
    named = cut(many.join(ids, "id").select("component", "name"), "components")
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    return named.join(least, "component").select(F.col("least").alias("component"), F.col("name").alias("id"))


def _mark(a: np.ndarray, b: np.ndarray, ids: np.ndarray, weight: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, weight of those of the block's BITS sources, themselves left out, that reach it) over an acyclic graph of indices into ids."""
    n = len(ids)
    level = chains.levels(n, a, b)
    sources = np.unique(a)[block * BITS : (block + 1) * BITS]
    marks = np.zeros((n, BITS // 64), np.uint64)
    place = np.arange(len(sources))
    marks[sources, place // 64] = np.uint64(1) << (place % 64).astype(np.uint64)
    order = np.lexsort((b, level[b]))
    a, b = a[order], b[order]
    bounds = np.flatnonzero(np.append(True, level[b][1:] != level[b][:-1])) if len(b) else np.zeros(0, np.int64)
    for x, y in zip(bounds, np.append(bounds[1:], len(b)), strict=True):
        heads = np.flatnonzero(np.append(True, b[x + 1 : y] != b[x : y - 1]))
        target = b[x:y][heads]
        marks[target] |= np.bitwise_or.reduceat(marks[a[x:y]], heads, axis=0)
    own = weight[sources]
    if (own == 1).all():
        total = np.bitwise_count(marks).sum(axis=1).astype(np.int64)
    else:
        bits = np.unpackbits(marks.view(np.uint8), axis=1, bitorder="little")[:, : len(sources)]
        total = bits @ own
    total[sources] -= own
    hit = np.flatnonzero(total)
    return hit, total[hit]


def ancestors(edges: DataFrame) -> DataFrame:
    """(id, n): how many other ids a path leads from to this one; ids without any are left out.

    Components are contracted first, so the graph is acyclic and its vertices weigh what they hold.
    With at most LOCAL edges left, tasks mark BITS sources each over the whole graph (sent to them,
    as its size is bounded) and the marks are added up: no pair of vertices is ever a row.  Larger
    graphs are counted from the pairs of the condensation.
    """
    members = strong_components(edges)
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    vertex = ids.join(members, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    weight = vertex.groupBy("component").agg(F.count("*").alias("w"))
    x, y = vertex.select(F.col("id").alias("src"), F.col("component").alias("a")), vertex.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    links = cut(edges.select("src", "dst").join(x, "src").join(y, "dst").where("a <> b").select("a", "b").distinct(), "condensed")
    n = links.count()
    if n <= LOCAL:
        above = _marked(links, weight, n)
    else:
        pairs = reach(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        above = pairs.join(weight.withColumnRenamed("component", "a"), "a").groupBy(F.col("b").alias("component")).agg(F.sum("w").alias("n"))
    every = vertex.join(weight, "component").join(above, "component", "left").select("id", (F.coalesce("n", F.lit(0).cast("long")) + F.col("w") - 1).alias("n"))
    return every.where("n > 0")


def _marked(links: DataFrame, weight: DataFrame, n: int) -> DataFrame:
    """(component, n): the weight of the components above each, by marks in tasks; links are n."""
    spark = links.sparkSession
    size = links.agg(F.count_distinct("a")).first()[0] if n > BITS else n  # vertices with a callee are the sources
    if not size:
        return weight.select("component", F.lit(0).cast("long").alias("n")).where("false")
    heavy = weight.where("w > 1").select(F.xxhash64("component").alias("v"), "w")
    graph = links.agg(F.collect_list(F.struct(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))).alias("e")).crossJoin(heavy.agg(F.collect_list(F.struct("v", "w")).alias("h")))  # two single rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                e, h = (batch.column(c).slice(k, 1).flatten() for c in ("e", "h"))
                a, b, v, w = (x.field(c).to_numpy(zero_copy_only=False) for x, c in ((e, "a"), (e, "b"), (h, "v"), (h, "w")))
                ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
                each = np.ones(len(ids), np.int64)
                known = np.isin(v, ids)
                each[np.searchsorted(ids, v[known])] = w[known]
                hit, n = _mark(ends[: len(a)], ends[len(a) :], ids, each, batch.column("block")[k].as_py())
                yield pa.RecordBatch.from_pydict({"v": ids[hit], "n": n})

    blocks = -(-size // BITS)
    marks = spark.range(blocks, numPartitions=blocks).toDF("block").crossJoin(F.broadcast(graph)).mapInArrow(run, "v long, n long")  # graph is one row of at most LOCAL edges
    names = weight.select("component", F.xxhash64("component").alias("v"))
    return marks.groupBy("v").agg(F.sum("n").alias("n")).join(names, "v").select("component", "n")


def _layers_in_task(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    level = chains.levels(len(ids), ends[len(a) :], ends[: len(a)])
    return {"v": ids, "layer": (level + 1).astype(np.int32)}


def peel(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """K-PEEL: (id, layer): layer n has the ids whose callees are all in earlier layers; null: none ever is.

    Callees come first; self-loops don't count; edges to ids outside the scope don't either.  With
    more than LOCAL edges, layers are taken off one after another until the rest is small.
    """
    inside = edges.select("src", "dst").where("src <> dst").distinct().join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    open_edges, rest, layers, n = cut(inside, "peel"), cut(ids.select("id").distinct(), "peel"), [], 0
    while open_edges.count() > LOCAL:
        layer = cut(rest.join(open_edges.select(F.col("src").alias("id")), "id", "left_anti"), "peel")
        if layer.isEmpty():
            break
        n += 1
        layers.append(layer.withColumn("layer", F.lit(n)))
        rest = cut(rest.join(layer, "id", "left_anti"), "peel")
        open_edges = cut(open_edges.join(layer.select(F.col("id").alias("dst")), "dst", "left_anti"), "peel")
    if open_edges.count() > LOCAL:  # every id left is on a cycle or above one
        solved = rest.select("id", F.lit(None).cast("int").alias("layer"))
    else:
        found = _in_one_task(_numbered(open_edges), _layers_in_task, "v long, layer int")
        known = rest.withColumn("v", F.xxhash64("id")).join(cut(found, "peel"), "v", "left")
        # Without an edge left an id is free at once; 0 stands for ids that never are.
        solved = known.select("id", F.when(F.col("layer").isNull(), n + 1).when(F.col("layer") > 0, F.col("layer") + n).cast("int").alias("layer"))
    return _union([solved, *(layer.select("id", "layer") for layer in layers)])
