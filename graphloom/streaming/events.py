"""Execution events: store, replay, monitor, rate limits (ST1-ST7, M13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("nodeId", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("durationMs", T.DoubleType()),
        T.StructField("inputs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("output", T.StringType()),
        T.StructField("exception", T.StringType()),
        T.StructField("context", T.StructType([*(T.StructField(c, T.StringType()) for c in ("id", "origin", "mode", "intent")), T.StructField("startedAt", T.DoubleType())])),
    ]
)
STARTED, SUCCEEDED, FAILED = "started", "succeeded", "failed"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC22: events of a folder of JSON lines."""
    return spark.read.schema(EVENTS).json(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC22 as a stream of the folder's files."""
    return spark.readStream.schema(EVENTS).json(path)


def append(events: DataFrame, path: str) -> None:
    """ST1: writes a batch of events as JSON lines; each task's file appears whole."""
    events.write.mode("append").json(path)


def start_append(events: DataFrame, path: str, checkpoint: str):
    """ST1 for a stream: writes what is there and ends."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_node(events: DataFrame, node: str) -> DataFrame:
    """ST2."""
    return events.where(F.col("nodeId") == node)


def since(events: DataFrame, timestamp: float) -> DataFrame:
    """ST2: from the timestamp on, which is included."""
    return events.where(F.col("timestamp") >= timestamp)


def replay(events: DataFrame, observer: Callable[[DataFrame], None], node: str | None = None, start: float | None = None) -> int:
    """ST3: hands events to an observer in order; returns how many."""
    rows = for_node(events, node) if node is not None else events
    rows = (since(rows, start) if start is not None else rows).orderBy("timestamp")
    observer(rows)
    return rows.count()


def monitor(events: DataFrame) -> DataFrame:
    """ST4: counts, mean duration and share of success over finished events; works on a stream in complete mode."""
    done = events.where(F.col("type").isin(SUCCEEDED, FAILED))
    ok = F.count(F.when(F.col("type") == SUCCEEDED, 1))
    n = F.count("*")
    return done.agg(n.alias("total"), ok.alias("succeeded"), (n - ok).alias("failed"), F.coalesce(F.avg("durationMs"), F.lit(0.0)).alias("average_ms"), F.coalesce(ok / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_rate"))


def recent(events: DataFrame, n: int = 100, *ties: str) -> DataFrame:
    """ST4: the last n events of any type (a ring buffer); further columns order events of one time."""
    return events.orderBy(F.col("timestamp").desc(), *ties).limit(n)


_DECIDED = "nodeId string, timestamp double, allowed boolean, used long"


def _greedy(times: list[float], kept: list[float], most: int, window: float) -> Iterator[tuple[bool, int]]:
    """Decisions in time order; kept, the allowed times in the window, is changed in place."""
    for t in times:
        while kept and kept[0] < t - window:
            kept.pop(0)
        ok = len(kept) < most
        if ok:
            kept.append(t)
        yield ok, len(kept)


def rate_limit(events: DataFrame, most: int, window: float) -> DataFrame:
    """ST5: per node, an event is allowed if fewer than ``most`` allowed ones lie within ``window`` seconds before it.

    Denied events use up nothing, so decisions depend on those before and no window function can
    make them.  Rows come to a task sorted by node and time, as Arrow batches of many nodes, and pass
    once; of a node only its allowed times within the window are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, kept = None, []
        for b in batches:
            names, times, allowed, used = b.column("nodeId").to_pylist(), b.column("timestamp").to_pylist(), [], []
            for name, t in zip(names, times, strict=True):
                if name != node:
                    node, kept = name, []
                ok, n = next(_greedy([t], kept, most, window))
                allowed.append(ok)
                used.append(n)
            yield pa.record_batch([b.column("nodeId"), b.column("timestamp"), pa.array(allowed, pa.bool_()), pa.array(used, pa.int64())], names=["nodeId", "timestamp", "allowed", "used"])

    rows = events.select(F.col("nodeId").cast("string").alias("nodeId"), F.col("timestamp").cast("double").alias("timestamp"))
    return rows.repartition("nodeId").sortWithinPartitions("nodeId", "timestamp").mapInArrow(run, _DECIDED)


def rate_limit_stream(events: DataFrame, most: int, window: float) -> DataFrame:
    """ST5 on a stream: the allowed times of each node are its state, which ends ``window`` after the last event."""

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        times = sorted(t for pdf in frames for t in pdf["timestamp"].tolist())
        found = list(_greedy(times, kept, most, window))
        state.update((kept,))
        state.setTimeoutDuration(max(1, int(window * 1000)))
        yield pd.DataFrame({"nodeId": key[0], "timestamp": times, "allowed": [a for a, _ in found], "used": [u for _, u in found]})

    return events.select("nodeId", "timestamp").groupBy("nodeId").applyInPandasWithState(decide, _DECIDED, "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def decide(events: DataFrame, policies: list[tuple[str, Column]]) -> DataFrame:
    """ST6: policies are columns that hold a reason to deny, or null; the first reason counts."""
    reason = F.coalesce(*(F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in policies)) if policies else F.lit(None).cast("string")
    return events.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def blacklist(names: list[str]) -> Column:
    """ST6: a policy for decide()."""
    return F.when(F.col("nodeId").isin(*names), F.concat(F.lit("blacklisted "), F.col("nodeId")))


def watch(spark: SparkSession, path: str, recompute: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, seconds: float = 2.0):
    """ST7: calls recompute with the changed files whenever the folder gets new ones."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    writer = files.writeStream.foreachBatch(recompute).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def sessions(operations: DataFrame) -> DataFrame:
    """ST8: sessions (session, mode, goal) with start, end and number of operations; started and ended are explicit."""
    return operations.groupBy("session", "mode", "goal").agg(F.min("at").alias("started"), F.max(F.when(F.col("operation") == "end", F.col("at"))).alias("ended"), F.count(F.when(~F.col("operation").isin("start", "end"), 1)).alias("operations"))
