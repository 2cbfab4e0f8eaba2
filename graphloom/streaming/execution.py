"""Running the functions that nodes stand for, as events (UDF1, ST6).

A call is a row (node, inputs).  It is decided by the policies first; an allowed one is run in a task
and leaves a started and a succeeded or failed event, a denied one a failed event with the reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.streaming import events as E

_SCHEMA = pa.schema([("type", pa.string()), ("nodeId", pa.string()), ("timestamp", pa.float64()), ("durationMs", pa.float64()), ("output", pa.string()), ("exception", pa.string())])
EVENTS = "type string, nodeId string, timestamp double, durationMs double, output string, exception string"


def execute(calls: DataFrame, functions: Mapping[str, Callable[..., object]], policies: list[tuple[str, Column]] = ()) -> DataFrame:
    """Events of calls (nodeId, inputs map of texts); a call of an unknown node fails.

    A call that raises is an event, not an error of the job.  A task that runs again runs its calls
    again, so functions should bear that.
    """
    known = dict(functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for node, inputs, reason in zip(*(b.column(c).to_pylist() for c in ("nodeId", "inputs", "reason")), strict=True):
                began = time.time()
                if reason is not None:
                    rows.append((E.FAILED, node, began, 0.0, None, reason))
                    continue
                rows.append((E.STARTED, node, began, None, None, None))
                try:
                    if node not in known:
                        raise LookupError(f"node not found: {node}")
                    said = known[node](**dict(inputs or {}))
                    rows.append((E.SUCCEEDED, node, time.time(), (time.time() - began) * 1000, None if said is None else str(said), None))
                except Exception as error:  # whatever user code raises becomes its event
                    rows.append((E.FAILED, node, time.time(), (time.time() - began) * 1000, None, f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], schema=_SCHEMA)

    decided = E.decide(calls, list(policies)).select(F.col("nodeId").cast("string").alias("nodeId"), F.col("inputs").cast("map<string,string>").alias("inputs"), "reason")
    return decided.mapInArrow(run, EVENTS)
