"""Every registered query: its Spark function and, where SQL can say it, the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


from graphloom.plans import assembly_queries, event_queries, graph_queries, service_queries, source_queries, text_queries  # noqa: E402, F401
