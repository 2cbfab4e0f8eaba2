"""Queries over execution events; the table of user events stands in for a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import projections as P
from graphloom.plans.registry import query
from graphloom.streaming import events as E

EVENTS_SQL = """WITH RECURSIVE log AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' ELSE 'succeeded' END AS type, 'u' || user_id AS node, epoch_us(ts) / 1000000.0::DOUBLE AS t, value AS ms FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", E.FAILED).when(F.col("event_type") == "view", E.STARTED).otherwise(E.SUCCEEDED)
    return e.select("event_id", kind.alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("nodeId"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).alias("timestamp"), F.col("value").alias("durationMs"))


@query(f"""{EVENTS_SQL}, done AS (SELECT * FROM log WHERE type <> 'started') SELECT count(*)::BIGINT AS total, (count(*) FILTER (type = 'succeeded'))::BIGINT AS succeeded, (count(*) FILTER (type = 'failed'))::BIGINT AS failed, round(avg(ms), 6) AS average_ms, round((count(*) FILTER (type = 'succeeded')) / count(*)::DOUBLE, 6) AS success_rate FROM done""")
def monitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.monitor(log(spark, sf_dir)).withColumn("average_ms", F.round("average_ms", 6)).withColumn("success_rate", F.round("success_rate", 6))


@query(f"{EVENTS_SQL} SELECT event_id, type FROM log WHERE t >= (SELECT t FROM log WHERE event_id = 100)")
def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir)
    return E.since(e, e.where("event_id = 100").first()["timestamp"]).select("event_id", "type")


@query(f"{EVENTS_SQL} SELECT event_id, type FROM log WHERE node = 'u7'")
def events_for_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.for_node(log(spark, sf_dir), "u7").select("event_id", "type")


@query(f"{EVENTS_SQL} SELECT event_id, type FROM log ORDER BY t DESC, event_id LIMIT 100")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recent(log(spark, sf_dir), 100, "event_id").select("event_id", "type")


@query(f"""{EVENTS_SQL}, seq AS (SELECT node, t, row_number() OVER (PARTITION BY node ORDER BY t) AS i FROM log),
run AS (SELECT node, t, i, [t] AS kept, TRUE AS allowed FROM seq WHERE i = 1 UNION ALL
  SELECT s.node, s.t, s.i, CASE WHEN len(list_filter(r.kept, lambda x: x >= s.t - 86400)) < 3 THEN list_append(list_filter(r.kept, lambda x: x >= s.t - 86400), s.t) ELSE list_filter(r.kept, lambda x: x >= s.t - 86400) END, len(list_filter(r.kept, lambda x: x >= s.t - 86400)) < 3
  FROM run r JOIN seq s ON s.node = r.node AND s.i = r.i + 1) SELECT node AS "nodeId", count(*)::BIGINT AS events, (count(*) FILTER (allowed))::BIGINT AS allowed FROM run GROUP BY node""")
def rate_limit_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rate_limit(log(spark, sf_dir), 3, 86400.0).groupBy("nodeId").agg(F.count("*").alias("events"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"))


@query(f"{EVENTS_SQL} SELECT event_id, CASE WHEN node IN ('u1', 'u2') THEN 'list: blacklisted ' || node WHEN ms > 50 THEN 'slow: above 50' END AS reason FROM log")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decide(log(spark, sf_dir), [("list", E.blacklist(["u1", "u2"])), ("slow", F.when(F.col("durationMs") > 50, "above 50"))]).select("event_id", "reason")
