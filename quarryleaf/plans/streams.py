"""Queries of streaming/events.py, here over the whole table as a batch; tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.plans.adapters import table
from quarryleaf.registry import query
from quarryleaf.streaming import events as op


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return op.tumbling(events(spark, d), "ts", "6 hours", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sliding", "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def _(spark, d):
    return op.sliding(events(spark, d), "ts", "12 hours", "6 hours", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("events_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def _(spark, d):
    return op.sessions(events(spark, d), "ts", "8 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("events_once", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, d):
    return op.once(events(spark, d), "ts", ["user_id", "event_type"], "1 hour").agg(F.count("*").alias("n"))
