"""Streaming queries, run over the files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgate.plans.registry import query
from pointgate.streaming.streams import capped, finish, stream


@query("stream_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by hour and type."""
    s = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 days").groupBy(F.window("ts", "1 hour"), "event_type")
    out = finish(s.agg(F.count("*").alias("n"), F.sum("value").alias("total")), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_dedup", "SELECT DISTINCT packet_id FROM packet_features WHERE ingested_at IS NOT NULL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets once, though some are delivered again, even weeks later."""
    s = stream(spark, sf_dir, "packet_features").where(F.col("ingested_at").isNotNull()).select("packet_id", F.col("ingested_at").cast("timestamp").alias("at"))
    return finish(s.withWatermark("at", "20 years").dropDuplicatesWithinWatermark(["packet_id"]), "append").select("packet_id")


@query("stream_state", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20 AS allowed FROM events")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 20 events for each user, kept as state."""
    s = stream(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return finish(capped(s, "user_id", ["ts", "event_id"], 20), "append").select("user_id", "event_id", "used", "allowed")


@query(
    "stream_gate",
    """WITH e AS (SELECT ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20'), w AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY * k AS start FROM e, range(3) r(k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
)
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of three days over events strictly before a cutoff."""
    s = stream(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy(F.window("ts", "3 days", "1 day"), "event_type")
    return finish(s.agg(F.count("*").alias("n")), "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
