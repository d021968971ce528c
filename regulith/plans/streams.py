"""The streaming queries; each SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..streaming import events as ev


@query("stream_event_counts", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """STR1."""
    return ev.run(ev.counts(ev.events(spark, d).withColumn("bucket", F.col("user_id") % 10), ["event_type", "bucket"]), "complete")


@query("stream_idempotent_counter", "SELECT event_type, count(*) AS hit_count FROM events GROUP BY 1")
def stream_idempotent_counter(spark: SparkSession, d: str) -> DataFrame:
    """STR2: every event is sent twice; each counts once."""
    e = ev.events(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    rows = ev.run(ev.once(twice, "event_id").select("event_id", "event_type"), "append")
    return rows.groupBy("event_type").agg(F.count("*").alias("hit_count"))


@query("stream_latest_payload", "SELECT user_id, arg_max(props, struct_pack(t := ts, e := event_id)) AS payload FROM events GROUP BY 1")
def stream_latest_payload(spark: SparkSession, d: str) -> DataFrame:
    """STR3."""
    return ev.run(ev.latest(ev.events(spark, d), ["user_id"], F.col("props"), ["ts", "event_id"]), "complete")


@query("stream_daily_trend", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_trend(spark: SparkSession, d: str) -> DataFrame:
    """STR4."""
    return ev.run(ev.daily(ev.events(spark, d)), "complete")
