"""The event path as Structured Streaming: counts, idempotent keyed state, latest per key, daily trend.

Each query runs with ``availableNow`` over the event files; its state table is
written to the shared folder (``spark.checkpoint.dir``), where a batch reader
finds it. The results equal the batch aggregates, and the SQL is theirs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    base = base or tempfile.mkdtemp(prefix="regulith-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The event log as a stream of its files."""
    path = f"{sf_dir}/events.parquet"
    first = spark.read.parquet(path).inputFiles()[0]
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    if first.rstrip("/").endswith("events.parquet"):  # one file: streams read folders
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return reader.parquet(path)


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Run to the end of what is there; the last state (``complete``) or all rows (``append``) as a table."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'state' if mode == 'complete' else f'rows/batch={number}'}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    schema = stream.schema
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{folder}/state")
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """STR1."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def once(stream: DataFrame, key: str) -> DataFrame:
    """STR2: an event key counts once, however late it comes again; the state holds every key, as files may come in any order of time."""
    return stream.dropDuplicates([key])


def latest(stream: DataFrame, keys: list[str], value: Column, order: list[str]) -> DataFrame:
    """STR3."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("payload"))


def daily(stream: DataFrame) -> DataFrame:
    """STR4: rows of each day, with a watermark of one day for what comes late."""
    w = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    return w.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
