"""Incremental upkeep of timelines and change logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.steps import new_path, shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in each window of time, late ones up to the watermark."""
    w = F.window("ts", window)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def ingest(events: DataFrame, path: str) -> StreamingQuery:
    """Appends (node, ts, day) to a timeline of files by day; what is there when it starts, then ends."""
    rows = events.select(F.col("event_id").alias("node"), "ts", F.to_date("ts").alias("day"))
    return rows.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", path + "-progress").trigger(availableNow=True).start()


def work_off(queue: DataFrame, handle: Callable[[DataFrame, int], None], spark: SparkSession) -> StreamingQuery:
    """Hands every batch of a queue to `handle` once; progress is kept in the shared folder."""
    return queue.writeStream.foreachBatch(handle).option("checkpointLocation", f"{new_path(spark, 'queue')}").trigger(availableNow=True).start()


def timeline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a timeline that was taken in by the stream."""
    path = new_path(spark, "timeline")
    assert path.startswith(shared_dir(spark))
    ingest(stream_table(spark, sf_dir, "events"), path).awaitTermination()
    return spark.read.parquet(path).select("node", "ts")
