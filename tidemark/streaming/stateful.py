"""Structured Streaming forms of the windows: watermarked counts, anchored date windows and running state.

A stream cannot know the earliest event, so anchored windows take the anchor as a parameter; with the batch's anchor and
input in order, results equal the batch's.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import assign_date_windows


def table_path(sf_dir: str, name: str) -> str:
    """A table for a stream, one Parquet file or a folder of them: a pattern, as a path without one must be a folder."""
    return f"{sf_dir}/{name}.parque[t]"


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A stream of the files of a table."""
    return spark.readStream.schema(schema).parquet(table_path(sf_dir, name))


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files in a folder; times without zone become timestamps, as watermarks need them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, duration: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Events per epoch-aligned window and keys; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", duration, slide), *keys).agg(F.count("*").alias("event_count"))


def anchored_counts(events: DataFrame, anchor: str, size: int, stride: int, *aggs: Column) -> DataFrame:
    """Events per anchored date window; keyed by the window's number, and numbered densely only where the result is read."""
    assigned = assign_date_windows(events.withColumn("event_date", F.to_date("ts")), size, stride, anchor=F.lit(anchor).cast("date"))
    return assigned.groupBy("window_number", "window_start", "window_end").agg(F.count("*").alias("event_count"), *aggs)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drives a stream over all there is and returns the memory table; for small results and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a stream over all there is into Parquet files, exactly once by the sink's log."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls ``write`` for each micro-batch; it must be idempotent in the batch's number."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while query.isActive:
        time.sleep(0.05)
    if query.exception():
        raise query.exception()
