"""Parquet tables as the library's canonical frames: dated events, articles, and text arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many bytes and files, rows are dealt to all cores before heavy work; larger tables have splits enough.
SMALL_BYTES, FEW_FILES = 256 << 20, 3


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table in few files on all cores, as one row group is read by one task; others as they are."""
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = int(str(size)) <= SMALL_BYTES and 0 < len(rows.inputFiles()) <= FEW_FILES
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if small else rows


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``event_date``; the topic of an event is its type."""
    return read(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))


def document_date() -> Column:
    """A document's date: 30 days from 2024-01-01 on, by id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ``topic`` (their source) and ``event_date``."""
    return spread(read(spark, sf_dir, "documents")).withColumns({"topic": F.col("source"), "event_date": document_date()})


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, texts): a conversation is an event, its turns in order are the event's texts."""
    turns = read(spark, sf_dir, "conversations")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda s: s["text"]).alias("texts"))
