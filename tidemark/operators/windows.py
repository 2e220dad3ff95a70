"""Segmenting dated events into windows by arithmetic, without range joins.

Date windows start at the anchor and every ``stride`` days after it; a window is half open and ``size`` days long.  An
event's windows are a range of window numbers, so assigning is an explode.  Empty windows do not exist; the index counts
the others in order from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("date", "sliding", "tumbling", "count", "incremental")


def check(size: int, stride: int) -> None:
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")


def window_numbers(offset: Column, size: int, stride: int) -> Column:
    """The numbers of the windows that hold a day ``offset`` days after the anchor; empty between windows."""
    high = F.floor(offset / stride)
    low = F.greatest(F.lit(0), F.floor((offset - size) / stride) + 1)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def assign_date_windows(events: DataFrame, size: int, stride: int = 1, date_col: str = "event_date", keys: Sequence[str] = (), anchor: Column | None = None) -> DataFrame:
    """One row per window and event, with window_number (not dense), window_start and window_end.

    The anchor is the earliest date, of all events or of those with the same ``keys``; a stream must name its own."""
    check(size, stride)
    events = events.where(F.col(date_col).isNotNull())
    if anchor is None and keys:
        least = events.groupBy(*keys).agg(F.min(date_col).alias("_anchor"))
        events, anchor = events.join(least, list(keys)), F.col("_anchor")
    elif anchor is None:
        anchor = events.agg(F.min(date_col)).scalar()
    numbered = events.withColumn("_anchor", anchor)
    numbered = numbered.withColumn("window_number", F.explode(window_numbers(F.datediff(date_col, "_anchor"), size, stride)))
    start = F.date_add("_anchor", (F.col("window_number") * stride).cast("int"))
    return numbered.withColumn("window_start", start).withColumn("window_end", F.date_add(start, size)).drop("_anchor")


def dense_index(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds window_index to a frame with one row per window. Windows are few, at most one per stride."""
    order = Window.partitionBy(*keys).orderBy("window_number")
    return windows.withColumn("window_index", (F.row_number().over(order) - 1).cast("long"))


def date_windows(events: DataFrame, size: int, stride: int, *aggs: Column, date_col: str = "event_date", keys: Sequence[str] = ()) -> DataFrame:
    """One row per non-empty window with its dense index, its bounds and ``aggs``."""
    assigned = assign_date_windows(events, size, stride, date_col, keys)
    per = assigned.groupBy(*keys, "window_number", "window_start", "window_end").agg(*aggs)
    return dense_index(per, keys).drop("window_number")


def window_events(events: DataFrame, size: int, stride: int, date_col: str = "event_date") -> DataFrame:
    """One row per window and event, with the dense window_index."""
    assigned = assign_date_windows(events, size, stride, date_col)
    index = dense_index(assigned.select("window_number").distinct())
    return assigned.join(index, "window_number").drop("window_number")


def ordered_number(events: DataFrame, date_col: str, *ties: str, bucket: Column | None = None) -> DataFrame:
    """Adds ``number``, from 0 in the order of date and ``ties``.

    Numbers come from a count within each bucket and the sums of the buckets before, so no task sees all events.  A bucket
    is a day, or what ``bucket`` says where days are too large, as the hour; it must follow the order."""
    events = events.withColumn("_bucket", F.col(date_col) if bucket is None else bucket)
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(date_col, *ties)) - 1
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per bucket
    starts = events.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", before.alias("_before"))
    return events.withColumn("_within", within).join(starts, "_bucket").withColumn("number", F.col("_before") + F.col("_within")).drop("_within", "_before", "_bucket")


def assign_count_windows(events: DataFrame, size: int, stride: int, date_col: str, *ties: str, bucket: Column | None = None) -> DataFrame:
    """One row per window and event; only full windows, starting at 0, stride, ...; none if there are fewer events than ``size``."""
    check(size, stride)
    numbered = ordered_number(events, date_col, *ties, bucket=bucket)
    last = F.floor((events.agg(F.count("*")).scalar() - size) / stride)
    return numbered.withColumn("window_index", F.explode(window_numbers(F.col("number"), size, stride))).where(F.col("window_index") <= last)


def incremental_windows(events: DataFrame, date_col: str, *ties: str, bucket: Column | None = None) -> DataFrame:
    """One row per window, the window's new event: window i holds the events 0 to i; start_date stays, end_date is the new event's."""
    numbered = ordered_number(events, date_col, *ties, bucket=bucket)
    return numbered.withColumns({"window_index": F.col("number"), "start_date": events.agg(F.min(date_col)).scalar(), "end_date": F.col(date_col), "event_count": F.col("number") + 1}).drop("number")


def create_windows(events: DataFrame, kind: str, size: int = 5, stride: int = 1, date_col: str = "event_date", ties: Sequence[str] = (), keys: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Dispatch by kind; tumbling is sliding with a stride of the size, ``keys`` gives each topic windows of its own.

    ``bucket``: what numbers events in place of the day, where days are too large for a task."""
    if kind not in KINDS:
        raise ValueError(f"unknown window kind {kind!r}")
    if kind == "count":
        return assign_count_windows(events, size, stride, date_col, *ties, bucket=bucket)
    if kind == "incremental":
        return incremental_windows(events, date_col, *ties, bucket=bucket)
    return assign_date_windows(events, size, size if kind == "tumbling" else stride, date_col, keys)


def windows_containing(windows: DataFrame, date: Column) -> DataFrame:
    return windows.where((F.col("window_start") <= date) & (date < F.col("window_end")))


def in_range(events: DataFrame, start: Column, end: Column, date_col: str = "event_date") -> DataFrame:
    return events.where((F.col(date_col) >= start) & (F.col(date_col) < end))


def window_summary(per_window: DataFrame, count_col: str = "event_count") -> DataFrame:
    """n_windows, total_events, mean_events and the extremes over per-window counts."""
    n = F.col(count_col)
    return per_window.agg(F.count("*").alias("n_windows"), F.sum(n).alias("total_events"), F.avg(n).alias("mean_events"), F.min(n).alias("min_events"), F.max(n).alias("max_events"))
