"""Training and applying the ordinal classifiers: a bounded labelled sample is fitted on the driver, all rows are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import CumulativeLink
from .scratch import numbered_columns, place, released, slices, spread

Features = Callable[[str], np.ndarray]


def sample(docs: DataFrame, labels: DataFrame, grade: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, grade) of at most ``max_rows`` labelled rows, the first in the order of a hash of their ids.

    The sample's ids are broadcast; ``max_rows`` bounds their size.  Of several rows of an id one is taken, by a hash of
    its text, so that ``max_rows`` bounds the sample too."""
    chosen = labels.select("doc_id", grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.join(F.broadcast(chosen), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("grade").alias("grade"))


def featured(rows: DataFrame, features: Features) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature rows, grades and ids of a sample, in the order of their ids, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [features(t.as_py() or "").astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["doc_id", "f", "grade"])

    got = sorted(rows.mapInArrow(released(run), "doc_id long, f binary, grade int").collect(), key=lambda r: (r.doc_id, r.f))
    return [np.frombuffer(r.f, "<i4") for r in got], np.array([r.grade for r in got], int), np.array([r.doc_id for r in got], np.int64)


def _sent(model: CumulativeLink) -> Callable[[], CumulativeLink]:
    """What makes the model again on an executor; only weights in use are sent."""
    used = np.flatnonzero(model.weights)
    at, weights, dims, thresholds = used.astype("<i4").tobytes(), model.weights[used].tobytes(), len(model.weights), model.thresholds

    def made() -> CumulativeLink:
        whole = np.zeros(dims, np.float32)
        whole[np.frombuffer(at, "<i4")] = np.frombuffer(weights, np.float32)
        return CumulativeLink(whole, thresholds)

    return made


def passing(df: DataFrame, text_col: str, model: CumulativeLink, features: Features, cut: float) -> DataFrame:
    """The rows of ``df`` for which P(grade >= 1) reaches ``cut``, in one pass without a join."""
    made, at = _sent(model), place(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made()
        for batch in slices(batches):
            yield batch.filter(pa.array([own.tails(features(t.as_py() or ""))[0] >= cut for t in batch.column(at)], pa.bool_()))

    rows = numbered_columns(df)  # so that names of columns can't clash
    return spread(rows).mapInArrow(released(run), rows.schema).toDF(*df.columns)


def scored(docs: DataFrame, model: CumulativeLink, features: Features) -> DataFrame:
    """(doc_id, tails) of every row: tails[k - 1] is P(grade >= k)."""
    made = _sent(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made()
        for batch in slices(batches):
            tails = [own.tails(features(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails, pa.list_(pa.float64()))], ["doc_id", "tails"])

    return spread(docs).mapInArrow(released(run), "doc_id long, tails array<double>")
