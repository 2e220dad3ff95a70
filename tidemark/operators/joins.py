"""Joins over windows, dates, runs and vectors, each on an equality with the inequality as a residue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_date_semi(units: DataFrame, assigned: DataFrame, date_col: str = "event_date") -> DataFrame:
    """Units whose date is among a window's event dates, once per window."""
    return units.join(assigned.select("window_index", date_col).distinct(), date_col)


def as_of(questions: DataFrame, articles: DataFrame, keys: Sequence[str], question_date: str, article_date: str, strict: bool = False) -> DataFrame:
    """Every article of the same keys not dated after the question; a question without a date sees all."""
    seen = F.col(article_date) < F.col(question_date) if strict else F.col(article_date) <= F.col(question_date)
    return questions.join(articles, list(keys)).where(F.col(question_date).isNull() | seen)


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points in half-open spans; both get buckets of ``width``, spans all those that they touch."""
    bucket = lambda c: F.floor(c / width)
    cut = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.greatest(F.col(start), F.col(end) - 1)))))
    joined = points.withColumn("_bucket", bucket(F.col(point))).join(cut, "_bucket").drop("_bucket")
    return joined.where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))


def nearest(queries: DataFrame, targets: DataFrame, query_key: str, target_key: str, similarity: Column, shard: int = 64) -> DataFrame:
    """Each query's most similar target, the least key on a tie.

    Targets are topics, far fewer than queries; they are copied to ``shard`` parts of the queries, so that neither side
    is collected anywhere, and the best is found by a partial aggregate."""
    parts = targets.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shard - 1))))
    scored = queries.withColumn("_shard", F.pmod(F.xxhash64(query_key), F.lit(shard)).cast("int")).join(parts, "_shard").withColumn("_s", similarity)
    best = F.max_by(F.struct(target_key, F.col("_s").alias("similarity")), F.struct("_s", (-F.col(target_key)).alias("k"))).alias("_best")
    return scored.groupBy(query_key).agg(best).select(query_key, f"_best.{target_key}", "_best.similarity")


def one_per_key(rows: DataFrame, keys: Sequence[str], ordinal: str, last: bool = False) -> DataFrame:
    """The first or last row of each key by an aggregate, which combines on the map side; a null ordinal comes first."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    at = F.struct(F.col(ordinal).isNotNull().alias("known"), F.col(ordinal).alias("at"))
    best = (F.max_by if last else F.min_by)(row, at).alias("_row")
    return rows.groupBy(*keys).agg(best).select("_row.*")


def last_per_key(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Last write wins."""
    return one_per_key(rows, keys, ordinal, last=True)


def intersect_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """Rows of two runs with the same key, the last of each, as value_a and value_b."""
    left = last_per_key(a, keys, ordinal).select(*keys, F.col(value).alias(f"{value}_a"))
    right = last_per_key(b, keys, ordinal).select(*keys, F.col(value).alias(f"{value}_b"))
    return left.join(right, list(keys))


def pair_runs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer pairing with ``intersection``, true where both runs are there."""
    left, right = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    joined = left.join(right, list(keys), "full_outer")
    return joined.withColumn("intersection", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b")


def zip_pairs(left: str, right: str) -> Column:
    """Positional pairs of two arrays, as many as the shorter has."""
    n = F.least(F.size(left), F.size(right))
    return F.arrays_zip(F.slice(left, F.lit(1), n).alias(left), F.slice(right, F.lit(1), n).alias(right))


def exact_then_prefix(markers: DataFrame, references: DataFrame, marker: str, reference: str, ordinal: str) -> DataFrame:
    """Each marker's reference: that with its id, else the first whose id begins with the marker.

    An id is cut to each length that markers have, of which there are few, and joined on the whole cut, so ids with one
    common beginning are spread by what follows it.  Cuts are the same for many ids; the first of each goes on alone."""
    lengths = markers.select(F.length(marker).alias("_n")).where("_n IS NOT NULL").distinct()
    lengths = lengths.agg(F.sort_array(F.collect_list("_n")).alias("_lengths"))  # one row: the different lengths of ids
    at = F.struct(F.col(ordinal).alias("at"), F.col(reference).alias("id"))
    cut = references.crossJoin(F.broadcast(lengths)).where(F.col(reference).isNotNull())
    cut = cut.select(reference, ordinal, F.explode(F.filter("_lengths", lambda n: n <= F.length(reference))).alias("_n"))
    cut = cut.groupBy(F.substring(reference, F.lit(1), F.col("_n")).alias("_cut")).agg(F.min(at).alias("_first"), F.min(F.when(F.length(reference) == F.col("_n"), at)).alias("_same"))
    found = cut.select(F.col("_cut").alias(marker), F.coalesce("_same.id", "_first.id").alias(reference))
    return markers.join(found, marker, "left")


def new_rows(candidates: DataFrame, existing: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Candidates whose key isn't there yet; of repeated ones the first."""
    fresh = candidates.join(existing.select(key).distinct(), key, "left_anti")
    return one_per_key(fresh, [key], ordinal)


def backfill(rows: DataFrame, fetched: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fills empty ``columns`` from what was fetched once per key; what is there stays."""
    got = fetched.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in columns}
    return rows.join(got, key, "left").withColumns(filled).drop(*[f"_{c}" for c in columns])
