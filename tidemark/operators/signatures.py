"""Exact search of similar token sets by signatures of parts, each made within its row; no token is shuffled or counted.

Two sets of n and m tokens whose Jaccard similarity is t or more differ in at most (1 - t) / (1 + t) * (n + m) tokens.  If
tokens are dealt by their hashes to one part more than that, the sets are equal in a part at least, so a set posts the hash
of each part.  A part holds several tokens (about eight at 0.9), hence only near copies meet, however frequent tokens are
and however many rows there are, while a list of a single token grows with the table.

How many parts there are depends on sizes: these are cut into spans so that of two similar sets the smaller one is in the
span of the larger or the span below.  A set posts its parts as dealt for its own span (``own``) and for the next; two sets
meet by lists that are the own ones of the larger.  Parts without a token are posted, too, since sets may be equal there alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.text import jaccard
from ..sources.written import Scratch

#: Guards a product with the threshold against rounding.
EPS = 1e-9
#: Sets that are dealt at once, as they may be large.
ROWS = 100


def spans(threshold: float, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """The least sizes of the spans up to that behind the one of ``largest``, and the number of parts in each."""
    low, least = threshold - EPS, [1]
    while len(least) < 3 or least[-3] <= largest:
        least.append(int(least[-1] / low) + 1)
    most = np.array(least[1:]) - 1
    return np.array(least[:-1]), np.floor((1 - low) / (1 + low) * 2 * most + EPS).astype(np.int64) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def dealt(hashes: np.ndarray, sizes: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every part of sets whose token hashes follow one another, for their own spans or the next."""
    least, parts = spans(threshold, int(sizes.max()))
    span = np.searchsorted(least, sizes, side="right") - 1 + (not own)
    many = parts[span]
    first, row = np.cumsum(many) - many, np.repeat(np.arange(len(sizes)), many)
    of = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros(len(row), np.uint64)  # of hashes, in any order
    np.add.at(sums, first[of] + (_mixed(hashes) % many[of].astype(np.uint64)).astype(np.int64), hashes)
    place = (np.arange(len(row)) - first[row]).astype(np.uint64) << np.uint64(32) | span[row].astype(np.uint64)
    return row, _mixed(sums ^ _mixed(place + np.uint64(1))).view(np.int64)


def signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """(e, at, n, w, own) for the parts of every row of ``sets`` (e, at, s: not empty, distinct tokens)."""
    hashed = sets.select("e", "at", F.size("s").alias("n"), F.transform("s", lambda t: F.xxhash64(t)).alias("h"))
    schema = StructType([*hashed.schema.fields[:3], StructField("w", LongType()), StructField("own", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrived in batches:
            for at in range(0, arrived.num_rows, ROWS):
                batch = arrived.slice(at, ROWS)
                sizes, hashes = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().view(np.uint64)
                for own in (True, False):
                    row, w = dealt(hashes, sizes, threshold, own)
                    columns = [batch.column(i).take(pa.array(row)) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(w), pa.array(np.full(len(w), own))], [f.name for f in schema])

    return hashed.mapInArrow(run, schema)


def postings(scratch: Scratch, sets: DataFrame, threshold: float) -> DataFrame:
    """The signatures that several sets have and by which a pair can meet."""
    every = scratch.write(signatures(sets, threshold), "signatures")
    several = every.groupBy("e", "w").agg(F.count("*").alias("f"), F.max("own").alias("o")).where("f > 1 AND o")
    # These are few, so the signatures need not be sorted.
    lists = scratch.write(every.join(several.select("e", "w").hint("shuffle_hash"), ["e", "w"], "left_semi"), "postings")
    scratch.drop(every)
    return lists


def sizes_fit(n: Column, m: Column, threshold: float) -> Column:
    return F.least(n, m) >= threshold * F.greatest(n, m) - EPS


def met(first: DataFrame, later: DataFrame, threshold: float) -> DataFrame:
    """(e, a, b): the different members of one list, a before b, whose sizes let them reach the threshold."""
    one = first.select("e", "w", F.col("at").alias("a"), "n", "own")
    two = later.select("e", "w", F.col("at").alias("b"), F.col("n").alias("m"), F.col("own").alias("owned"))
    pairs = one.join(two, ["e", "w"]).where((F.col("a") < F.col("b")) & (F.col("own") | F.col("owned")) & sizes_fit(F.col("n"), F.col("m"), threshold))
    return pairs.select("e", "a", "b").distinct()


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(e, a, b, n, m, similarity) of the pairs whose whole sets reach the threshold."""
    both = pairs.join(sets.select("e", F.col("at").alias("a"), "s"), ["e", "a"]).join(sets.select("e", F.col("at").alias("b"), F.col("s").alias("u")), ["e", "b"])
    return both.select("e", "a", "b", F.size("s").alias("n"), F.size("u").alias("m"), jaccard(F.col("s"), F.col("u")).alias("similarity")).where(F.col("similarity") >= threshold)
