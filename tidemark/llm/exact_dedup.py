"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text loses its ASCII white space and is cut where its content says so: after at least ``MIN_CHUNK`` characters, at the
next sentence mark behind certain letters, at ``MAX_CHUNK`` at the latest.  Every chunk is moved once, to find the
distinct chunks and to verify that no two of them share an identifier; if two do, identifiers get wider and the check is
repeated.  A document then is its recipe, the ordered list of its chunks' identifiers, and only recipes are compared,
grouped and joined.

Defined cases: a null text counts as empty, and all empty texts are equal; of rows with the same id and equal text the
one read first stays, the others are dropped; a null id loses every tie; an empty table gives an empty result; columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import narrowed, table

MIN_CHUNK, MAX_CHUNK = 128, 4096
WHITE = r"[\x20\x09-\x0D]+"
#: A cut comes after a mark behind some of the letters and digits; as not every mark is one, cuts meet again after a change.
CUT = r"[a-h0-3à-ïァ-ノ一-廿][.!?;:|。！？]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(norm: Column) -> Column:
    """The chunks of a text in order; joined they are the text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={CUT})|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, width: int) -> list[Column]:
    """The parts of a chunk's identifier: ``width`` independent 64-bit hashes; width 0 is a weak hash for tests."""
    if width == 0:
        return [F.pmod(F.xxhash64(chunk), F.lit(3)).cast("long")]
    return [F.xxhash64(F.lit(seed), chunk) for seed in range(width)]


def verified_width(docs: DataFrame, width: int) -> int:
    """The least width from ``width`` on at which distinct chunks have distinct identifiers. ``docs`` has ``norm``."""
    distinct = docs.select(F.explode(chunks(F.col("norm"))).alias("chunk")).distinct()
    while True:
        parts = identifier(F.col("chunk"), width)
        named = distinct.select(*[p.alias(f"id{i}") for i, p in enumerate(parts)])
        if named.groupBy(*named.columns).count().where("count > 1").isEmpty():
            return width
        width += 1


def recipes(docs: DataFrame, width: int) -> Column:
    return F.flatten(F.transform(chunks(F.col("norm")), lambda c: F.array(*identifier(c, width))))


def exact_dedup(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, key_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks; and ``key_col``, if it is given.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest id.
    """
    key = [key_col] if key_col else []
    docs = narrowed(df, doc_id=(id_col, None), text=(text_col, "string"), **{k: (k, None) for k in key})
    docs = docs.select(*key, "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("norm"))
    width = verified_width(docs, width)
    rows = table(
        spark,
        docs.select(F.monotonically_increasing_id().alias("row"), *key, "doc_id", "points", F.sha2("norm", 256).alias("text_sha256"), recipes(docs, width).alias("recipe")),
        "recipes",
    )
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
    # Written before the join, so that both sides are plain exchanges and a hot recipe's rows can be split among tasks.
    groups = table(spark, rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1"), "copies")
    groups = groups.select("recipe", "group_size", F.bitwise_not("best.id").alias("best_id"), F.bitwise_not("best.row").alias("best_row"))
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("best_row").isNull() | (F.col("best_row") == F.col("row"))).alias("kept"),
        "text_sha256",
        (F.size("recipe") / F.lit(max(width, 1))).cast("long").alias("n_chunks"),
        *key,
    )
