"""Sampling by seeded hashes: repeatable, whatever the partitioning, and the same in SQL through md5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *keys: Column | str) -> Column:
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def per_group(rows: DataFrame, groups: Sequence[str], keys: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """k rows of each group; groups of k rows or fewer stay whole."""
    order = Window.partitionBy(*groups).orderBy(order_key(seed, *keys), *keys)
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def balanced(rows: DataFrame, group: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """As many rows of every group as the smallest has."""
    least = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return per_group(rows, [group], keys, least, seed)  # a number, so that groups are cut before they are moved


def exact_share(rows: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """The share of all rows, rounded down, one at least: those with the least hashes.

    Rows are counted by the first four digits of their hashes; whole buckets are taken, and within a bucket the least
    hashes as far as there is room, so that neither all rows nor all that are taken meet in one task."""
    n = rows.count()
    wanted = max(1, int(n * share)) if n else 0
    keyed = rows.withColumn("_h", order_key(seed, *keys)).withColumn("_b", F.substring("_h", 1, 4))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 65,536 rows at most
    sums = keyed.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    room = sums.where(F.col("_before") < wanted).select("_b", (F.lit(wanted) - F.col("_before")).alias("_room"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys))
    return keyed.join(room, "_b").withColumn("_rn", rank).where("_rn <= _room").drop("_h", "_b", "_room", "_rn")


def in_order(texts: Column, k: int, seed: int, key: Column) -> Column:
    """k of an array's texts without replacement; all of them, in their order, if there are no more than k."""
    hashed = F.transform(texts, lambda t, i: F.struct(order_key(seed, key, i).alias("h"), t.alias("t")))
    return F.when(F.size(texts) <= k, texts).otherwise(F.transform(F.slice(F.sort_array(hashed), 1, k), lambda s: s["t"]))


def one_of(rows: DataFrame, groups: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    return per_group(rows, groups, keys, 1, seed)


def shuffled_choices(choices: Column, answer: Column, seed: int, key: Column) -> Column:
    """struct(choices, answer): choices in hash order and the letter under which the answer then stands."""
    hashed = F.transform(choices, lambda c: F.struct(order_key(seed, key, c).alias("h"), c.alias("c")))
    ordered = F.transform(F.sort_array(hashed), lambda s: s["c"])
    letter = lambda o: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.array_position(o, answer).cast("int"), F.lit(1))
    return F.transform(F.array(ordered), lambda o: F.struct(o.alias("choices"), letter(o).alias("answer")))[0]  # so that the order is made once
