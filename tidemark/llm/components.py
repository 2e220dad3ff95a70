"""Connected components of an edge table by alternating large-star and small-star steps, written out after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table


#: Up to so many edges a round is one job; beyond, each step is written, so that a hub's rows can be split among tasks.
ONE_JOB = 5_000


def _star(spark: SparkSession, edges: DataFrame, large: bool, cut: bool) -> DataFrame:
    """Points what is above (large) or below a node at the least node around it."""
    around = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # A written table makes both sides of the join plain exchanges, which can be split where they are skewed.
    joined = around.join(table(spark, least, "least") if cut else least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge: label is the least node that can be reached. ``edges``: long columns a, b."""
    edges = table(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, cut = now, now[0] > ONE_JOB
        step = _star(spark, edges, True, cut)
        edges = table(spark, _star(spark, table(spark, step, "large") if cut else step, False, cut), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
