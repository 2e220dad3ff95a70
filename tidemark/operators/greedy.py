"""Order-exact greedy removal of near copies in large events, as rounds over posting lists instead of a fold over a row.

A text stays if no text of its event that stays and comes before it reaches the threshold: the lexicographically first
independent set of the similarity graph.  Equal token sets are one node, their first text.  Two similar sets are in one
posting list at least, that of a part in which they are equal (``signatures``), so only members of one list are compared.

A round looks at the first ``ahead`` open members of each list.  A text that is among them in all its lists has all its
earlier open partners there; such texts are decided by their verified edges, from the earliest on: what has no earlier
open neighbour stays, its neighbours go.  What stays is then compared with the open members of its lists behind the first
ones, and its neighbours go too.  So a thousand near copies of one text cost a thousand comparisons and not half a million,
and a list is never sorted beyond its first members.  The earliest open text of an event is always decided, hence rounds end.

Defined cases: a text without tokens is like no other and stays; null texts count as such; an event or position may be
null, nulls are one event; positions are distinct within an event; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..sources.written import Scratch
from .signatures import compared, met, postings

#: Open members of a posting list that a round looks at.
AHEAD = 128


def _edges(scratch: Scratch, first: DataFrame, later: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(e, a, b): members of one list, a before b, whose sets reach the threshold."""
    # Few pairs are known as such once they are written, and sets then stay where they are.
    pairs = scratch.write(met(first, later, threshold), "pairs")
    return compared(pairs, sets, threshold).select("e", "a", "b")


def _decided(scratch: Scratch, able: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stays, goes) of the texts ``able`` (e, at) by the edges to all their earlier open partners; some may stay open."""
    undecided, stays, goes = able, [], []
    while True:
        free = scratch.write(undecided.join(edges.select("e", F.col("b").alias("at")), ["e", "at"], "left_anti"), "free")
        if free.isEmpty():
            break
        stays.append(free)
        hit = scratch.write(edges.join(free.withColumnRenamed("at", "a"), ["e", "a"]).select("e", F.col("b").alias("at")).distinct(), "hit")
        goes.append(hit)
        if hit.isEmpty():
            break  # only what goes sets others free
        settled = free.union(hit)
        undecided = scratch.write(undecided.join(settled, ["e", "at"], "left_anti"), "undecided")
        # An edge from a text that went no longer counts, one to a text that is settled neither.
        left = edges.join(settled.withColumnRenamed("at", "a"), ["e", "a"], "left_anti").join(settled.withColumnRenamed("at", "b"), ["e", "b"], "left_anti")
        edges = scratch.write(left, "edges")
    none = able.limit(0)
    for more in stays[1:]:
        stays[0] = stays[0].union(more)
    for more in goes[1:]:
        goes[0] = goes[0].union(more)
    return (stays or [none])[0], (goes or [none])[0].distinct()


def greedy_rows(spark: SparkSession, rows: DataFrame, event: str, at: str, text: str, threshold: float = 0.9, ahead: int = AHEAD) -> DataFrame:
    """(event, at, kept) for every row: the same decisions as the fold of ``similarity.greedy_dedup``."""
    scratch = Scratch(spark)
    named = rows.select(F.to_json(F.struct(event)).alias("e"), F.col(event).alias("event"), F.col(at).alias("at"), F.sort_array(token_set(F.coalesce(text, F.lit("")))).alias("s"))
    whole = scratch.write(named, "sets")
    # Equal sets combine on the map side, so copies never travel.
    sets = scratch.write(whole.where(F.size("s") > 0).groupBy("e", "s").agg(F.min("at").alias("at")), "distinct")
    lists = postings(scratch, sets, threshold)
    posted = scratch.write(lists.select("e", "at").distinct(), "posted")
    alone = sets.select("e", "at").join(posted, ["e", "at"], "left_anti")
    sets = scratch.write(sets.join(posted, ["e", "at"], "left_semi"), "met")  # the others are in no pair
    kept, live = [scratch.write(alone, "alone")], lists
    while not live.isEmpty():
        place = F.row_number().over(Window.partitionBy("e", "w").orderBy("at"))
        # The limit is applied within tasks before rows are shuffled by list.
        near = scratch.write(live.withColumn("k", place).where(F.col("k") <= ahead).drop("k"), "near")
        edges = scratch.write(_edges(scratch, near, near, sets, threshold), "edges")
        able = live.groupBy("e", "at").agg(F.count("*").alias("lists")).join(near.groupBy("e", "at").agg(F.count("*").alias("lists")), ["e", "at", "lists"]).select("e", "at")
        stays, goes = _decided(scratch, scratch.write(able, "able"), edges)
        stays = scratch.write(stays, "stays")
        kept.append(stays)
        rest = scratch.write(live.join(stays.union(goes), ["e", "at"], "left_anti"), "rest")
        reached = _edges(scratch, live.join(stays, ["e", "at"]), rest, sets, threshold).select("e", F.col("b").alias("at")).distinct()
        before, live = live, scratch.write(rest.join(reached, ["e", "at"], "left_anti"), "live")
        if before is not lists:
            scratch.drop(before)
        scratch.drop(near, edges, rest)
    found = kept[0]
    for more in kept[1:]:
        found = found.union(more)
    marked = whole.join(found.withColumn("first", F.lit(True)), ["e", "at"], "left")
    return marked.select(F.col("event").alias(event), F.col("at").alias(at), (F.col("first").isNotNull() | (F.size("s") == 0)).alias("kept"))
