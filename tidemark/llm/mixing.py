"""Mixing sources to target weights by nested hash-threshold histograms, in DataFrame functions only.

Sources in code-point order, null last, have the weights 3, 1, 2, repeating.  They share ``share`` of all words by
weight, a source at most ``most`` times its own; what a source can't take is shared again by weight until none is above.
A document has a fixed 60-bit hash.  A source takes whole rounds of all its documents and, for the rest of its target,
the documents below a hash threshold.  The threshold is found without a sort: words are summed by source and hash
bucket, the bucket in which the target falls is the only one that is split further, and so on through the hash.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, the last; rows with the same
id have the same hash and are taken or left together; sources without words have target 0; an empty table gives an
empty result; columns other than id, text and source are not read, whatever their names.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import narrowed, numbered_columns, place, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Bits of the hash that each level of histograms splits by; a level after the first sees the boundary buckets only.
BITS = (12, 12, 12, 12, 12)
WIDTH = sum(BITS)
FIRST = WIDTH - BITS[0]


def hashed(key: Column, salt: str) -> Column:
    """A document's fixed hash, WIDTH bits of an md5."""
    name = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, WIDTH // 4), 16, 10).cast("long")


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, salt: str) -> DataFrame:
    """doc_id, source, no_source, size and the hash h, a number of WIDTH bits."""
    docs = narrowed(df, doc_id=(id_col, None), text=(text_col, "string"), source=(source_col, "string"))
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hashed(F.col("doc_id"), salt).alias("h"),
    )


def prefixed(spark: SparkSession, rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums`` its sum over the rows before, in an order, without one task for all rows."""
    ranged = table(spark, rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(*[F.sum(c).alias(f"{k}_part") for k, c in sums.items()])
    before = before.select("part", *[F.coalesce(F.sum(f"{k}_part").over(by_part), F.lit(0)).alias(f"{k}_before") for k in sums])
    out = ranged.join(before, "part")
    return out.select(*rows.columns, *[(F.col(f"{k}_before") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(k) for k, c in sums.items()])


def targets(spark: SparkSession, sized: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """A row for each source: source, no_source, source_size, target.

    In the order of size for a weight of 1, the sources that get ``most`` times their size come first.  The first that
    doesn't sets the level: what those before it leave of the budget, for a weight of 1 of all the others.  Whole numbers, so exact."""
    per = prefixed(spark, sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")), ["no_source", "source"], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    whole = "decimal(38,0)"
    per = per.withColumn("weight", weight).withColumn("ratio", F.col("source_size").cast(whole) * (F.lit(lcm(*WEIGHTS)) / F.col("weight")).cast("int"))
    per = table(spark, prefixed(spark, per, ["ratio", "no_source", "source"], {"words": F.col("source_size"), "weights": F.col("weight")}), "weights")
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    top, bottom = share
    num = F.lit(top * (total or 0)).cast(whole) - F.lit(bottom * most).cast(whole) * F.col("words")
    den = F.lit(bottom).cast(whole) * (F.lit(weights or 0) - F.col("weights"))
    level = per.withColumns({"num": num, "den": den}).where(F.lit(most).cast(whole) * F.col("source_size") * F.col("den") > F.col("num") * F.col("weight"))
    level = level.agg(F.min(F.struct("ratio", "no_source", "source", "num", "den")).alias("level")).first()[0]
    most_words = (most * F.col("source_size")).cast("double")
    if level is None:
        return per.select("no_source", "source", "source_size", most_words.alias("target"))
    full = F.struct("ratio", "no_source", "source") < F.struct(F.lit(level.ratio).cast(per.schema["ratio"].dataType).alias("ratio"), F.lit(level.no_source).alias("no_source"), F.lit(level.source).alias("source"))
    share_of = (F.lit(level.num).cast(whole) * F.col("weight")).cast("double") / F.lit(float(level.den))
    return per.select("no_source", "source", "source_size", F.when(full, most_words).otherwise(share_of).alias("target"))


def thresholds(spark: SparkSession, sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(no_source, source, bucket of the first level) -> rounds, source_size, target, limit: documents with h < limit count once more."""
    keys = ["no_source", "source"]
    goals = goals.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("need", F.col("target") - F.col("rounds") * F.col("source_size"))
    rows, first, found = sized, None, []
    before = F.lit(0).cast("long")
    for level in range(len(BITS)):
        shift = WIDTH - sum(BITS[: level + 1])
        rows = rows.withColumn("bucket", F.shiftright("h", shift))
        sums = rows.groupBy(*keys, "bucket").agg(F.sum("size").alias("words"), *([] if level == 0 else [F.first("before").alias("before"), F.first("need").alias("need")]))
        if level == 0:
            sums = sums.join(goals, keys).withColumn("before", before)
        over = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most the boundary bucket's rows, 2 ** BITS[0] in the first level
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(over))
        sums = sums.withColumn("lower", F.col("upto") - F.col("words"))
        # In the last level a bucket is one hash: it counts if that brings the sum nearer to what is needed.
        last = level == len(BITS) - 1
        sums = table(spark, sums, f"level{level}")
        if level == 0:
            first = sums
        edge = sums.where((F.col("lower") <= F.col("need")) & (F.col("need") < F.col("upto")))
        if last:
            limit = F.when(F.col("lower") + F.col("words") / 2 < F.col("need"), F.col("bucket") + 1).otherwise(F.col("bucket"))
            found = edge.select(*keys, limit.alias("limit"))
        else:
            edge = edge.select(*keys, "bucket", F.col("lower").alias("before"), "need")
            rows = rows.drop("before", "need").join(edge, [*keys, "bucket"])
    # Buckets of the first level below the edge are taken whole, those above not at all; on the edge the limit decides.
    low = F.shiftleft("bucket", FIRST)
    found = found.withColumn("bucket", F.shiftright("limit", FIRST))
    edge_key = first.where((F.col("lower") <= F.col("need")) & (F.col("need") < F.col("upto"))).select(*keys, F.col("bucket").alias("edge"))
    found = edge_key.join(found.drop("bucket"), keys).select(*keys, F.col("edge").alias("bucket"), "limit")
    high = low + F.lit(1 << (FIRST))
    return first.join(found, [*keys, "bucket"], "left").select(
        *keys, "bucket", "rounds", "source_size", "target",
        F.coalesce("limit", F.when(F.col("upto") <= F.col("need"), high).otherwise(low)).alias("limit"),
    )


def mix(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt: str = "mix:") -> DataFrame:
    """One row per row of ``df``: doc_id, size, source_size, target, taken, copies (how often the mix takes the document)."""
    sized = table(spark, sizes(df, id_col, text_col, source_col, salt), "sizes")
    cuts = table(spark, thresholds(spark, sized, targets(spark, sized)), "cuts")
    keyed = sized.withColumn("bucket", F.shiftright("h", FIRST))
    copies = F.col("rounds") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    # The join is on source and bucket, so a source with a third of all rows is spread over 2 ** BITS[0] keys.
    joined = keyed.join(cuts, ["no_source", "source", "bucket"]).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_rows(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt: str = "mix:") -> DataFrame:
    """The mix itself: every row of ``df``, with all its columns, as often as the mix takes it."""
    sized = table(spark, sizes(df, id_col, text_col, source_col, salt), "sizes")
    cuts = table(spark, thresholds(spark, sized, targets(spark, sized)).select("no_source", "source", "bucket", "rounds", "limit"), "cuts")
    # Columns of df are numbered meanwhile, so that their names can't clash with those of the mix.
    own, h = F.col(f"_{place(df, source_col)}").cast("string"), hashed(F.col(f"_{place(df, id_col)}"), salt)
    keyed = numbered_columns(df).withColumns({"h": h, "no_source": own.isNull(), "source": F.coalesce(own, F.lit("")), "bucket": F.shiftright(h, FIRST)})
    copies = F.col("rounds") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    joined = keyed.join(cuts, ["no_source", "source", "bucket"]).withColumn("copies", copies.cast("int"))
    text = F.coalesce(F.col(f"_{place(df, text_col)}").cast("string"), F.lit(""))
    joined = joined.where((F.col("copies") > 0) & F.regexp_like(text, F.lit(WORD)))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[f"_{i}" for i in range(len(df.columns))]).toDF(*df.columns)
