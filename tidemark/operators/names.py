"""Proper nouns by how a corpus writes its words, and names of two words by how firmly they stand together.

Where a sentence begins, every word has a capital.  So what a word is shows in its other places: a word is a name if it has
a capital in at least ``SHARE`` of them.  A word with a capital then counts as a name wherever it stands, at the beginning of a
sentence too, and a common word that is capitalised now and then never does.  Two names in a row are one name if Dunning's
log-likelihood ratio says that they meet more often than chance would have it.

All is counting: words come out of texts once, counts combine on the map side, and the table of names is joined to counts
of words, never to occurrences.

Defined cases: null texts have no words; words of one or two letters are no names; a word that only begins sentences is
none; stop words are none; groups may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, letter_words, sentences

#: Least share of capitals, least number of places that tell, least length, and the ratio from which two names are one (p < 0.001).
SHARE, PLACES, LETTERS, FIRM = 0.5, 2, 3, 10.83


def word_places(docs: DataFrame, group: str, text: str) -> DataFrame:
    """(group, at, word, following): the words of each sentence with their places and the words behind them."""
    of = docs.select(group, F.explode(sentences(F.col(text))).alias("s")).select(group, letter_words(F.col("s")).alias("w"))
    placed = of.select(group, F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit(None).cast("string"))).alias("following"))).alias("at", "p"))
    return placed.select(group, "at", "p.word", "p.following").where("word IS NOT NULL")


def place_counts(places: DataFrame) -> DataFrame:
    """(at, word, following, n): equal pairs of neighbours once; ``at`` is 1 for all places inside a sentence."""
    return places.groupBy(F.least("at", F.lit(1)).alias("at"), "word", "following").agg(F.count("*").alias("n"))


def _times(places: DataFrame) -> Column:
    """How often rows of ``word_places`` or of ``place_counts`` occur."""
    return F.col("n") if "n" in places.columns else F.lit(1).cast("long")


def capital(word: Column) -> Column:
    return F.regexp_like(word, F.lit(r"^\p{Lu}"))


def names(places: DataFrame, share: float = SHARE, least: int = PLACES) -> DataFrame:
    """(name, share): lower-case forms of the words that the corpus writes as names. ``places`` may be ``place_counts``."""
    inside = places.where("at > 0").groupBy("word").agg(F.sum(_times(places)).alias("n"))
    per = inside.groupBy(F.lower("word").alias("name")).agg(F.sum("n").alias("n"), F.sum(F.when(capital(F.col("word")), F.col("n")).otherwise(0)).alias("capitals"))
    per = per.where((F.col("n") >= least) & (F.length("name") >= LETTERS) & ~F.col("name").isin(*STOP_WORDS))
    return per.withColumn("share", F.col("capitals") / F.col("n")).where(F.col("share") >= share).select("name", "share")


def name_counts(places: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """(group, name, n): how often each name stands, with a capital, in the texts of a group."""
    counted = places.where(capital(F.col("word"))).groupBy(group, F.lower("word").alias("name")).agg(F.count("*").alias("n"))
    return counted.join(known.select("name"), "name").select(group, "name", "n")


def firm_pairs(places: DataFrame, known: DataFrame, firm: float = FIRM) -> DataFrame:
    """(first, second, n, ratio): names that stand together more often than by chance, of two words with capitals. ``places`` may be ``place_counts``."""
    rows = places.where("following IS NOT NULL").select(F.lower("word").alias("first"), F.lower("following").alias("second"), (capital(F.col("word")) & capital(F.col("following"))).alias("both"), _times(places).alias("n"))
    each = rows.groupBy("first", "second").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("both"), F.col("n")).otherwise(0)).alias("capitals"))
    left, right = each.groupBy("first").agg(F.sum("n").alias("nf")), each.groupBy("second").agg(F.sum("n").alias("ns"))
    total = each.agg(F.sum("n").cast("double").alias("total"))
    named = lambda c: known.select(F.col("name").alias(c))
    met = each.where("capitals > 0").join(named("first"), "first").join(named("second"), "second").join(left, "first").join(right, "second").crossJoin(F.broadcast(total))  # one row
    # Of all pairs of neighbours: with the first, with the second, with both, with neither.
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    a, b, c = F.col("n").cast("double"), (F.col("nf") - F.col("n")).cast("double"), (F.col("ns") - F.col("n")).cast("double")
    t, nf, ns = F.col("total"), F.col("nf").cast("double"), F.col("ns").cast("double")
    d = t - a - b - c
    cells, rows_, columns = xlogx(a) + xlogx(b) + xlogx(c) + xlogx(d), xlogx(nf) + xlogx(t - nf), xlogx(ns) + xlogx(t - ns)
    ratio = 2 * (cells - rows_ - columns + xlogx(t))
    return met.withColumn("ratio", ratio).where((F.col("ratio") >= firm) & (a * t > nf * ns)).select("first", "second", F.col("capitals").alias("n"), "ratio")


def top_names(counts: DataFrame, group: str, k: int) -> DataFrame:
    """(group, name, n, rank): each group's most frequent names."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
