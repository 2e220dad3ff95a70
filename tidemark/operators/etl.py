"""Building a corpus: removal reasons, modal dates, grouping, keep-one and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, collapse, keyword_pattern, truthy, words
from ..sources.written import Scratch


def removal_reason(date: Column, texts: Column, urls: Column, cutoff: Column, script: str) -> Column:
    """The first rule that removes an event: no valid date, before the cutoff, nothing in it, or a text in the script."""
    return (
        F.when(date.isNull(), "empty")
        .when(date < cutoff, "date")
        .when(~truthy(texts, "array") | ~truthy(urls, "array"), "empty")
        .when(F.exists(texts, lambda t: F.regexp_like(t, F.lit(script))), "script")
    )


def modal_value(rows: DataFrame, keys: Sequence[str], value: str, *order: str) -> DataFrame:
    """Each group's most frequent value, that seen first in ``order`` on a tie."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = F.max_by(value, F.struct("_n", *[(-F.col(f"_first.{o}").cast("double")).alias(o) for o in order])).alias(value)
    return counted.groupBy(*keys).agg(best, F.max("_n").alias("votes"))


def at_modal_date(articles: DataFrame, keys: Sequence[str], date: str, *order: str) -> DataFrame:
    """Articles dated at their event's modal date; of events without any date, the undated articles."""
    modal = modal_value(articles, keys, date, *order).select(*keys, F.col(date).alias("_modal"))
    return articles.join(modal, list(keys), "left").where(F.col(date).eqNullSafe(F.col("_modal"))).drop("_modal")


def keep_one(rows: DataFrame, keys: Sequence[str], prefer: Column, *order: str) -> DataFrame:
    """One row per key: a preferred one if there is any, else the first. An aggregate, so copies combine before they are shuffled."""
    rank = F.when(prefer, 0).when(~prefer, 1).otherwise(2)
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(row, F.struct(rank.alias("rank"), *order)).alias("_row")).select("_row.*")


def group_references(refs: DataFrame, summary: str, title: str, url: str, date: str, number: str) -> DataFrame:
    """References by normalised summary: the first title and summary, and articles by URL, dated ones preferred, by number."""
    keyed = refs.withColumn("_key", F.lower(collapse(F.col(summary))))
    one = keep_one(keyed, ["_key", url], F.col(date).isNotNull(), number)
    heads = keyed.groupBy("_key").agg(F.min_by(title, number).alias(title), F.min_by(summary, number).alias(summary))
    nested = one.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(number, url, date))).alias("articles"))
    return heads.join(nested, "_key").drop("_key")


def topic_bounds(events: DataFrame, topic: str, date: str) -> DataFrame:
    return events.groupBy(topic).agg(F.min(date).alias("start_date"), F.max(date).alias("last_date"), F.count("*").alias("n_events"))


def widened_bounds(topics: DataFrame, added: DataFrame, topic: str, date: str) -> DataFrame:
    """Bounds only widen, and replace those that are missing."""
    new = added.groupBy(topic).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    joined = topics.join(new, topic, "left")
    return joined.withColumns({"start_date": F.least("start_date", "_lo"), "last_date": F.greatest("last_date", "_hi")}).drop("_lo", "_hi")


def duplicate_counts(rows: DataFrame, key: Column) -> DataFrame:
    """duplicate_groups and duplicate_rows: keys that occur more than once, and the rows beyond the first."""
    groups = rows.groupBy(key.alias("_k")).count().where("count > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def top_keywords(rows: DataFrame, key: str, text: str, k: int, *order: str, least: int = 3) -> DataFrame:
    """Each group's k most frequent words, the first seen on a tie; a group without any has 'unknown'.

    Words are counted by hash, with the least of the first ``order`` column where each occurs. Where exactly it occurs is
    looked up only for words that may be among the first k, in the rows that hold them first."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(keyword_pattern(least)), F.lit(1))
    tokens = rows.select(key, F.col(order[0]).alias("_o"), F.explode(found).alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    counted = tokens.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("_o").alias("_o"), F.count_if(F.col("_o").isNull()).alias("_nulls"))
    ahead = counted.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("n")))).where(F.col("_r") <= k)
    # A null comes before all others, as in the order of rows.
    ahead = ahead.select(F.col(key).alias("_k"), "word", "n", F.when(F.col("_nulls") == 0, F.col("_o")).alias("_o"))
    ahead = Scratch(rows.sparkSession).write(ahead, "ahead")
    held = rows.join(ahead, F.col(key).eqNullSafe(F.col("_k")) & F.col(order[0]).eqNullSafe(F.col("_o")))
    placed = held.select(key, *order, "word", "n", F.array_position(found, F.col("word")).alias("_at")).where("_at > 0")
    counted = placed.groupBy(key, "word", "n").agg(F.min(F.struct(*order, "_at")).alias("_first"))
    rank = Window.partitionBy(key).orderBy(F.desc("n"), "_first")
    top = counted.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(key, "rank", "word", "n")
    none = rows.select(key).distinct().join(top.select(key).distinct(), key, "left_anti")
    return top.unionByName(none.select(key, F.lit(1).alias("rank"), F.lit("unknown").alias("word"), F.lit(0).cast("long").alias("n")))


def corpus_statistics(events: DataFrame, topic: str, date: str, texts: Column) -> DataFrame:
    """One row: events, topics, mean texts per event, date range, mean, least and most events per topic."""
    per = events.groupBy(topic).agg(F.count("*").alias("n"), F.sum(texts).alias("t"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    return per.agg(
        F.sum("n").alias("n_events"), F.count("*").alias("n_topics"), (F.sum("t") / F.sum("n")).alias("mean_texts"),
        F.min("lo").alias("start_date"), F.max("hi").alias("last_date"), F.avg("n").alias("mean_per_topic"), F.min("n").alias("min_per_topic"), F.max("n").alias("max_per_topic"),
    )


def distinct_urls(rows: DataFrame, urls: str) -> DataFrame:
    return rows.select(F.explode(urls).alias("url")).agg(F.countDistinct("url").alias("n_urls"))


def scrape_counters(rows: DataFrame, text: str, error: str) -> DataFrame:
    """fetched, failed and skipped rows."""
    return rows.agg(
        F.count_if(truthy(F.col(text)) & F.col(error).isNull()).alias("fetched"), F.count_if(F.col(error).isNotNull()).alias("failed"),
        F.count_if(F.col(error).isNull() & ~F.coalesce(truthy(F.col(text)), F.lit(False))).alias("skipped"),
    )


def n_words(c: Column) -> Column:
    return F.size(words(c))


def enrichment_counters(events: DataFrame, added: str, fallback: str) -> DataFrame:
    """Events, new articles, mean per event and how many events used the fallback."""
    return events.agg(F.count("*").alias("n_events"), F.sum(added).alias("n_articles"), F.avg(added).alias("mean_articles"), F.count_if(F.col(fallback)).alias("n_fallback"))


def most_reduced(events: DataFrame, key: str, before: str, after: str, k: int = 5) -> DataFrame:
    """The k events that lost most, ties by key."""
    lost = F.col(before) - F.col(after)
    return events.select(key, before, after, lost.alias("removed")).where("removed > 0").orderBy(F.desc("removed"), key).limit(k)


def reduction(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Totals before and after a filter and the percentage that stayed."""
    b, a = F.sum(before), F.sum(after)
    return rows.agg(b.alias("total_before"), a.alias("total_after"), F.bround(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 2).alias("percent_kept"))


def completion(rows: DataFrame, file: str, event: str, done: Column) -> DataFrame:
    """Rows, distinct files and (file, event) pairs, and the percentage that is annotated."""
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(file).alias("n_files"), F.countDistinct(file, event).alias("n_events"), F.bround(100 * F.avg(done.cast("int")), 2).alias("percent_done"))
