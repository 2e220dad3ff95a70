"""Accuracy of answers, distributions, judges' scores, agreement of raters and rollups over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import temporal_aspects
from ..functions.text import word_count


def overall(rows: DataFrame, correct: str) -> DataFrame:
    hit = F.col(correct).cast("int")
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(hit), F.lit(0)).alias("correct"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def structured_use(rows: DataFrame, used: str) -> DataFrame:
    """(total, used, rate): answers for which structured data was used; a missing mark counts as not used, no answers give 0."""
    hit = F.coalesce(F.col(used), F.lit(False)).cast("int")
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(hit), F.lit(0)).alias("used"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("rate"))


def by(rows: DataFrame, key: Column, correct: str, name: str) -> DataFrame:
    """Accuracy and count by a key; a missing key is 'unknown'."""
    return rows.groupBy(F.coalesce(key, F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def answer_distribution(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """(side, answer, n) for both sides; a missing answer is 'N/A'."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.coalesce(F.col(c), F.lit("N/A")).alias("answer")) for s, c in (("predicted", predicted), ("true", truth))]))
    return rows.select(sides.alias("x")).groupBy("x.side", "x.answer").agg(F.count("*").alias("n"))


def response_stats(rows: DataFrame, response: str, confidence: str) -> DataFrame:
    n = word_count(F.col(response))
    return rows.agg(F.avg(n).alias("mean_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.avg(confidence).alias("mean_confidence"), F.count(confidence).alias("n_confidence"))


def by_aspect(rows: DataFrame, question: str, kind: str, correct: str) -> DataFrame:
    """A row counts for every temporal aspect that it names."""
    named = rows.withColumn("aspect", F.explode(temporal_aspects(F.col(question), F.col(kind))))
    return named.groupBy("aspect").agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def score_distribution(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    """(score_name, score, percent) for 2, 1 and 0, to two places; no rows count as one."""
    total = F.greatest(F.count("*"), F.lit(1))
    shares = [F.struct(F.lit(c).alias("score_name"), F.lit(v).alias("score"), F.bround(100 * F.count_if(F.col(c) == v) / total, 2).alias("percent")) for c in scores for v in (2, 1, 0)]
    return rows.agg(F.array(*shares).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def structural_statistics(rows: DataFrame, topic: str, event: str, articles: Column, questions: Column, kind_a: Column) -> DataFrame:
    """Topics, events, articles, questions, questions per topic and event, and the ratio of a question type."""
    per = lambda a, b: F.bround(F.try_divide(a, b), 2)
    t, e, q = F.countDistinct(topic), F.countDistinct(event), F.sum(questions)
    return rows.agg(t.alias("n_topics"), e.alias("n_events"), F.sum(articles).alias("n_articles"), q.alias("n_questions"), per(q, t).alias("per_topic"), per(q, e).alias("per_event"), F.bround(F.try_divide(F.sum(kind_a), q), 3).alias("type_ratio"))


def agreement(rows: DataFrame, human: Sequence[str], model: Sequence[str]) -> DataFrame:
    """full, partial and none: rows whose raters agree in all, some or no scores; and the share for each score."""
    same = [F.col(h).eqNullSafe(F.col(m)).cast("int") for h, m in zip(human, model)]
    n = sum(same)
    each = [F.avg(s).alias(f"agree_{h}") for s, h in zip(same, human)]
    return rows.agg(F.count("*").alias("n"), F.count_if(n == len(same)).alias("full"), F.count_if((n > 0) & (n < len(same))).alias("partial"), F.count_if(n == 0).alias("none"), *each)


def export_rollup(rows: DataFrame, dimensions: Sequence[str], metric: str) -> DataFrame:
    """An extension: mean and count over every prefix of the dimensions."""
    return rows.rollup(*dimensions).agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def run_summary(rows: DataFrame, error: str) -> DataFrame:
    """successful, failed and success rate of windows."""
    ok = F.col(error).isNull()
    return rows.agg(F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg(ok.cast("int")), F.lit(0.0)).alias("success_rate"))
