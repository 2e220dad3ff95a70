"""The three tasks end to end over windows of dated events: clustering, summarization and temporal question answering.

A window or a model call that fails is a row with an error; nothing stops the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models, qa_generation
from ..functions.parsing import answer_letter, question_type, same_answer
from ..functions.text import greedy_budget, token_estimate
from ..operators import cluster_state, windows
from ..operators.joins import one_per_key
from ..sources.written import Scratch
from . import clustering_metrics as cm
from . import summary_metrics as sm


def clustering(docs: DataFrame, size: int, stride: int, key: str, text: str, truth: str, cap: int = 10, engine: str = "stub", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, metrics per window, macro averages). ``docs`` have event_date; a failed document is in cluster -1, with its error."""
    held = windows.window_events(docs.select(key, text, truth, "event_date"), size, stride)
    found = cluster_state.cluster_windows(held, "window_index", key, text, ["event_date", key], cap, engine, **options)
    # Written once, as all metrics read it, and every reading would ask the model again.
    assigned = Scratch(docs.sparkSession).write(held.select("window_index", key, truth).join(found, ["window_index", key]), "assigned")
    keys = ["window_index"]
    cells = cm.contingency(assigned, truth, "cluster", keys)
    per = cm.b_cubed(cells, keys).join(cm.mutual_information(cells, keys).select("window_index", "nmi"), keys)
    return assigned, per, cm.macro(per, "precision", "recall", "f1", "nmi")


def micro_clustering(assigned: DataFrame, truth: str) -> DataFrame:
    """Metrics over all windows at once. Numbers of different windows count as the same cluster, so this isn't comparable."""
    return cm.b_cubed(cm.contingency(assigned, truth, "cluster"))


def budgeted(rows: DataFrame, keys: list[str], order: list[str], text: Column, max_tokens: int, name: str, *aggs: Column) -> DataFrame:
    """(keys, ``name``, aggs): each group's texts in order as far as the budget goes.

    A running sum of tokens leaves only the texts within the budget, and the one that exceeds it, to be collected."""
    own = rows.withColumn("_text", text)
    before = F.sum(token_estimate(F.col("_text"))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_in", F.when(F.coalesce(before, F.lit(0)) <= max_tokens, F.struct(*order, "_text")))
    texts = F.transform(F.sort_array(F.collect_list("_in")), lambda s: s["_text"])
    return own.groupBy(*keys).agg(greedy_budget(texts, max_tokens).alias(name), *aggs)


def summarization(docs: DataFrame, size: int, stride: int, key: str, text: str, reference: str, topic: str, max_input: int = 4000, limit: int = 200, engine: str = "stub", **options) -> DataFrame:
    """One row per topic and window: the summary, the reference label, their lengths, error, and the evolution metrics.

    The reference label is the join of the window's references in order; texts go in by date until the budget is used."""
    held = windows.assign_date_windows(docs, size, stride)
    dated = F.concat(F.lit("[Date: "), F.date_format("event_date", "yyyy-MM-dd"), F.lit("]\n"), F.col(text))
    label = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_date", key, reference))), lambda s: s[reference]), " ")
    per = budgeted(held, [topic, "window_number", "window_start"], ["event_date", key], dated, max_input, "inputs", label.alias("reference"), F.count("*").alias("event_count"))
    made = per.withColumn("_m", models.generate(qa_generation.summary_prompt(F.col("inputs"), limit), engine, max_tokens=limit * 2, **options))
    rows = made.select(topic, "window_number", "window_start", "event_count", F.coalesce("_m.text", F.lit("")).alias("generated"), "reference", F.col("_m.error").alias("error"))
    rows = sm.previous(rows, topic, "window_number", "generated")
    return rows.withColumns({
        "generated_length": F.size(F.split("generated", r"(?U)\s+")), "reference_length": F.size(F.split("reference", r"(?U)\s+")), "relevance": sm.token_similarity(F.col("generated"), F.col("reference")),
        "novelty": sm.novelty(F.col("generated"), F.col("previous"), F.col("reference")),
    })


def temporal_qa(questions: DataFrame, articles: DataFrame, max_input: int = 4000, cap: int | None = None, engine: str = "stub", **options) -> DataFrame:
    """Answers to questions of windows from articles of the same window that aren't later.

    ``questions``: window_index, question_id, question_date, question, choices (map), answer, question_type;
    ``articles``: window_index, article_id, article_date, text.  All questions of a window, or at most ``cap``, by hash."""
    from ..operators.sampling import per_group

    asked = questions if cap is None else per_group(questions, ["window_index"], ["question_id"], cap)
    # A question's context is a prefix of its window's articles in order, so what is behind the budget helps no question.
    line = F.concat(F.lit("["), F.date_format("article_date", "yyyy-MM-dd"), F.lit("] "), F.col("text"))
    lines = articles.where("text is not null").select("window_index", "article_id", "article_date", line.alias("line"))
    # What is sorted in a window are sizes; the few lines within the budget are read again, so that no task takes a window's texts.
    order = Window.partitionBy("window_index").orderBy("article_date", "article_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.select("window_index", "article_id", "article_date", token_estimate(F.col("line")).alias("_n"))
    within = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") <= max_input)
    near = within.select(F.col("window_index").alias("_w"), F.col("article_id").alias("_a"), F.col("article_date").alias("_d"))
    same = F.col("window_index").eqNullSafe(F.col("_w")) & F.col("article_id").eqNullSafe(F.col("_a")) & F.col("article_date").eqNullSafe(F.col("_d"))
    lines = lines.join(near, same, "left_semi")
    # A window's lines within the budget are one row, which each of its questions reads as far as its date.
    held = lines.groupBy("window_index").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("article_date", "article_id", "line")))).alias("_lines"))
    seen = F.filter("_lines", lambda s: s["article_date"].isNull() | (s["article_date"] <= F.col("question_date")))
    context = F.coalesce(greedy_budget(F.transform(seen, lambda s: s["line"]), max_input), F.array().cast("array<string>"))
    joined = asked.join(held, "window_index", "left").withColumn("context", context).drop("_lines")
    prompt = qa_generation.answer_prompt(F.col("question"), F.col("choices"), F.col("context"), F.lit(""))
    out = joined.withColumn("prompt_tokens", token_estimate(prompt)).withColumn("_m", models.generate(prompt, engine, max_tokens=50, **options))
    predicted = answer_letter(F.col("_m.text"))
    kind = F.coalesce("question_type", question_type(F.col("question")))
    return out.select("window_index", "question_id", "question", kind.alias("question_type"), "answer", predicted.alias("predicted"), same_answer(predicted, F.col("answer")).alias("is_correct"), F.size("context").alias("n_articles"), "prompt_tokens", F.col("_m.text").alias("response"), F.col("_m.error").alias("error"))


def reference_labels(docs: DataFrame, keys: list[str], order: list[str], text: str, cached: DataFrame | None = None, engine: str | None = None, **options) -> DataFrame:
    """(keys, label): the join of a window's texts, or a model's abstract of it; windows in the cache aren't made again."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda s: s[text]), " ")
    todo = docs if cached is None else docs.join(cached.select(*keys), keys, "left_anti")
    made = todo.groupBy(*keys).agg(joined.alias("label"))
    if engine:
        made = made.withColumn("label", models.generate(qa_generation.summary_prompt(F.array("label"), 100), engine, **options)["text"])
    return made if cached is None else cached.select(*keys, "label").unionByName(made)


def first_windows(rows: DataFrame, topic: str, order: str) -> DataFrame:
    """The first window of each topic."""
    return one_per_key(rows, [topic], order)
