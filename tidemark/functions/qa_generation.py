"""Prompts, and offline templates for building and judging multiple-choice questions from structured cues.

Each step is a column, so a model engine can take the place of a template: generate, propose candidates, choose four,
check, judge.  Random picks are by hash of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.sampling import order_key, shuffled_choices
from .parsing import four_choices, structural_reasons

KINDS = ("result_recognition", "entity_tracking")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def prompt(task: str, *parts: Column) -> Column:
    return F.concat_ws("\n", F.lit(f"[TASK: {task}]"), *parts)


def summary_prompt(documents: Column, limit: int) -> Column:
    return prompt("summarise", F.lit(f"Summarise what happened in at most {limit} words, in order of time."), F.lit("[DOCUMENTS]"), F.array_join(documents, "\n"))


def answer_prompt(question: Column, choices: Column, articles: Column, cues: Column) -> Column:
    """choices: map from letter to text. Articles and cues are dated and none is later than the question."""
    listed = F.array_join(F.transform(F.map_entries(choices), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")
    return prompt("answer", F.lit("Answer with one letter."), F.lit("[ARTICLES]"), F.array_join(articles, "\n"), F.when(F.length(cues) > 0, F.concat(F.lit("[CUES]\n"), cues)), F.lit("[QUESTION]"), question, listed)


def batch_prompt(prompts: Column, separator: str) -> Column:
    """One prompt for many tasks; answers come back between separators."""
    return F.concat(F.lit(f"Answer each task in order, with {separator} between answers.\n"), F.array_join(prompts, f"\n{separator}\n"))


def judge_prompt(aspect: str, question: Column, choices: Column, answer: Column, article: Column) -> Column:
    return prompt("judge", F.lit(f"Judge the {aspect} by two criteria, as JSON with criteria and is_satisfied."), question, choices, answer, article)


def redundancy_prompt(kind: Column, questions: Column) -> Column:
    return prompt("judge", F.concat(F.lit("Do these "), kind, F.lit(" questions ask the same? As JSON with criteria and is_satisfied.")), F.array_join(questions, "\n"))


def rubric_prompt(reference: Column, generated: Column) -> Column:
    return prompt("judge", F.lit("Answer yes or no for each criterion, as JSON."), reference, generated)


def pick_kind(key: Column, seed: int = 42) -> Column:
    """One of the two kinds of question, by hash."""
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.crc32(order_key(seed, key).cast("binary")) % 2 + 1).cast("int"))


def mentioned(entities: Column, text: Column) -> Column:
    """Entities that the text names, case and all."""
    return F.filter(entities, lambda e: F.contains(text, e))


def template_question(kind: Column, date: Column, entity: Column, result: Column) -> Column:
    """struct(question, answer); null where the cue for the kind is missing, so that the caller can try the other kind."""
    on = F.date_format(date, "yyyy-MM-dd")
    who = F.struct(F.concat(F.lit("Who was involved in the events reported on "), on, F.lit("?")).alias("question"), entity.alias("answer"))
    what = F.struct(F.concat(F.lit("What was the outcome reported on "), on, F.lit("?")).alias("question"), result.alias("answer"))
    return F.when((kind == KINDS[1]) & entity.isNotNull(), who).when((kind == KINDS[0]) & result.isNotNull(), what)


def candidates(answer: Column, pool: Column, seed: int, key: Column, n: int = 10) -> Column:
    """The answer and others from the pool, in hash order, n at most."""
    others = F.array_except(F.array_distinct(pool), F.array(answer))
    hashed = F.sort_array(F.transform(others, lambda c: F.struct(order_key(seed, key, c).alias("h"), c.alias("c"))))
    return F.concat(F.array(answer), F.transform(F.slice(hashed, 1, n - 1), lambda s: s["c"]))


def finished(question: Column, answer: Column, pool: Column, seed: int, key: Column) -> Column:
    """struct(choices map, answer letter, reasons): four shuffled choices with the answer's letter, and what is wrong."""
    letters = F.array(*[F.lit(x) for x in "abcd"])

    def result(mixed: Column) -> Column:
        as_map = F.when(F.size(mixed["choices"]) == 4, F.map_from_arrays(letters, mixed["choices"]))
        return F.struct(as_map.alias("choices"), mixed["answer"].alias("answer"), structural_reasons(question, mixed["choices"], mixed["answer"]).alias("reasons"))

    chosen = bound(F.slice(candidates(answer, pool, seed, key), 1, 4), lambda c: four_choices(c, answer))
    return bound(bound(chosen, lambda c: shuffled_choices(c, answer, seed, key)), result)
