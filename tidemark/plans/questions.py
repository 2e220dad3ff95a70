"""Building and judging multiple-choice questions with a model: attempts, validation, rephrasing, choices, redundancy, judges.

A model is called in Arrow batches, one client for a task; every step leaves an error as a column instead of failing.
Judges always run at a temperature of 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models, qa_generation
from ..functions.models import Client, make_client
from ..functions.parsing import judge_score, keyword_list

# What a judge is asked about.
ASPECTS = ("question", "answer", "choice")
ATTEMPTS = 3


def _fenced(answer: str) -> dict:
    """The JSON object of an answer; an empty one if there is none."""
    try:
        return json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
    except ValueError:
        return {}


def attempt(client: Client, kind: str, date: str, article: str, answer: str, attempts: int = ATTEMPTS) -> tuple[str | None, int, str | None]:
    """(question, attempts made, error): writes a question for an answer until a check finds it valid, and rephrases that one."""
    error = "no question"
    for n in range(1, attempts + 1):
        try:
            asked = client.generate(f"[TASK: question]\n{kind}, attempt {n}\nThe answer is: {answer}\nDate: {date}\n[DOCUMENTS]\n{article}", 200, 0.7).strip()
            if not asked:
                continue
            verdict = _fenced(client.generate(f"[TASK: validate]\nIs the answer hidden, bound to its time, grounded and as specific as the text? As JSON with is_valid.\n{kind}\n{asked}\n{answer}\n{article}", 500, 0.0))
            if not verdict.get("is_valid"):
                error = str(verdict.get("overall_reason") or "invalid")
                continue
        except Exception as e:  # noqa: BLE001  a client may raise anything, and one question must not end the run
            error = f"{type(e).__name__}: {e}"
            continue
        try:
            return client.generate(f"[TASK: rephrase]\nMake the question fluent and return it alone.\n{kind}\n[QUESTION]\n{asked}", 200, 0.3).strip() or asked, n, None
        except Exception:  # noqa: BLE001  the question as it was will do
            return asked, n, None
    return None, attempts, error


def questions(kind: Column, date: Column, article: Column, answer: Column, attempts: int = ATTEMPTS, engine: str = "stub", **options) -> Column:
    """struct(question, attempts, error) for each row."""

    @F.pandas_udf("question string, attempts int, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = make_client(engine, **options)
        for columns in batches:
            made = [attempt(client, *(x or "" for x in row), attempts) for row in zip(*columns)]
            yield pd.DataFrame(made, columns=["question", "attempts", "error"])

    return run(kind, date.cast("string"), article, answer)


def proposed(question: Column, answer: Column, article: Column, n: int = 10, engine: str = "stub", **options) -> Column:
    """The answer and up to n - 1 other candidates that a model proposes."""
    prompt = qa_generation.prompt("keywords", F.lit(f"Propose {n} candidate answers as a list, one of them right."), question, answer, F.lit("[DOCUMENT]"), article)
    others = F.array_except(keyword_list(models.generate(prompt, engine, **options)["text"], n), F.array(answer, F.lit("unknown")))
    return F.concat(F.array(answer), F.slice(others, 1, n - 1))


def redundancy(rows: DataFrame, event: str, kind: str, question: str, order: str, engine: str = "stub", **options) -> DataFrame:
    """(event, kind, n, is_redundant): whether an event's questions of a kind ask the same; a single one never does."""
    per = rows.groupBy(event, kind).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(order, question))).alias("_q"))
    prompt = qa_generation.redundancy_prompt(F.col(kind), F.transform("_q", lambda s: s[question]))
    asked = per.withColumn("_a", F.when(F.col("n") > 1, models.generate(prompt, engine, temperature=0.0, **options)["text"]))
    return asked.select(event, kind, "n", F.coalesce(judge_score(F.col("_a")) == 2, F.lit(False)).alias("is_redundant"))


def judged(rows: DataFrame, question: Column, choices: Column, answer: Column, article: Column, engine: str = "stub", **options) -> DataFrame:
    """``rows`` with question_score, answer_score and choice_score from 0 to 2, one call for each."""
    scores = {f"{a}_score": judge_score(models.generate(qa_generation.judge_prompt(a, question, choices, answer, article), engine, temperature=0.0, **options)["text"]) for a in ASPECTS}
    return rows.withColumns(scores)
