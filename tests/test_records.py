"""Question building, cues as JSON, reference dates, budgets, clustering errors, and plans of the metrics."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import html_tables as ht
from tidemark.functions.models import StubClient
from tidemark.operators import cluster_state as cs
from tidemark.operators import similarity
from tidemark.plans import clustering_metrics as cm
from tidemark.plans import questions, tasks
from tidemark.plans import summary_metrics as sm
from tidemark.sources import corpus


class Script:
    """A client that answers by the kind of prompt, from lists."""

    def __init__(self, **answers):
        self.answers, self.temperatures = answers, []

    def generate(self, prompt, max_tokens=500, temperature=0.7):
        self.temperatures.append(temperature)
        kind = prompt.split("[TASK: ")[1].split("]")[0]
        answer = self.answers[kind].pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_attempts_end_with_a_valid_question_or_an_error():
    valid, invalid = '```json {"is_valid": true}```', '{"is_valid": false, "overall_reason": "vague"}'
    assert questions.attempt(Script(question=["q1", "q2"], validate=[invalid, valid], rephrase=["Q2?"]), "k", "d", "t", "a") == ("Q2?", 2, None)
    assert questions.attempt(Script(question=["q"] * 3, validate=[invalid] * 3), "k", "d", "t", "a") == (None, 3, "vague")
    assert questions.attempt(Script(question=["q"], validate=[valid], rephrase=[RuntimeError("x")]), "k", "d", "t", "a") == ("q", 1, None)
    assert questions.attempt(Script(question=["", RuntimeError("down"), "q"], validate=["no json"]), "k", "d", "t", "a") == (None, 3, "invalid")


def test_redundancy_asks_only_about_several_questions(spark):
    rows = spark.createDataFrame([("e", "k", "one", 1), ("f", "k", "a", 1), ("f", "k", "b", 2)], "event string, kind string, question string, id int")
    yes = json.dumps({"criteria": [{"is_satisfied": True}] * 2})
    got = {r.event: (r.n, r.is_redundant) for r in questions.redundancy(rows, "event", "kind", "question", "id", responses=(yes,)).collect()}
    assert got == {"e": (1, False), "f": (2, True)}


def test_cues_are_json(spark):
    people, attributes = ['A "b"', "é\n\\"], {"ö": "w"}
    rows = spark.createDataFrame([(people, ["x"], [], attributes), ([], None, None, None)], "people array<string>, location array<string>, result array<string>, event_attributes map<string,string>")
    got = [r.j for r in rows.select(corpus.cue_json().alias("j")).collect()]
    assert got == [json.dumps({"People": people, "Location": ["x"], "Event Attributes": attributes}, indent=2, ensure_ascii=False), "{}"]


def test_reference_dates_prefer_marked_ones():
    item = lambda inside: ht.reference_date(ht.tree(f"<li>{inside}</li>"))
    assert item('1999-01-02 <span class="date">March 2020</span> <span class="reference-date">3 May 2021</span>') == "2021-05-03"
    assert item('<time datetime="2020-02-03T10:00">x</time>') == "2020-02-03" and item("On Sept. 9, 2021 or 2022-01-01") == "2022-01-01"
    assert item("31 February 2020") == "" and item("12/3/2020") == "" and item("3055-01-01") == ""
    page = '<h2>A</h2><li id="x">x</li><h2 id="References">R</h2><div><li id="r1">May 2020</li></div><h2>B</h2><li id="y">y</li>'
    assert [(r[1], r[4]) for r in ht.references(page)] == [("r1", "2020-05-01")]


def test_budgets_before_collecting_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), i, "x" * int(rng.integers(0, 40))) for i, g in enumerate(rng.integers(0, 6, 200))]
    df = spark.createDataFrame(rows, "g int, i int, t string")
    from tidemark.functions.text import greedy_budget

    plain = df.groupBy("g").agg(greedy_budget(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), 25).alias("x"))
    assert {r.g: r.x for r in plain.collect()} == {r.g: r.x for r in tasks.budgeted(df, ["g"], ["i"], F.col("t"), 25, "x").collect()}


def test_failed_documents_keep_their_error(spark):
    docs = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "boom"), (2, 3, "gamma")], "w int, id int, text string")
    got = {r.id: (r.cluster, r.error) for r in cs.cluster_windows(docs, "w", "id", "text", ["id"], failing="boom").collect()}
    assert got[2][0] == -1 and "RuntimeError" in got[2][1] and got[1] == (0, None) and got[3] == (0, None)
    named = cs.cluster_keywords(docs.withColumn("cluster", F.lit(0)), "w", "cluster", "text", "id").collect()
    assert {r.w: r.keywords for r in named} == {1: ["alpha", "beta"], 2: ["gamma"]}
    state = cs.ClusterState()
    assert state.assign(StubClient(responses=("?",)), "x") == -1 and "unreadable" in state.error


def test_jaccard_pairs_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [[f"t{j}" for j in rng.choice(60, 30, replace=False)] for _ in range(4)]
    sets = {}
    for i in range(80):
        own = list(base[i % 4])
        for j in rng.integers(0, 30, int(rng.integers(0, 5))):
            own[j] = f"u{i}_{j}"
        sets[i] = sorted(set(own[: int(rng.integers(20, 31))]))
    df = spark.createDataFrame([(i % 2, i, s) for i, s in sets.items()], "g int, id int, tokens array<string>")
    for threshold in (0.5, 0.8, 0.9, 1.0):
        want = {(i, j) for i in sets for j in sets if i < j and i % 2 == j % 2 and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= threshold}
        assert {(r.left_id, r.right_id) for r in similarity.jaccard_pairs(df, "g", "id", "tokens", threshold).collect()} == want


def test_jaccard_pairs_of_copies(spark):
    """Copies are compared once and are in all pairs of their set; no token is made a row."""
    ten = [f"t{j}" for j in range(10)]
    rows = [("g", 9, ten), ("g", 2, ten[::-1]), ("g", 5, [*ten, "u"]), ("g", 1, [*ten, "u"]), ("g", 7, ["v"]), ("h", 3, ten), (None, 4, ten), (None, 6, ten), ("g", 8, []), ("g", 10, None), ("g", None, ten)]
    df = spark.createDataFrame(rows, "g string, id int, tokens array<string>")
    out = similarity.jaccard_pairs(df, "g", "id", "tokens", 0.9)
    assert sorted((r.g, r.left_id, r.right_id, round(r.similarity, 6)) for r in out.collect()) == [
        ("g", 1, 2, 0.909091), ("g", 1, 5, 1.0), ("g", 1, 9, 0.909091), ("g", 2, 5, 0.909091), ("g", 2, 9, 1.0), ("g", 5, 9, 0.909091)]
    assert "Generate" not in out._jdf.queryExecution().toString()


def test_log_factorials(spark):
    rows = [0, 1, 2, 7, 50, 12_345, 10_000_000]
    got = [r.x for r in spark.createDataFrame([(n,) for n in rows], "n long").select(cm.log_factorial(F.col("n").cast("double")).alias("x")).collect()]
    assert all(abs(x - math.lgamma(n + 1)) <= 1e-11 * max(1, x) for n, x in zip(rows, got))


def test_plans_have_no_window_over_all_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "t string, p int, h string")
    cells = cm.contingency(rows, "t", "p")
    for frame in (cm.adjusted(cells), cm.b_cubed(cells), cm.adjusted_rand(cells), sm.previous(rows, "t", "p", "h")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("], [" in line for line in windows)  # a partition, and not only an order or nothing
    assert "Window" not in sm.previous(rows, "t", "p", "h")._jdf.queryExecution().optimizedPlan().toString()


def test_metric_error_rows(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), "a", None)], "d date, t string, p string")
    assert cm.scored_or_error(rows, "t", "p").first().error == "empty input"


def test_first_dates_in_texts():
    from datetime import date

    from tidemark.functions.dates import first_date

    cases = {
        "retrieved 4\xa0June 2019.": (2019, 6, 4), "March 5 2020 or later": (2020, 3, 5), "May 2020": (2020, 5, 1), "in 2020/1/2, 3 days": (2020, 1, 2), "On Sept. 9, 2021 or 2022-01-01": (2022, 1, 1),
        "31 February 2020, then 1 March 2020": (2020, 3, 1), "Marchen 2020": None, "12/3/2020": None, "3055-01-01": None, "2020-13-01": None, "": None, "no date": None,
    }
    assert {t: first_date(t) for t in cases} == {t: d and date(*d) for t, d in cases.items()}


def test_judged_events_go_under_their_topics(spark):
    topics = spark.createDataFrame([("f", 0, 2), ("f", 1, 0), ("f", 2, 1), ("g", 0, 1), (None, 0, 1)], "file string, topic long, n long")
    judged = spark.createDataFrame([("f", i, f"e{i}") for i in range(4)] + [("g", 0, "x")], "file string, at int, event string")
    found = {(r.file, r["at"]): (r.topic, r.event_idx, r.event) for r in corpus.by_running_offset(topics, judged, "file", "topic", "n", "at").collect()}
    assert found == {("f", 0): (0, 0, "e0"), ("f", 1): (0, 1, "e1"), ("f", 2): (2, 0, "e2"), ("f", 3): (None, None, "e3"), ("g", 0): (0, 0, "x")}
