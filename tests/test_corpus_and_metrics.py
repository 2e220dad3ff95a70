"""Nested corpora, sinks, ETL rules, clustering metrics, state, streams, HTML tables and the registry."""

from __future__ import annotations

import datetime as dt
import json
import urllib.error
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.config import Config, merged, validate
from tidemark.functions import html_tables as ht
from tidemark.functions.models import StubClient
from tidemark.operators import cluster_state as cs
from tidemark.operators import etl
from tidemark.plans import clustering_metrics as cm
from tidemark.plans import qa_metrics as qa
from tidemark.sources import connectors, corpus, sinks
from tidemark.streaming import stateful

EVENT = {"event_date": "2024-1-5", "event_sum": "s", "event_urls": ["u1", "u2"], "event_text": ["t1"], "People": ["A"], "Relations": ["r"], "Event Attributes": {"k": "v"}}
TOPICS = {"keywords": ["k"], "topics": [{"topic_title": "T", "topic_category": "c", "topic_url": "x", "start_date": "", "last_date": "", "events": [EVENT, {"event_date": "2024-13-01"}, {"event_date": None}, {"event_date": "2024-01-02", "event_text": ["a", "b"], "event_urls": ["w"]}]}, {"events": [{"event_date": "2024-02-01"}]}]}
PAIR = {"question_type": "entity_tracking", "question": "Who?", "choices": {"a": "1"}, "answer": "a", "referenced_article": ""}
QA = {"events": [{"event_date": "2024-01-05", "event_text": ["first"], "qa_pairs": [PAIR, PAIR | {"question": "Whom?", "referenced_article": "ref"}, PAIR], "sanity_check": {"is_valid": False, "qa_checks": [{"index": 0, "is_valid": True}, {"index": 1, "is_valid": False}], "redundancy_check": {"entity_tracking": {"is_redundant": True}}}}, {"event_date": "2024-01-06", "qa_pairs": [PAIR]}]}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TOPICS))
    (tmp_path / "qa").mkdir()
    (tmp_path / "qa" / "q.json").write_text(json.dumps(QA))
    return tmp_path


def test_topics_flatten_and_nest(spark, folder):
    events = corpus.flatten_events(corpus.read_topics(spark, f"{folder}/*.json"))
    got = sorted((r.topic_idx, r.event_idx, r.topic_title, r.event_date) for r in events.collect())
    assert got == [(0, 0, "T", dt.date(2024, 1, 5)), (0, 3, "T", dt.date(2024, 1, 2)), (1, 0, "Unknown Topic", dt.date(2024, 2, 1))]
    assert [(r.url, r.text) for r in corpus.flatten_articles(events).orderBy("event_idx").collect()] == [("u1", "t1"), ("w", "a")]
    assert Counter(r.truth for r in corpus.flatten_texts(events).collect()) == {0: 1, 1: 2}
    lines = events.where("event_idx = 0 and topic_idx = 0").select(corpus.cue_lines(F.col("event_date")).alias("x"), corpus.cues(("Relations",)).alias("c")).first()
    assert lines.x == "[2024-01-05]\n- People: A\n- Event Attributes: k: v" and lines.c.People == ["A"] and "Relations" not in lines.c.asDict()
    nested = corpus.nest(events).first().topics
    assert [len(t.events) for t in nested] == [2, 1] and nested[0].start_date == "2024-01-02" and nested[0].last_date == "2024-01-05"


def test_questions_flatten(spark, folder):
    q = corpus.flatten_qa(corpus.read_qa(spark, f"{folder}/qa/*.json"))
    assert sorted((r.event_idx, r.qa_idx, r.referenced_article) for r in q.collect()) == [(0, 0, "first"), (0, 1, "ref"), (0, 2, "first"), (1, 0, "")]
    assert sorted((r.event_idx, r.qa_idx) for r in corpus.valid_questions(q).collect()) == [(0, 0), (1, 0)]
    assert Counter(r.event_idx for r in corpus.without_redundant(q).collect()) == {0: 1, 1: 1}


def test_article_dicts_and_run_names(spark):
    raw = '{"P": "http://a", "Q": {"url": "http://b", "title": "t", "text": "x"}}'
    row = spark.createDataFrame([(raw,)], "c string").select(corpus.article_dict(F.col("c")).alias("x")).first().x
    assert sorted((a.outlet, a.url, a.text) for a in row) == [("P", "http://a", None), ("Q", "http://b", "x")]
    runs = {p: spark.createDataFrame([(p,)], "p string").select(corpus.run_name(F.col("p")).alias("r")).first().r for p in ("x/cluster_s1_t5_struct_2024/r.json", "summ_s_b_t3_concat_no_struct_1", "other")}
    r = list(runs.values())
    assert (r[0].task, r[0].story, r[0].texts_per_event, r[0].structure) == ("cluster", "s1", 5, "struct")
    assert (r[1].story, r[1].label, r[1].structure) == ("s_b", "concat", "no_struct") and r[2].task is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2024, "m", 2.0, 9), (2023, "m", 1.0, 8)], "year int, model string, score double, extra int")
    sinks.write_csv_by_year(rows, f"{tmp_path}/csv", ["year", "model", "score", "missing"], ["model"])
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert set(back.columns) == {"year", "model", "score", "missing", "_year"} and back.count() == 2
    assert sinks.append_new(spark, rows, f"{tmp_path}/p", ["year"]) == 2 and sinks.append_new(spark, rows, f"{tmp_path}/p", ["year"]) == 0
    cached = sinks.upsert(spark, rows, rows.where("year = 2023").withColumn("score", F.lit(5.0)), ["year"])
    assert {r.year: r.score for r in cached.collect()} == {2024: 2.0, 2023: 5.0} and sinks.upsert(spark, None, rows, ["year"]) is rows
    sinks.write_json(rows, f"{tmp_path}/j", ["score"])
    assert "".join(f.read_text() for f in (tmp_path / "j").glob("*.json")).startswith('{"score"')
    ann = sinks.annotation_rows(spark.createDataFrame([({"a": "x"}, ["t", "u"], ["p", "q"])], "choices map<string,string>, event_text array<string>, people array<string>")).first()
    assert ann.choice_a == "x" and ann.choice_b is None and ann.event_text == "t\n\n---\n\nu" and ann.people == "p, q"


def test_modal_date_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 0)], "k long, d string, at long")
    assert [(r.k, r.d, r.votes) for r in etl.modal_value(rows, ["k"], "d", "at").collect()] == [(1, "b", 2)]
    assert sorted((r.k, r.at) for r in etl.at_modal_date(rows, ["k"], "d", "at").collect()) == [(1, 0), (1, 3), (2, 0)]


def test_removal_order(spark):
    rows = spark.createDataFrame([(None, ["가"], ["u"]), ("2023-01-01", ["가"], ["u"]), ("2024-02-01", [], ["u"]), ("2024-02-01", ["가"], ["u"]), ("2024-02-01", ["x"], ["u"])], "d string, t array<string>, u array<string>")
    reason = etl.removal_reason(F.to_date("d"), F.col("t"), F.col("u"), F.lit("2024-01-01").cast("date"), "[가-힣]")
    assert [r.x for r in rows.select(reason.alias("x")).collect()] == ["empty", "date", "empty", "script", None]


def test_keep_one_and_keywords(spark):
    rows = spark.createDataFrame([("s", "x", 0), ("s", "target", 1), ("r", "x", 2), ("r", "y", 3)], "s string, t string, at long")
    assert sorted((r.s, r.t) for r in etl.keep_one(rows, ["s"], F.col("t") == "target", "at").collect()) == [("r", "x"), ("s", "target")]
    docs = spark.createDataFrame([("g", 0, "zeta beta beta alpha"), ("h", 1, "a of the")], "g string, at long, t string")
    assert sorted((r.g, r["rank"], r.word, r.n) for r in etl.top_keywords(docs, "g", "t", 2, "at").collect()) == [("g", 1, "beta", 2), ("g", 2, "zeta", 1), ("h", 1, "unknown", 0)]


def pairwise_b3(truth, pred):
    n = len(truth)
    p = sum(sum(truth[i] == truth[j] for j in range(n) if pred[i] == pred[j]) / sum(pred[i] == pred[j] for j in range(n)) for i in range(n)) / n
    r = sum(sum(pred[i] == pred[j] for j in range(n) if truth[i] == truth[j]) / sum(truth[i] == truth[j] for j in range(n)) for i in range(n)) / n
    return p, r


@pytest.mark.parametrize("truth,pred", [([0, 0, 1, 1], [0, 0, 0, 1]), ([0, 1, 2, 3], [0, 0, 0, 0]), ([0, 0, 0], [-1, 1, -1]), ([0, 1, 1, 2, 2, 2, 0], [1, 1, 2, 2, 2, 0, 0])])
def test_b_cubed_equals_the_pairwise_form(spark, truth, pred):
    rows = spark.createDataFrame(list(zip(truth, pred)), "t long, p long")
    got = cm.b_cubed(cm.contingency(rows, "t", "p")).first()
    p, r = pairwise_b3(truth, pred)
    assert (got.precision, got.recall, got.f1) == pytest.approx((p, r, 2 * p * r / (p + r)))


def test_information_edges(spark):
    get = lambda t, p: cm.adjusted(cm.contingency(spark.createDataFrame(list(zip(t, p)), "t long, p long"), "t", "p")).first()
    same, none, single = get([0, 0, 1, 1], [5, 5, 7, 7]), get([0, 0, 1, 1], [0, 1, 0, 1]), get([0, 0], [1, 1])
    assert same.nmi == pytest.approx(1) and same.ami == pytest.approx(1) and none.nmi == 0 and single.nmi == 1 and single.ami == 1
    assert none.ami == pytest.approx(-0.5)
    assert cm.adjusted_rand(cm.contingency(spark.createDataFrame([(0, 0), (0, 0), (1, 1)], "t long, p long"), "t", "p")).first().ari == 1


def test_question_metrics(spark):
    rows = spark.createDataFrame([("A", "A", None, True, "a b", 0.5), ("B", None, "x", False, "c", None)], "truth string, pred string, kind string, ok boolean, resp string, conf double")
    o = qa.overall(rows, "ok").first()
    assert (o.total, o.correct, o.accuracy) == (2, 1, 0.5) and qa.overall(rows.limit(0), "ok").first().accuracy == 0
    assert {r.kind: r.accuracy for r in qa.by(rows, F.col("kind"), "ok", "kind").collect()} == {"unknown": 1.0, "x": 0.0}
    assert Counter((r.side, r.answer) for r in qa.answer_distribution(rows, "pred", "truth").collect()) == Counter([("predicted", "A"), ("predicted", "N/A"), ("true", "A"), ("true", "B")])
    assert {r.score: r.percent for r in qa.score_distribution(spark.createDataFrame([(2,), (2,), (0,)], "s int"), ["s"]).collect()} == {2: 66.67, 1: 0.0, 0: 33.33}
    assert [r.percent for r in qa.score_distribution(spark.createDataFrame([], "s int"), ["s"]).collect()] == [0, 0, 0]


def test_cluster_state_caps_what_is_visible():
    state = cs.ClusterState()
    assert [state.take(n, [str(n)], cap=2) for n in (0, 1, 2)] == [0, 1, 2]
    assert [i for i, c in state.clusters.items() if c.visible] == [1, 2]
    assert state.take(0, ["again"], cap=2) == 0 and [i for i, c in state.clusters.items() if c.visible] == [0, 2]
    assert state.take(50, ["new"], cap=9) == 3 and state.take(-1, []) == -1
    assert cs.ClusterState.loads(state.dumps()) == state and cs.ClusterState.loads(None) == cs.ClusterState()
    assert cs.ClusterState().assign(StubClient(failing="DOCUMENT"), "x") == -1
    assert len(cs.shortened("x" * 5000)) == 2000 + len("... [truncated]")


def test_hidden_clusters_cost_a_document_nothing():
    class Watched(dict):
        def items(self):
            raise AssertionError("all clusters are walked through")

        __iter__ = values = keys = items

    state = cs.ClusterState()
    for n in range(300):
        state.take(n, [str(n)], cap=3)
    state.clusters = Watched(state.clusters)
    assert state.following() == 300 and "Cluster 299" in state.prompt("x") and "Cluster 5:" not in state.prompt("x")
    assert state.take(5, ["again"], cap=3) == 5 and "Cluster 5:" in state.prompt("x") and "Cluster 297:" not in state.prompt("x")
    assert state.assign(StubClient(), "a word of its own", 3) == 300


def test_texts_travel_as_far_as_the_model_sees_them(spark):
    docs = spark.createDataFrame([(0, "s", "é" * 2500), (1, "s", None), (2, "s", "y" * 2001)], "id long, story string, text string")
    for t, n in zip(docs.select("text", cs.opening("text").alias("o")).orderBy("text").collect(), (0, 2001, 2001)):
        assert len(t.o or "") == n and cs.shortened(t.o) == cs.shortened(t.text)


def test_seeded_and_incremental_folds(spark):
    docs = spark.createDataFrame([(i, "s", f"alpha{'' if i < 2 else 'bet'} words here", i < 2) for i in range(4)], "id long, story string, text string, head boolean")
    seeded = {r.id: r.cluster for r in cs.cluster_windows(docs, "story", "id", "text", ["id"]).collect()}
    assert seeded[0] == seeded[1] == 0
    inc = {r.id: r.cluster for r in cs.cluster_incrementally(docs, "story", "id", "text", ["id"], "head").collect()}
    assert inc[0] == inc[1] == 0 and len(inc) == 4
    assert cs.seed_keywords(StubClient(failing="x"), "x") == ["unknown"] and cs.seed_keywords(StubClient(("one big cat",)), "") == ["one", "big", "cat"]


def test_backups_results_and_years(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.json", 2024, "s"), ("x/b.json", 2025, "t")], "file string, year int, story string")
    assert sinks.write_with_backup(spark, rows, f"{tmp_path}/out", "1") is None
    assert sinks.write_with_backup(spark, rows.limit(1), f"{tmp_path}/out", "2").endswith(".backup-2")
    assert spark.read.json(f"{tmp_path}/out").count() == 1 and spark.read.json(f"{tmp_path}/out.backup-2").count() == 2
    sinks.write_per_file(rows, f"{tmp_path}/each")
    assert {p.name for p in (tmp_path / "each").glob("input=*")} == {"input=a", "input=b"}
    assert corpus.read_results(spark, f"{tmp_path}/none", "a int").count() == 0
    assert [r.story for r in corpus.allowed_runs(spark, rows, {2024: ["s", "t"]}).collect()] == ["s"]


def test_stream_equals_batch(spark, tmp_path):
    docs = [(i, f"s{i % 3}", f"alpha{i % 4} beta{i % 4} gamma{i % 4} text") for i in range(60)]
    for part in range(3):
        spark.createDataFrame(docs[part * 20 : part * 20 + 20], "id long, story string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    batch = spark.read.parquet(f"{tmp_path}/in/*")
    expected = sorted(map(tuple, cs.cluster_stories(batch, "story", "id", "text", ["id"], cap=2).collect()))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = stateful.run_to_table(cs.cluster_stream(stream, "story", "id", "text", ["id"], cap=2), "streamed", f"{tmp_path}/cp", "append")
    assert sorted(map(tuple, got.collect())) == expected


def test_html_tables(spark):
    page = """<div id="2024_March_7"><h3>Conflict</h3><ul><li><a href="/w">War [1]</a><ul><li>Deep<ul><li>A strike. <a class="external" href="http://n">(News)</a></li></ul></li></ul></li></ul></div>
    <p><b>Bold title</b> Text with <a href="#r1">[1]</a></p><h4>Next</h4><p>More <a href="#r2">[2]</a></p><ol class="references"><li id="r1">One <a href="/x">in</a><a href="http://y">out</a></li><li id="r2">Two</li></ol>"""
    (leaf,) = ht.topic_leaves(page, " WAR ")
    assert leaf == {"date": "2024_March_7", "category": "Conflict", "topics": ["War [1]", "Deep"], "summary": "A strike.", "articles": {"News": "http://n"}}
    assert ht.topic_leaves(page, "peace") == [] and ht.topic_leaves(None) == []
    assert [(r[1], r[3]) for r in ht.references(page)] == [("r1", "http://y"), ("r2", "")]
    assert [(r[1], r[3]) for r in ht.citations(page)] == [("bold title", "r1"), ("next", "r2")]
    df = spark.createDataFrame([(1, page)], "id long, html string")
    assert df.lateralJoin(ht.ReferenceTable(F.col("html").outer())).count() == 2
    assert df.lateralJoin(ht.CitationTable(F.col("html").outer())).count() == 2
    assert df.lateralJoin(ht.TopicTable(F.col("html").outer(), F.lit("war"))).first().summary == "A strike."


def test_fetching_retries():
    calls = []

    def fetch(url):
        calls.append(url)
        code = {"busy": 429, "bad": 400}.get(url)
        if code and calls.count(url) < 3:
            raise urllib.error.HTTPError(url, code, "", None, None)
        return "ok"

    assert connectors.with_retries(fetch, "busy", sleep=lambda s: None) == ("ok", None)
    assert connectors.with_retries(fetch, "bad", sleep=lambda s: None) == (None, "HTTP 400") and calls.count("bad") == 1


def test_config(monkeypatch):
    base = {"a": {"b": 1}}
    assert merged(base, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and base == {"a": {"b": 1}}
    c = Config({"model": {"name": "m"}}, {"TIDEMARK_WINDOW__SIZE": "9"})
    assert c.get("window.size") == 9 and c.get("model.name") == "m" and c.get("model.engine") == "stub" and c.get("no.such", 3) == 3
    assert Config(environ={}).get("window.size") == 7
    validate("clustering", "incremental", 7, 1, "stub", ("stub",))
    for bad in (("x", "date", 7, 1, "stub"), ("temporal_qa", "incremental", 7, 1, "stub"), ("clustering", "date", 0, 1, "stub"), ("clustering", "date", 1, 1, "gpt")):
        with pytest.raises(ValueError):
            validate(*bad, ("stub",))


def test_registry(spark, sf_dir):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and set(catalog.queries()) <= set(q) and len(catalog.queries()) > 80
    assert e.entry(spark).count() > 0
    for name in ("modal_date_per_group", "b3_metrics", "token_budget_equal", "greedy_dedup", "proper_noun_counts", "embedded_similarity", "question_building"):
        assert catalog.queries()[name](spark, sf_dir).count() > 0
