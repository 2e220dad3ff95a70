"""Windows and joins against brute force and golden cases."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import etl
from tidemark.operators import joins as J
from tidemark.operators import windows as W

DAY = dt.date(2024, 1, 1)


def frame(spark, days):
    return spark.createDataFrame([(i, DAY + dt.timedelta(days=d) if d is not None else None) for i, d in enumerate(days)], "id long, event_date date")


def brute_windows(days, size, stride):
    days = [d for d in days if d is not None]
    out, start = [], min(days)
    while start <= max(days):
        n = sum(start <= d < start + size for d in days)
        if n:
            out.append((len(out), start, n))
        start += stride
    return out


@pytest.mark.parametrize("days,size,stride", [([2, 4], 5, 1), ([0, 19], 2, 1), ([0, 1, 5, 12, 13, 25], 3, 10), ([0, 0, 3, 7, None], 7, 7), ([5], 1, 1), ([0, 9, 10, 11], 7, 3)])
def test_date_windows(spark, days, size, stride):
    got = W.date_windows(frame(spark, days), size, stride, F.count("*").alias("n")).orderBy("window_index").collect()
    assert [(r.window_index, (r.window_start - DAY).days, r.n) for r in got] == brute_windows(days, size, stride)
    assert all((r.window_end - r.window_start).days == size for r in got)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.integers(0, 40), min_size=1, max_size=12), size=st.integers(1, 9), stride=st.integers(1, 12))
def test_date_windows_property(spark, days, size, stride):
    got = W.date_windows(frame(spark, days), size, stride, F.count("*").alias("n")).orderBy("window_index").collect()
    assert [(r.window_index, (r.window_start - DAY).days, r.n) for r in got] == brute_windows(days, size, stride)


@pytest.mark.parametrize("n,size,stride", [(4, 5, 1), (7, 3, 2), (7, 7, 1), (10, 3, 4), (6, 1, 1)])
def test_count_windows(spark, n, size, stride):
    got = W.assign_count_windows(frame(spark, [i // 2 for i in range(n)]), size, stride, "event_date", "id")
    by = {}
    for r in got.collect():
        by.setdefault(r.window_index, []).append(r.id)
    starts = range(0, n - size + 1, stride)
    assert {k: sorted(v) for k, v in by.items()} == {i: list(range(s, s + size)) for i, s in enumerate(starts)}


def test_incremental_windows(spark):
    got = W.incremental_windows(frame(spark, [3, 1, 2]), "event_date", "id").orderBy("window_index").collect()
    assert [(r.window_index, r.event_count, r.id, (r.start_date - DAY).days) for r in got] == [(0, 1, 1, 1), (1, 2, 2, 1), (2, 3, 0, 1)]


def test_topic_windows_have_their_own_anchor(spark):
    rows = spark.createDataFrame([("a", DAY), ("b", DAY + dt.timedelta(3)), ("b", DAY + dt.timedelta(4))], "topic string, event_date date")
    got = W.date_windows(rows, 2, 2, F.count("*").alias("n"), keys=["topic"]).orderBy("topic").collect()
    assert [(r.topic, r.window_start, r.window_index, r.n) for r in got] == [("a", DAY, 0, 1), ("b", DAY + dt.timedelta(3), 0, 2)]


def test_unknown_kinds_and_sizes(spark):
    with pytest.raises(ValueError):
        W.create_windows(frame(spark, [0]), "weekly")
    with pytest.raises(ValueError):
        W.assign_date_windows(frame(spark, [0]), 0)
    assert W.create_windows(frame(spark, [0, 3]), "tumbling", 2).count() == 2


def test_window_plan_has_no_range_join(spark):
    plan = W.date_windows(frame(spark, [0, 1]), 7, 1, F.count("*"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_never_sees_the_future(spark):
    q = spark.createDataFrame([(0, 1, DAY + dt.timedelta(2)), (0, 2, None)], "w long, q long, qd date")
    a = spark.createDataFrame([(0, i, DAY + dt.timedelta(i)) for i in range(5)] + [(1, 9, DAY)], "w long, a long, ad date")
    got = sorted((r.q, r.a) for r in J.as_of(q, a, ["w"], "qd", "ad").collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]


def test_suppliers_of_one_span_meet_its_days_once(spark, sf_dir, monkeypatch):
    real, seen = J.range_join, []
    monkeypatch.setattr(J, "range_join", lambda points, spans, *more: seen.append((points.select("day"), spans.select("start", "stop"))) or real(points, spans, *more))
    assert catalog.queries()["order_line_range_join"](spark, sf_dir).count()
    assert all(side.count() == side.distinct().count() for side in seen[0])


def test_name_pairs_cut_texts_once(spark, sf_dir):
    made = catalog.queries()["name_pairs"](spark, sf_dir)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_top_keywords_sort_no_words(spark):
    rows = spark.createDataFrame([("s", None, "zoo apple"), ("s", 1, "apple zoo bear"), (None, 3, "bear the cat"), (None, 2, "cat bear"), ("e", 4, "of")], "g string, id long, t string")
    made = etl.top_keywords(rows, "g", "t", 2, "id")
    assert "posexplode" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.g, r["rank"]): (r.word, r.n) for r in made.where("word <> 'unknown'").collect()}
    assert found == {("s", 1): ("zoo", 2), ("s", 2): ("apple", 2), (None, 1): ("cat", 2), (None, 2): ("bear", 2)}


def test_range_join(spark):
    p = spark.createDataFrame([(x,) for x in range(-20, 60, 3)], "x long")
    s = spark.createDataFrame([(0, -7, 5), (1, 4, 4), (2, 10, 55)], "id long, lo long, hi long")
    got = sorted((r.x, r.id) for r in J.range_join(p, s, "x", "lo", "hi", 8).collect())
    assert got == sorted((x, i) for x in range(-20, 60, 3) for i, lo, hi in ((0, -7, 5), (1, 4, 4), (2, 10, 55)) if lo <= x < hi)


def test_nearest_takes_the_first_on_a_tie(spark):
    q = spark.createDataFrame([(7, 1.0), (8, -1.0)], "q long, x double")
    t = spark.createDataFrame([(0, 2.0), (1, 2.0), (2, -3.0)], "t long, y double")
    got = J.nearest(q, t, "q", "t", F.col("x") * F.col("y"), shard=4).collect()
    assert sorted((r.q, r.t, r.similarity) for r in got) == [(7, 0, 2.0), (8, 2, 3.0)]


def test_runs(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "a")], "q string, at long, v string")
    b = spark.createDataFrame([("x", 5, "b"), ("z", 1, "c")], "q string, at long, v string")
    assert [tuple(r) for r in J.intersect_runs(a, b, ["q"], "at", "v").collect()] == [("x", "new", "b")]
    pairs = {r.q: r.intersection for r in J.pair_runs(a.select("q").distinct(), b.select("q"), ["q"]).collect()}
    assert pairs == {"x": True, "y": False, "z": False}


def test_prefix_references_prefer_the_exact_id(spark):
    m = spark.createDataFrame([("a1",), ("a",), ("q",)], "m string")
    r = spark.createDataFrame([("a12", 0), ("a1", 1), ("b", 2)], "r string, at long")
    assert {x.m: x.r for x in J.exact_then_prefix(m, r, "m", "r", "at").collect()} == {"a1": "a1", "a": "a12", "q": None}


def test_zip_new_rows_and_backfill(spark):
    z = spark.createDataFrame([(["u", "v", "w"], ["x"])], "urls array<string>, texts array<string>").select(J.zip_pairs("urls", "texts").alias("z")).first().z
    assert [tuple(x) for x in z] == [("u", "x")]
    c = spark.createDataFrame([("u", 1), ("n", 2), ("n", 3)], "url string, at long")
    assert [tuple(x) for x in J.new_rows(c, c.where("url = 'u'"), "url", "at").collect()] == [("n", 2)]
    b = J.backfill(spark.createDataFrame([("k", ""), ("l", "has")], "k string, t string"), spark.createDataFrame([("k", "got"), ("l", "x")], "k string, t string"), "k", ["t"])
    assert dict(map(tuple, b.collect())) == {"k": "got", "l": "has"}
