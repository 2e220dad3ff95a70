"""What the reviewer's odd inputs and larger tables showed."""

from __future__ import annotations

import datetime as dt

from tidemark import catalog
from tidemark.plans import tasks


def test_scrape_counters_count_by_number_as_the_sql(spark, tmp_path):
    import duckdb

    rows = [(i, "" if i % 5 == 1 else None if i % 5 == 2 else "text") for i in range(200)] + [(None, "text"), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["scrape_counters"](spark, str(tmp_path)).first()
    sql = catalog.oracle_sql()["scrape_counters"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert tuple(found) == duckdb.sql(sql).fetchall()[0]


def test_temporal_qa_answers_all_questions_of_a_window(spark):
    day = dt.date(2024, 1, 1)
    schema = "window_index long, question_id long, question_date date, question string, choices map<string,string>, answer string, question_type string"
    asked = spark.createDataFrame([(0, i, day + dt.timedelta(i % 3), f"q {i}", {"a": "x"}, "a", None) for i in range(25)] + [(1, None, day, "q", {"a": "x"}, "a", None)], schema)
    articles = spark.createDataFrame([(0, i, day + dt.timedelta(i), f"text {i}") for i in range(3)], "window_index long, article_id long, article_date date, text string")
    found = tasks.temporal_qa(asked, articles, 100)
    assert sorted((r.window_index, -1 if r.question_id is None else r.question_id, r.n_articles) for r in found.collect()) == sorted([(0, i, i % 3 + 1) for i in range(25)] + [(1, -1, 0)])
    assert tasks.temporal_qa(asked, articles, 100, cap=4).where("window_index = 0").count() == 4


def test_packed_counts_are_those_of_the_rows_and_so_are_products(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import packed_texts, word_vectors
    from tidemark.sources.written import Scratch

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) % 40),) for _ in range(50)] + [(None,), ("",), ("w1",)], "text string").repartition(3)
    scratch, blocks = Scratch(spark), 3
    words = scratch.write(word_vectors.vocabulary(docs, "text", 3).select("word", "n", F.xxhash64("word").alias("h")), "v")
    own = words.select("word", "h").collect()
    by = {b: sorted(r.h for r in own if r.h % blocks == b) for b in range(blocks)}
    ids = {r.word: ((r.h % blocks) << packed_texts.RANK) + by[r.h % blocks].index(r.h) for r in own}
    words = spark.createDataFrame([(r.word, r.h, ids[r.word]) for r in own], "word string, h long, id long")
    packed = packed_texts.packed_counts(scratch, docs.select(word_vectors.hashes(F.col("text")).alias("t")), words, blocks, 2)
    found = word_vectors.positive_pmi(word_vectors.cooccurrence(docs, "text", words, 2)).collect()
    order = {w: i for i, w in enumerate(sorted(ids.values()))}
    dense, tall = np.zeros((len(order),) * 2), rng.normal(size=(len(order), 2))
    for r in found:
        dense[order[r.w], order[r.c]] = r.x
    times = packed_texts.pmi_product(packed, packed_texts.degrees(scratch, packed), blocks)
    made = times(spark.createDataFrame([(w, *map(float, tall[i])) for w, i in order.items()], "w long, v0 double, v1 double"), 2)
    assert len({r.w >> packed_texts.RANK for r in found}) == blocks
    got = {r.w: (r.v0, r.v1) for r in made.collect()}
    assert np.allclose([got.get(w, (0, 0)) for w in order], dense @ tall)


def test_token_match_shuffles_no_vectors_of_texts(spark):
    import numpy as np
    import pytest

    from tidemark.operators import word_vectors

    rng = np.random.default_rng(8)
    vectors = {f"w{i}": [float(x) for x in rng.normal(size=4)] for i in range(9)}
    words = spark.createDataFrame([(w, 5, 0.1, v) for w, v in vectors.items()], "word string, n long, share double, vector array<double>")
    rows = [(f"k{i}", " ".join(f"w{x}" for x in rng.integers(0, 12, 8)), " ".join(f"w{x}" for x in rng.integers(0, 12, 3))) for i in range(30)] + [("none", None, "w1"), (None, "w1 w2", "w1")]
    found = word_vectors.matched_tokens(spark.createDataFrame(rows, "k string, a string, b string"), "k", "a", "b", words)
    assert "vector" not in found._jdf.queryExecution().optimizedPlan().toString()
    unit = {w: np.array(v) / np.linalg.norm(v) for w, v in vectors.items()}
    got = {r.k: r for r in found.collect()}
    for k, a, b in rows:
        x, y = ([unit[w] for w in (t or "").split() if w in unit] for t in (a, b))
        near = np.array([[p @ q for q in y] for p in x])
        p, r = (max(0.0, near.max(1).mean()), max(0.0, near.max(0).mean())) if x and y else (0.0, 0.0)
        assert (got[k].precision, got[k].recall) == pytest.approx((p, r))


def test_density_holds_distances_of_neighbours_only():
    import tracemalloc

    import numpy as np

    from tidemark.operators import density

    rng = np.random.default_rng(2)
    strip = np.arange(3000), rng.normal(size=(3000, 4)) / 9
    tracemalloc.start()
    held = list(density.nearest_others(strip, strip, 5, True))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert sum(len(k) for k, _ in held) == 3000 and kept < 2_000_000  # all distances are 72 MB
    keys = np.arange(40_000)
    edges = (rng.random(39_999), keys[:-1], keys[1:])
    tracemalloc.start()
    labels = density.stable_clusters(keys, edges, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 40_000 and peak < 16_000_000 + 24 * 40_000


def test_distinctiveness_meets_lists_of_summaries(spark):
    from tidemark.plans import summary_metrics as sm

    rows = [(i, f"t{i % 3}", sorted({f"w{i % 7}", "a", f"r{i % 5}"}) if i % 6 else [], ["a", f"r{i % 4}"] if i % 5 else []) for i in range(40)]
    held = spark.createDataFrame(rows, "w long, topic string, h array<string>, r array<string>").repartition(3)
    made = sm.distinctiveness(held, "w", "topic", "h", "r", sm.jaccard)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_intersect" not in plan[plan.index("MapInArrow") :]
    slow = sm.distinctiveness(held, "w", "topic", "h", "r", lambda a, b: sm.jaccard(a, b))
    assert {r.w: round(r.distinctiveness, 6) for r in made.collect()} == {r.w: round(r.distinctiveness, 6) for r in slow.collect()}
