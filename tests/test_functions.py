"""Scalar functions: golden cases for text, dates, parsers, sampling, stems and sequence metrics."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, models, parsing, qa_generation, stemming, text
from tidemark.operators import sampling, similarity
from tidemark.plans import summary_metrics as sm
from tidemark.plans import tasks
from tidemark.sources import written


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("x")).first().x


C = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns can be made only once there is a session."""
    global C
    C = F.col("c")


@pytest.mark.parametrize("raw,expected", [
    ("One sentence is here. And more words", "One sentence is here."), ("no sentence but words here and there now", "no sentence but words..."), ("x" * 40, "x" * 25 + "..."), ("short", "short"),
])
def test_smart_truncate(spark, raw, expected):
    assert one(spark, text.smart_truncate(C, 25), raw) == expected


def test_budgets(spark):
    texts = ["a" * 40, "b" * 40, "c" * 40]
    assert one(spark, text.greedy_budget(C, 15), texts, "array<string>") == ["a" * 40, "b" * 20]
    assert one(spark, text.greedy_budget(C, 10), texts, "array<string>") == ["a" * 40]
    assert one(spark, text.greedy_budget(C, 99), texts, "array<string>") == texts
    assert one(spark, text.greedy_budget(C, 9), [], "array<string>") == []
    cut = one(spark, text.equal_share_budget(C, 10), texts, "array<string>")
    assert [len(t) - 3 for t in cut] == [16, 12, 12]
    assert one(spark, text.equal_share_budget(C, 30), texts, "array<string>") == texts


def test_text_cleaning(spark):
    assert one(spark, text.clean_summary(C), " a\\n b\n\tc d ") == "a b c d"
    assert one(spark, text.metric_text(C), "Ab-C,  1é2!") == "ab c 1 2"
    assert one(spark, text.without_references(C), "x[1] y[22][a]") == "x y[a]"
    assert one(spark, text.without_result_kind(C), "Impact:  Status: up ") == "Status: up"
    assert one(spark, text.preview(C, 3), "abcd") == "abc..." and one(spark, text.preview(C, 4), "abcd") == "abcd"
    assert one(spark, text.cap_words(C, 2), "a b c") == "a b..." and one(spark, text.word_count(C), " a  b c ") == 3
    assert one(spark, text.folder_name(C), "org/model-1.5") == "org_model-1_5"
    assert one(spark, text.truncated_cues(C, 8), ["abcdef", "b", "c", "d"], "array<string>") == ["ab...", "b", "c"]
    assert text.shrunk_length(100_000) // 2 <= 7000 and text.shrunk_length(10) == 10 and text.shrunk_length(600, 100) == 500
    assert len(one(spark, text.shrunk_prompt(C), "x" * 20_000)) <= 14_000
    assert one(spark, text.proper_nouns(C), "The city of Paris met Ana. Then it ended") == ["Paris", "Ana"]


@pytest.mark.parametrize("raw,expected", [("Dec 3, 2024", "2024-12-03"), ("3 December 2024", "2024-12-03"), ("2024/12/3", "2024-12-03"), ("March 2024", "2024-03-01"), ("n/a", None), ("", None), ("2024-02-30", None), ("Retrieved 5 May 2020.", "2020-05-05")])
def test_free_dates(spark, raw, expected):
    got = one(spark, dates.free_date(C), raw)
    assert (str(got) if got else None) == expected


def test_other_dates(spark):
    assert one(spark, dates.strict_date(C), "2024-1-5") == dt.date(2024, 1, 5) and one(spark, dates.strict_date(C), "2024-13-01") is None and one(spark, dates.strict_date(C), "2024") is None
    assert one(spark, dates.heading_date(C), "2024_March_7") == "2024_03_07" and one(spark, dates.heading_date(C), "2024_Foo_7") is None
    assert one(spark, dates.underscored(C), "2024_01_02") == "2024-01-02" and one(spark, dates.underscored(C), "2024_01") == "2024_01"
    assert one(spark, dates.iso_timestamp(C), "2024-01-02T03:04:05Z") == dt.datetime(2024, 1, 2, 3, 4, 5)


@pytest.mark.parametrize("raw,expected", [("Because", "B"), ("Answer: C", "A"), ("The option is C, not A", "A"), ("2", "b"), ("", "A"), (None, "A"), ("It is ANSWER: d", "D"), ("(C)", "C")])
def test_answers(spark, raw, expected):
    assert one(spark, parsing.answer_letter(C), raw) == expected


@pytest.mark.parametrize("raw,expected", [("Oiment éauxtre éc", "C"), ("gege scher öb", "B"), ("ist cé", "C"), ("ist 1b_ bé2", "B"), ("ist xb b9 _b", "A")])
def test_answers_beside_accents(spark, raw, expected):
    assert one(spark, parsing.answer_letter(C), raw) == expected


def test_parsers(spark):
    choice = lambda r: tuple(one(spark, parsing.cluster_choice(C), r))
    assert choice("(3, ['x', \"y\"])") == (3, ["x", "y"]) and choice("```\n(1, [a])\n```") == (1, ["a"]) and choice("none") == (-1, [])
    assert one(spark, parsing.keyword_list(C), "[a, 'b c']") == ["a", "b c"] and one(spark, parsing.keyword_list(C), "of big cats") == ["big", "cats"] and one(spark, parsing.keyword_list(C), "1") == ["unknown"]
    assert one(spark, parsing.batch_answers(C, "|||", 3), "a ||| ||| b") == ["a", "b", ""] and one(spark, parsing.batch_answers(C, "|||", 1), "a|||b") == ["a"]
    assert [one(spark, parsing.judge_score(C), r) for r in ('```json\n{"criteria":[{"is_satisfied":true},{"is_satisfied":false}],"score":2}\n```', "garbage", '{"criteria":[{"is_satisfied":true},{"is_satisfied":true}]}')] == [1, 0, 2]
    rubric = one(spark, parsing.rubric_score(C), '{"relevance": "Yes, mostly", "coverage": "no"}')
    assert (rubric.relevance, rubric.coverage, rubric.fluency, rubric.overall) == (1, 0, 0, 0.2)
    assert [one(spark, parsing.valid_choices(C), v, "array<string>") for v in (["a", "b", "c", "d"], ["a", "a", "c", "d"], ["a", " ", "c", "d"], ["a"], None)] == [True, False, False, False, False]
    assert [one(spark, parsing.question_type(C), q) for q in ("Sometimes?", "Who is it", "Where", "Which one", "Why", "Eh")] == ["temporal", "person", "location", "factual", "causal", "other"]
    assert one(spark, parsing.same_answer(C, F.lit(" A ")), "a") and not one(spark, parsing.same_answer(C, F.lit("")), "")
    assert one(spark, parsing.legacy_choice(C), "assign 4") == 4 and one(spark, parsing.legacy_choice(C), "NEW_CLUSTER x") == -1
    assert one(spark, parsing.temporal_aspects(C, F.lit("duration")), "before and after") == ["before", "after", "duration"]


def test_greedy_dedup_keeps_the_first(spark):
    base = [f"w{i}" for i in range(40)]
    a, near, far = " ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[:-3] + ["x", "y", "z"])
    assert one(spark, similarity.greedy_dedup(C, 0.9), [a, near, far, a], "array<string>") == [0, 2]
    kept = one(spark, similarity.greedy_dedup(C, 0.9), [a, near, a, "other text"], "array<string>")
    assert kept == [0, 3]
    texts, urls = similarity.dedup_event(F.col("c"), F.array(F.lit("u"), F.lit("v")))
    assert one(spark, texts, [a, near, a], "array<string>") == [a, near, a] and one(spark, urls, [a, near, a], "array<string>") == ["u", "v"]
    assert one(spark, texts, [a, near], "array<string>") == [a] and one(spark, urls, [a, near], "array<string>") == ["u"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_sampling(spark):
    rows = spark.range(1087).select(F.col("id"), (F.col("id") % 7).alias("g"))
    assert sampling.exact_share(rows, ["id"], 0.1).count() == 108 and sampling.exact_share(rows.limit(3), ["id"], 0.1).count() == 1 and sampling.exact_share(rows.limit(0), ["id"], 0.1).count() == 0
    take = lambda df: sorted(r.id for r in sampling.per_group(df, ["g"], ["id"], 3).collect())
    assert take(rows) == take(rows.repartition(9)) and len(take(rows)) == 21
    assert {r["count"] for r in sampling.balanced(rows.where("g < 6 or id < 50"), "g", ["id"]).groupBy("g").count().collect()} == {7}
    assert one(spark, sampling.in_order(C, 5, 42, F.lit(1)), ["b", "a"], "array<string>") == ["b", "a"]
    mixed = one(spark, sampling.shuffled_choices(C, F.lit("p"), 42, F.lit(1)), ["p", "q", "r", "s"], "array<string>")
    assert sorted(mixed.choices) == ["p", "q", "r", "s"] and mixed.choices["abcd".index(mixed.answer)] == "p"


def test_questions(spark):
    made = one(spark, qa_generation.finished(F.lit("q"), F.lit("yes"), C, 42, F.lit(3)), ["yes", "no", "may", "be", "so"], "array<string>")
    assert len(made.choices) == 4 and made.choices[made.answer] == "yes" and made.reasons == []
    few = one(spark, qa_generation.finished(F.lit("q"), F.lit("yes"), C, 42, F.lit(3)), ["yes", "no"], "array<string>")
    assert few.choices is None and "invalid choices" in few.reasons


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("hopeful", "hope"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky")])
def test_stems(word, expected):
    assert stemming.stem(word) == expected


def test_sequence_metrics():
    assert sm.lcs("abcbdab", "bdcaba") == 4 and sm.lcs("", "a") == 0
    assert sm.rouge_n(["a", "b"], ["a", "c"], 1) == 0.5 and sm.rouge_n(["a"], ["a"], 2) == 0.0
    same = "the cat sat on the mat".split()
    assert sm.bleu(same, same) == pytest.approx(1) and sm.bleu([], same) == 0 and sm.bleu(["dog"], same) == 0
    assert 0 < sm.bleu("the cat".split(), same) < 0.2
    assert sm.meteor_exact_stem(same, same) == pytest.approx(1 - 0.5 / 6**3) and sm.meteor_exact_stem(["cats"], ["cat"]) == pytest.approx(0.5)
    assert sm.meteor_exact_stem(["x"], ["y"]) == 0


def test_plain_rouge_counts_within_rows(spark):
    rows = spark.createDataFrame([(1, "A b, a b a", "a b a b"), (2, None, "x"), (3, "", ""), (4, "a", "a")], "id long, h string, r string")
    scored = sm.rouge_n_plain(rows, "id", "h", "r", 2)
    assert {r.id: r.f for r in scored.collect()} == {1: pytest.approx(6 / 7), 2: 0.0, 3: 0.0, 4: 0.0}
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_all_metrics_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "The cats sat.", "the cat sits"), (2, None, "x"), (3, "", ""), (4, "a b c d e", "a b c d e")], "id long, h string, r string")
    scored = sm.evaluate_all(rows, "h", "r")
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert scored._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython [")[1].split("]")[0].count("run(") == 1
    for found in scored.collect():
        assert [found[m] for m in sm.SCORES] == [pytest.approx(fn(found.h, found.r)) for fn in sm.SCORES.values()]


def test_tables_are_written_in_small_batches(spark):
    sizes = spark.range(3000, numPartitions=1).mapInPandas(lambda batches: (b.assign(id=len(b)) for b in batches), "id long")
    before = spark.conf.get(written.BATCH_KEY, None)
    assert written.Scratch(spark).write(sizes, "sizes").agg({"id": "max"}).first()[0] <= 500
    assert spark.conf.get(written.BATCH_KEY, None) == before


def test_context_sorts_sizes_and_not_texts(spark):
    asked = spark.createDataFrame([(0, 1, dt.date(2024, 1, 2), "q", {"a": "x"}, "a", None)], "window_index long, question_id long, question_date date, question string, choices map<string,string>, answer string, question_type string")
    articles = spark.createDataFrame([(0, i, dt.date(2024, 1, 1) if i else None, f"text {i} " * 20) for i in range(9)] + [(0, 10, dt.date(2024, 1, 3), "late")], "window_index long, article_id long, article_date date, text string")
    made = tasks.temporal_qa(asked, articles, 100)
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Window [" in x and "_n#" in x)
    assert "line#" not in lines[at + 1]
    row = made.first()
    assert row.n_articles == 3 and row.error is None  # one without a date, one whole, one cut


def test_distinctiveness_shuffles_no_summaries(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}", [f"w{i}", "a"], ["a", f"r{i % 4}"]) for i in range(24)], "w long, topic string, h array<string>, r array<string>")
    made = sm.distinctiveness(rows, "w", "topic", "h", "r", sm.jaccard)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString() and "Join Cross" in made._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner\n", "Join Cross\n")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    held = rows.collect()
    refs = {(r.topic, tuple(r.r)) for r in held}
    for x, found in zip(held, made.orderBy("w").collect()):
        far = [1 - jac(x.h, r) for t, r in refs if t != x.topic]
        assert found.distinctiveness == pytest.approx(sum(far) / (len(far) * (1 - jac(x.h, x.r) + 1e-8)))


def test_summary_evolution(spark):
    rows = spark.createDataFrame([(1, "t", "a b", "a b"), (2, "t", "a b", "a c"), (3, "t", "c d", "c d")], "w long, topic string, h string, r string")
    prev = {r.w: r.previous for r in sm.previous(rows, "topic", "w", "h").collect()}
    lag = {r.w: r.previous for r in sm.previous(rows.where("w <> 2"), "topic", "w", "h", "lag").collect()}
    assert prev == {1: None, 2: "a b", 3: "a b"} and lag == {1: None, 3: "a b"}
    nov = sm.previous(rows, "topic", "w", "h").select("w", sm.novelty(F.col("h"), F.col("previous"), F.col("r")).alias("n"))
    assert {r.w: r.n for r in nov.collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    assert {r.distinctiveness for r in sm.distinctiveness(rows, "w", "topic", "h", "r").collect()} == {1.0}


def test_model_calls(spark):
    rows = spark.createDataFrame([(i, f"prompt {i}") for i in range(20)] + [(99, "boom")], "i long, p string")
    a = {r.i: (r.m.text, r.m.error) for r in rows.withColumn("m", models.generate("p", failing="boom", responses=("x", "y", "z"))).collect()}
    b = {r.i: (r.m.text, r.m.error) for r in rows.repartition(7).withColumn("m", models.generate("p", failing="boom", responses=("x", "y", "z"))).collect()}
    assert a == b and a[99][0] is None and "told to fail" in a[99][1] and len({v[0] for v in a.values()}) == 4
    with pytest.raises(ValueError):
        models.make_client("nope")
    v = rows.select(models.embed("p").alias("v")).first().v
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    m = spark.createDataFrame([("a b", "a b"), ("", "a")], "x string, y string").select(models.token_match("x", "y").alias("m")).collect()
    assert m[0].m == pytest.approx(1, abs=1e-6) and m[1].m == 0
    e = models.hashed_vector("a b")[None, :]
    assert models.greedy_match(e, e) == pytest.approx(1) and models.greedy_match(e, e[:0]) == 0
