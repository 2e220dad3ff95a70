"""Parsing of answers, accuracy breakdowns, judges, agreement, run pairing and clustering metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import joins, windows
from ..plans import clustering_metrics as cm
from ..plans import qa_metrics as qa
from ..sources.tables import dated_events, read


def qa_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in several spellings, made of the letters of turns."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("conv_id") % 4 + 1).cast("int"))
    forms = [F.concat(F.lit("Answer: "), letter), F.concat(F.lit("So the option is "), letter, F.lit(", not A")), (F.col("conv_id") % 5).cast("string"), F.lit(""), F.concat(F.lit("Option ("), letter, F.lit(").")),
             F.concat((F.col("conv_id") % 4 + 1).cast("string"), F.lit(") yes")), F.concat(F.lit("  "), F.lower(letter)), F.concat(F.lit("We say ANSWER: "), letter), F.substring("text", 1, 40)]
    response = F.element_at(F.array(*forms), ((F.col("conv_id") + F.col("turn")) % len(forms) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.answer_letter(response).alias("letter"))


def qa_answer_parse_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.groupBy("role", parsing.answer_letter(F.col("text")).alias("letter")).agg(F.count("*").alias("n"))


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answers made of labels, in a code block, bare, unreadable or without criteria."""
    said = lambda c: F.when(F.col(c) == 1, "true").otherwise("false")
    bare = F.concat(F.lit('{"criteria":[{"is_satisfied":'), said("quality"), F.lit('},{"is_satisfied":'), said("toxic"), F.lit("}]"))
    forms = [F.concat(F.lit("```json\n"), bare, F.lit(',"score":2}\n```')), F.concat(bare, F.lit("}")), F.lit("garbage"), F.lit('{"score":2}')]
    response = F.element_at(F.array(*forms), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "labels").select("doc_id", parsing.judge_score(response).cast("long").alias("score"))


def cluster_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of clusters made of events, in several spellings."""
    n, w = F.col("user_id").cast("string"), F.col("event_type")
    forms = [F.concat(F.lit("("), n, F.lit(", ['"), w, F.lit("', \"y\"])")), F.concat(F.lit("```python\n("), n, F.lit(", ['a "), w, F.lit("'])\n```")), F.lit("none"),
             F.concat(F.lit("Cluster: "), n, F.lit(", keywords: [p, "), w, F.lit("]")), F.concat(F.lit("I say "), n), F.lit("(-1, [])")]
    c = parsing.cluster_choice(F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int")))
    return read(spark, sf_dir, "events").select("event_id", c["cluster"].cast("long").alias("cluster"), F.array_join(c["keywords"], "|").alias("keywords"))


def question_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.groupBy(parsing.question_type(F.col("text")).alias("question_type")).agg(F.count("*").alias("n"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as questions: the truth is the quality, the prediction a rule on length."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    letter = lambda c: F.when(c, "A").otherwise("B")
    rows = rows.withColumns({"truth": letter(F.col("quality") == 1), "predicted": F.when(F.col("doc_id") % 19 != 0, letter(F.col("n_chars") < 6000)), "question_type": F.when(F.col("lang") != "es", F.col("lang")), "confidence": F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 10) / 10.0)})
    return rows.withColumn("is_correct", F.coalesce(F.col("truth") == F.col("predicted"), F.lit(False)))


def qa_accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.overall(_predictions(spark, sf_dir), "is_correct").withColumn("accuracy", F.round("accuracy", 6))


def structured_use_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers count as using structured data by the length of their document; every seventh has no mark."""
    rows = _predictions(spark, sf_dir).withColumn("used", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") > 2000))
    return qa.structured_use(rows, "used").withColumn("rate", F.round("rate", 6))


def qa_accuracy_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.by(_predictions(spark, sf_dir), F.col("question_type"), "is_correct", "question_type").withColumn("accuracy", F.round("accuracy", 6))


def qa_answer_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.answer_distribution(_predictions(spark, sf_dir), "predicted", "truth")


def qa_response_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qa.response_stats(_predictions(spark, sf_dir), "text", "confidence")
    return out.withColumns({"mean_words": F.round("mean_words", 6), "mean_confidence": F.round("mean_confidence", 6)})


def qa_temporal_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.element_at(F.array(*[F.lit(x) for x in ("What came before X and after Y?", "When was it?", "Who?", "During which year?", "How long?")]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 5 == 4, F.lit("duration"))
    rows = _predictions(spark, sf_dir).select("is_correct", cycle.alias("question"), kind.alias("kind"))
    return qa.by_aspect(rows, "question", "kind", "is_correct").withColumn("accuracy", F.round("accuracy", 6))


def qa_window_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir).withColumn("window", (F.col("doc_id") % 7).cast("string"))
    return qa.by(rows, F.col("window"), "is_correct", "window").withColumn("accuracy", F.round("accuracy", 6))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels")
    return rows.withColumns({"question_score": (F.col("doc_id") % 3).cast("int"), "answer_score": F.col("quality") * 2, "choice_score": F.col("quality") + F.col("toxic"), "human_q": (F.col("doc_id") % 4).cast("int"), "human_a": F.col("quality") + F.lit(1), "human_c": F.col("quality")})


def judge_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qa.score_distribution(_scores(spark, sf_dir), ["question_score", "answer_score", "choice_score"])
    return out.withColumn("score", F.col("score").cast("long"))


def human_llm_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = qa.agreement(_scores(spark, sf_dir), ["human_q", "human_a", "human_c"], ["question_score", "answer_score", "choice_score"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("agree_")})


def perfect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("question_score = 2 AND answer_score = 2 AND choice_score = 2").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def structural_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn("topic", F.col("conv_id") % 10)
    user = (F.col("role") == "user").cast("int")
    return qa.structural_statistics(turns, "topic", "conv_id", F.lit(1), user, (user * (F.col("turn") == 0).cast("int")))


def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = lambda k: F.when(F.col("doc_id") % k == 0, "No").when(F.col("doc_id") % k == 1, "yes, mostly").otherwise("Yes")
    raw = F.to_json(F.struct(*[answer(i + 2).alias(c) for i, c in enumerate(parsing.RUBRIC[:4])]))
    rows = read(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("is_struct"), parsing.rubric_score(raw).alias("r"))
    return rows.groupBy("is_struct").agg(F.count("*").alias("n"), *[F.round(F.avg(f"r.{c}"), 6).alias(c) for c in (*parsing.RUBRIC, "overall")])


def choice_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as choices: conversations whose first four turns are four distinct texts."""
    turns = read(spark, sf_dir, "conversations").where("turn < 4").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    choices = F.transform("x", lambda s: s["text"])
    return turns.select("conv_id", parsing.valid_choices(choices).alias("valid"), F.array_join(parsing.structural_reasons(F.lit("q"), choices, F.when(F.col("conv_id") % 5 != 0, "a")), ";").alias("reasons"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("question"), "event_id", "value")
    return events.where("event_id % 3 = 0"), events.where("event_id % 3 > 0")


def paired_run_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _runs(spark, sf_dir)
    return joins.intersect_runs(a, b, ["question"], "event_id", "value")


def run_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _runs(spark, sf_dir)
    side = lambda r, n: joins.last_per_key(r, ["question"], "event_id").select("question", F.col("event_id").alias(n))
    paired = joins.pair_runs(side(a, "id_a"), side(b, "id_b"), ["question"])
    return paired.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("id_a", "id_b")})


def export_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumns({"year": F.year("ts").cast("long"), "model": F.col("event_type"), "story": F.col("user_id") % 3})
    out = qa.export_rollup(events, ["year", "model", "story"], "value").withColumn("mean", F.round("mean", 4))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("year", "model", "story")})


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 13 == 0, "boom").alias("error"))
    return qa.run_summary(rows, "error").withColumn("success_rate", F.round("success_rate", 6))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_events(spark, sf_dir).select("event_date", "event_id", F.col("event_type").alias("truth"), ((F.col("user_id") * 7 + F.floor(F.col("value"))) % 6).cast("long").alias("predicted"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.contingency(_clusters(spark, sf_dir), "truth", "predicted")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def b3_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cm.b_cubed(_cells(spark, sf_dir)), "precision", "recall", "f1")


def nmi_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.mutual_information(_cells(spark, sf_dir)).select(*[F.round(c, 8).alias(c) for c in ("mi", "h_true", "h_pred", "nmi")])


def ami_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.adjusted(_cells(spark, sf_dir)).select(F.round("emi", 8).alias("emi"), F.round("ami", 6).alias("ami"))


def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.adjusted_rand(_cells(spark, sf_dir)).select(F.round("ari", 8).alias("ari"))


def window_b3_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = windows.window_events(_clusters(spark, sf_dir), 7, 7)
    return _rounded(cm.b_cubed(cm.contingency(held, "truth", "predicted", ["window_index"]), ["window_index"]), "precision", "recall", "f1")


def window_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cm.macro(window_b3_metrics(spark, sf_dir), "precision", "recall", "f1"), "precision", "recall", "f1")


QUERIES = {f.__name__: f for f in (
    qa_answer_parse, qa_answer_parse_turns, judge_scores, cluster_choices, question_type_classify, qa_accuracy_overall, structured_use_rate, qa_accuracy_by_type, qa_answer_distribution, qa_response_stats, qa_temporal_aspect, qa_window_accuracy,
    judge_score_distribution, human_llm_agreement, perfect_scores, structural_statistics, rubric_scores, choice_sanity, paired_run_intersection, run_pairing, export_rollup, run_summary,
    b3_metrics, nmi_metrics, ami_metrics, adjusted_rand, window_b3_metrics, window_macro_metrics,
)}

_PRED = """p AS (SELECT *, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS truth, CASE WHEN doc_id % 19 <> 0 THEN CASE WHEN n_chars < 6000 THEN 'A' ELSE 'B' END END AS predicted FROM labels JOIN documents USING (doc_id)),
q AS (SELECT *, coalesce(truth = predicted, false) AS ok FROM p)"""
_CLUST = "k AS (SELECT CAST(ts AS DATE) AS d, event_type AS t, CAST((user_id * 7 + floor(value)) % 6 AS BIGINT) AS p FROM events)"
_CONT = f"{_CLUST}, c AS (SELECT t, p, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT *, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) AS a, CAST(sum(n) OVER (PARTITION BY p) AS DOUBLE) AS b, CAST(sum(n) OVER () AS DOUBLE) AS total FROM c)"
_INFO = f"""{_CONT}, i AS (SELECT sum(n / total * ln(n * total / (a * b))) AS mi FROM m), u AS (SELECT -sum(a / total * ln(a / total)) AS h_true FROM (SELECT DISTINCT t, a, total FROM m)), v AS (SELECT -sum(b / total * ln(b / total)) AS h_pred FROM (SELECT DISTINCT p, b, total FROM m))"""
_B3W = f"""{_CLUST}, lo AS (SELECT min(d) AS lo FROM k), w AS (SELECT t, p, datediff('day', lo, d) // 7 AS w FROM k, lo), c AS (SELECT w, t, p, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY w, t) AS a, sum(n) OVER (PARTITION BY w, p) AS b, sum(n) OVER (PARTITION BY w) AS total FROM c),
s AS (SELECT w, sum(n * n / b) / first(total) AS p, sum(n * n / a) / first(total) AS r, CAST(first(total) AS BIGINT) AS n_items, count(DISTINCT t) AS n_true, count(DISTINCT m.p) AS n_predicted FROM m GROUP BY w),
z AS (SELECT row_number() OVER (ORDER BY w) - 1 AS window_index, round(p, 6) AS precision, round(r, 6) AS recall, n_items, n_true, n_predicted, round(2 * p * r / (p + r), 6) AS f1 FROM s)"""
_KINDS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in parsing.QUESTION_TYPES) + " ELSE 'other' END"
_RUBRIC = ", ".join(f"CASE WHEN doc_id % {i + 2} = 0 THEN 0.0 ELSE 1.0 END AS {c}" for i, c in enumerate(parsing.RUBRIC[:4]))
_RUN = "r AS (SELECT event_type || '-' || CAST(user_id % 50 AS VARCHAR) AS question, event_id, value FROM events)"
_LAST = "{0} AS (SELECT question, event_id, value FROM r WHERE event_id % 3 {1} QUALIFY row_number() OVER (PARTITION BY question ORDER BY event_id DESC) = 1)"
_SCORE = "s AS (SELECT doc_id, doc_id % 3 AS q, quality * 2 AS a, quality + toxic AS c, doc_id % 4 AS hq, quality + 1 AS ha, quality AS hc FROM labels)"

_LETTER = r"""CASE WHEN substr(r, 1, 1) IN ('A', 'B', 'C', 'D') THEN substr(r, 1, 1) WHEN regexp_extract(r, 'ANSWER:\s*([ABCD])', 1) <> '' THEN regexp_extract(r, 'ANSWER:\s*([ABCD])', 1)
WHEN regexp_matches(r, '\bA\b') THEN 'A' WHEN regexp_matches(r, '\bB\b') THEN 'B' WHEN regexp_matches(r, '\bC\b') THEN 'C' WHEN regexp_matches(r, '\bD\b') THEN 'D'
WHEN substr(r, 1, 1) IN ('1', '2', '3', '4') THEN translate(substr(r, 1, 1), '1234', 'abcd') ELSE 'A' END"""
ORACLE = {
    "qa_answer_parse": rf"""
WITH c AS (SELECT *, substr('ABCD', CAST(conv_id % 4 + 1 AS INT), 1) AS l FROM conversations),
f AS (SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'Answer: ' || l WHEN 1 THEN 'So the option is ' || l || ', not A' WHEN 2 THEN CAST(conv_id % 5 AS VARCHAR) WHEN 3 THEN '' WHEN 4 THEN 'Option (' || l || ').'
    WHEN 5 THEN CAST(conv_id % 4 + 1 AS VARCHAR) || ') yes' WHEN 6 THEN '  ' || lower(l) WHEN 7 THEN 'We say ANSWER: ' || l ELSE substr(text, 1, 40) END AS x FROM c),
u AS (SELECT conv_id, turn, upper(trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS r FROM f) SELECT conv_id, turn, {_LETTER} AS letter FROM u""",
    "qa_answer_parse_turns": rf"""
WITH u AS (SELECT role, upper(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS r FROM conversations)
SELECT role, {_LETTER} AS letter, count(*) AS n FROM u GROUP BY ALL""",
    "judge_scores": "SELECT doc_id, CAST(CASE WHEN doc_id % 4 < 2 THEN CAST(quality = 1 AS INT) + CAST(toxic = 1 AS INT) ELSE 0 END AS BIGINT) AS score FROM labels",
    "cluster_choices": """
SELECT event_id, CASE WHEN event_id % 6 IN (2, 5) THEN -1 ELSE user_id END AS cluster, CASE event_id % 6 WHEN 0 THEN event_type || '|y' WHEN 1 THEN 'a ' || event_type WHEN 3 THEN 'p|' || event_type ELSE '' END AS keywords FROM events""",
    "question_type_classify": f"SELECT {_KINDS} AS question_type, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "qa_accuracy_overall": f"WITH {_PRED} SELECT count(*) AS total, count(*) FILTER (ok) AS correct, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM q",
    "structured_use_rate": "SELECT count(*) AS total, count(*) FILTER (doc_id % 7 <> 0 AND n_chars > 2000) AS used, round(avg(CAST(doc_id % 7 <> 0 AND n_chars > 2000 AS INT)), 6) AS rate FROM labels JOIN documents USING (doc_id)",
    "qa_accuracy_by_type": f"WITH {_PRED} SELECT CASE WHEN lang = 'es' THEN 'unknown' ELSE lang END AS question_type, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM q GROUP BY 1",
    "qa_answer_distribution": f"WITH {_PRED}, s AS (SELECT 'predicted' AS side, coalesce(predicted, 'N/A') AS answer FROM q UNION ALL SELECT 'true', truth FROM q) SELECT side, answer, count(*) AS n FROM s GROUP BY ALL",
    "qa_response_stats": rf"""
WITH {_PRED}, w AS (SELECT CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 10) / 10.0 END AS c FROM q)
SELECT round(avg(n), 6) AS mean_words, min(n) AS min_words, max(n) AS max_words, round(avg(CAST(c AS DOUBLE)), 6) AS mean_confidence, count(c) AS n_confidence FROM w""",
    "qa_temporal_aspect": f"""
WITH {_PRED}, a AS (SELECT unnest(CASE doc_id % 5 WHEN 0 THEN ['before', 'after'] WHEN 1 THEN ['when'] WHEN 3 THEN ['during'] WHEN 4 THEN ['duration'] ELSE [] END) AS aspect, ok FROM q)
SELECT aspect, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM a GROUP BY aspect""",
    "qa_window_accuracy": f"WITH {_PRED} SELECT CAST(doc_id % 7 AS VARCHAR) AS \"window\", count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM q GROUP BY 1",
    "judge_score_distribution": f"""
WITH {_SCORE}, l AS (SELECT unnest(['question_score', 'answer_score', 'choice_score']) AS score_name, unnest([q, a, c]) AS v FROM s), g AS (SELECT score_name, unnest([2, 1, 0]) AS score FROM (SELECT DISTINCT score_name FROM l))
SELECT g.score_name, CAST(score AS BIGINT) AS score, round_even(100.0::DOUBLE * count(*) FILTER (v = score) / count(*), 2) AS percent FROM g JOIN l ON l.score_name = g.score_name GROUP BY ALL""",
    "human_llm_agreement": f"""
WITH {_SCORE}, e AS (SELECT CAST(q = hq AS INT) AS x, CAST(a = ha AS INT) AS y, CAST(c = hc AS INT) AS z FROM s)
SELECT count(*) AS n, count(*) FILTER (x + y + z = 3) AS "full", count(*) FILTER (x + y + z IN (1, 2)) AS "partial", count(*) FILTER (x + y + z = 0) AS "none", round(avg(x), 6) AS agree_human_q, round(avg(y), 6) AS agree_human_a, round(avg(z), 6) AS agree_human_c FROM e""",
    "perfect_scores": f"WITH {_SCORE} SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM s WHERE q = 2 AND a = 2 AND c = 2",
    "structural_statistics": """
WITH s AS (SELECT count(DISTINCT conv_id % 10) AS t, count(DISTINCT conv_id) AS e, count(*) AS n, count(*) FILTER (role = 'user') AS q, count(*) FILTER (role = 'user' AND turn = 0) AS k FROM conversations)
SELECT t AS n_topics, e AS n_events, n AS n_articles, q AS n_questions, round_even(q / t, 2) AS per_topic, round_even(q / e, 2) AS per_event, round_even(k / q, 3) AS type_ratio FROM s""",
    "rubric_scores": f"""
WITH r AS (SELECT toxic = 1 AS is_struct, {_RUBRIC} FROM labels) SELECT is_struct, count(*) AS n, round(avg(relevance)::DOUBLE, 6) AS relevance, round(avg(coverage)::DOUBLE, 6) AS coverage, round(avg(consistency)::DOUBLE, 6) AS consistency, round(avg(fluency)::DOUBLE, 6) AS fluency,
0.0::DOUBLE AS conciseness, round(avg((relevance + coverage + consistency + fluency) / 5)::DOUBLE, 6) AS overall FROM r GROUP BY is_struct""",
    "choice_sanity": """
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations WHERE turn < 4 GROUP BY conv_id), v AS (SELECT conv_id, len(x) = 4 AND len(list_distinct(x)) = 4 AND len(list_filter(x, lambda t: trim(t) = '')) = 0 AS valid FROM c)
SELECT conv_id, valid, CASE WHEN valid THEN CASE WHEN conv_id % 5 = 0 THEN 'missing answer' ELSE '' END ELSE CASE WHEN conv_id % 5 = 0 THEN 'invalid choices;missing answer' ELSE 'invalid choices' END END AS reasons FROM v""",
    "paired_run_intersection": f"WITH {_RUN}, {_LAST.format('a', '= 0')}, {_LAST.format('b', '> 0')} SELECT question, a.value AS value_a, b.value AS value_b FROM a JOIN b USING (question)",
    "run_pairing": f"WITH {_RUN}, {_LAST.format('a', '= 0')}, {_LAST.format('b', '> 0')} SELECT question, coalesce(a.event_id, -1) AS id_a, coalesce(b.event_id, -1) AS id_b, a.event_id IS NOT NULL AND b.event_id IS NOT NULL AS intersection FROM a FULL JOIN b USING (question)",
    "export_rollup": "WITH e AS (SELECT year(ts) AS year, event_type AS model, user_id % 3 AS story, value FROM events) SELECT coalesce(CAST(year AS VARCHAR), 'all') AS year, coalesce(model, 'all') AS model, coalesce(CAST(story AS VARCHAR), 'all') AS story, mean, n FROM (SELECT year, model, story, round(avg(value), 4) AS mean, count(*) AS n FROM e GROUP BY ROLLUP (year, model, story))",
    "run_summary": "SELECT count(*) FILTER (event_id % 13 <> 0) AS successful, count(*) FILTER (event_id % 13 = 0) AS failed, round(avg(CAST(event_id % 13 <> 0 AS INT)), 6) AS success_rate FROM events",
    "b3_metrics": f"""
WITH {_CONT}, s AS (SELECT sum(n * n / b) / first(total) AS p, sum(n * n / a) / first(total) AS r, CAST(first(total) AS BIGINT) AS n_items, count(DISTINCT t) AS n_true, count(DISTINCT m.p) AS n_predicted FROM m)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, n_items, n_true, n_predicted, round(2 * p * r / (p + r), 6) AS f1 FROM s""",
    "nmi_metrics": f"WITH {_INFO} SELECT round(mi, 8) AS mi, round(h_true, 8) AS h_true, round(h_pred, 8) AS h_pred, round(2 * mi / (h_true + h_pred), 8) AS nmi FROM i, u, v",
    "ami_metrics": f"""
WITH {_INFO}, pa AS (SELECT a, total, count(*) AS ma FROM (SELECT DISTINCT t, a, total FROM m) GROUP BY ALL), pb AS (SELECT b, count(*) AS mb FROM (SELECT DISTINCT p, b FROM m) GROUP BY ALL),
x AS (SELECT a, b, total AS nn, ma, mb, CAST(unnest(range(CAST(greatest(1, a + b - total) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS k FROM pa, pb),
e AS (SELECT sum(ma * mb * k / nn * ln(nn * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(nn - a + 1) + lgamma(nn - b + 1) - lgamma(nn + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(nn - a - b + k + 1))) AS emi FROM x)
SELECT round(emi, 8) AS emi, round((mi - emi) / ((h_true + h_pred) / 2 - emi), 6) AS ami FROM i, u, v, e""",
    "adjusted_rand": f"""
WITH {_CONT}, s AS (SELECT sum(n * (n - 1) / 2) AS x, first(total * (total - 1) / 2) AS z FROM m), u AS (SELECT sum(a * (a - 1) / 2) AS u FROM (SELECT DISTINCT t, a FROM m)), v AS (SELECT sum(b * (b - 1) / 2) AS v FROM (SELECT DISTINCT p, b FROM m))
SELECT round((x - u * v / z) / ((u + v) / 2 - u * v / z), 8) AS ari FROM s, u, v""",
    "window_b3_metrics": f"WITH {_B3W} SELECT * FROM z",
    "window_macro_metrics": f"WITH {_B3W} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n_windows FROM z",
}
