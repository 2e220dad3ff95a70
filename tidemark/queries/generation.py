"""Summaries and their metrics, clustering by a model, question building, HTML tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html_tables, models, qa_generation
from ..functions.parsing import batch_answers, rubric_score
from ..functions.text import keywords
from ..operators import cluster_state, density, windows, word_vectors
from ..plans import summary_metrics as sm
from ..plans import ledger, questions, tasks
from ..sources import results
from ..sources.tables import articles, dated_events, read, spread, text_events
from ..sources.written import Scratch
from ..streaming import keyed_state, stateful
from ..streaming.folders import checkpoint_folder


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as the summary of the benchmark text of its number."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    n = items.agg(F.count("*")).scalar()
    keyed = spread(read(spark, sf_dir, "documents")).withColumn("item_id", F.col("doc_id") % n)
    return keyed.join(items, "item_id").select("doc_id", "item_id", F.col("source").alias("topic"), F.col("text").alias("hypothesis"), "reference")


def rouge1_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sm.rouge_n_plain(_pairs(spark, sf_dir), "doc_id", "hypothesis", "reference", 1)
    return Scratch(spark).write(scored.withColumn("f", F.round("f", 6)), "rouge")


def rouge2_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sm.rouge_n_plain(_pairs(spark, sf_dir), "doc_id", "hypothesis", "reference", 2)
    return Scratch(spark).write(scored.withColumn("f", F.round("f", 6)), "rouge")


def summary_sequence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sm.evaluate_all(_pairs(spark, sf_dir).select("doc_id", "hypothesis", "reference"), "hypothesis", "reference")
    return Scratch(spark).write(scored.select("doc_id", *[F.round(m, 6).alias(m) for m in sm.SCORES]), "scores")


def summary_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sm.evaluate_all(_pairs(spark, sf_dir).select("hypothesis", "reference"), "hypothesis", "reference").select(*sm.SCORES)
    return sm.averages(Scratch(spark).write(scored, "scores"))


def novelty_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sm.previous(_pairs(spark, sf_dir), "topic", "doc_id", "hypothesis")
    return rows.select("doc_id", F.round(sm.novelty(F.col("hypothesis"), F.col("previous"), F.col("reference")), 6).alias("novelty"), F.round(sm.token_similarity(F.col("hypothesis"), F.col("reference")), 6).alias("relevance"))


def distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumns({"h": sm.token_set(F.col("hypothesis")), "r": sm.token_set(F.col("reference"))})
    return sm.distinctiveness(rows, "doc_id", "topic", "h", "r", sm.jaccard).withColumn("distinctiveness", F.round("distinctiveness", 5))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents")).select("text").union(read(spark, sf_dir, "benchmark").select("text"))


def embedded_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of documents and references by vectors learned from both."""
    words = word_vectors.word_vectors(spark, _corpus(spark, sf_dir), "text")
    return word_vectors.text_similarity(_pairs(spark, sf_dir), "doc_id", "hypothesis", "reference", words).withColumn("similarity", F.round("similarity", 6))


def embedded_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of the tokens of documents and references by the same vectors."""
    words = word_vectors.word_vectors(spark, _corpus(spark, sf_dir), "text")
    found = word_vectors.matched_tokens(_pairs(spark, sf_dir), "doc_id", "hypothesis", "reference", words)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


def word_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive PMI of words of the references and of conversations that are up to three words apart."""
    docs = read(spark, sf_dir, "benchmark").select("text").union(read(spark, sf_dir, "conversations").select("text"))
    scratch = Scratch(spark)
    words = scratch.write(word_vectors.vocabulary(docs, "text", 3).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    found = word_vectors.positive_pmi(word_vectors.cooccurrence(docs, "text", words, 3))
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    return found.join(name("w"), "w").join(name("c"), "c").select(F.col("w_word").alias("word"), F.col("c_word").alias("context"), F.round("x", 6).alias("pmi"))


def density_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of vectors within each label."""
    return density.density_topics(spark, read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", min_size=5)


def seeded_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories whose first five days get topics and terms by density, and whose later documents go on from these clusters."""
    docs = articles(spark, sf_dir).withColumn("head", F.col("event_date") < F.lit("2024-01-06").cast("date"))
    words = word_vectors.word_vectors(spark, docs, "text")
    vectors = word_vectors.text_vectors(docs.where("head"), "doc_id", "text", words)
    heads = docs.where("head").select("topic", "doc_id", "text").join(vectors, "doc_id", "left").withColumnRenamed("topic", "story")
    scratch = Scratch(spark)
    topics = scratch.write(density.density_topics(spark, heads, "story", "doc_id", "vector", min_size=3, neighbours=2), "topics")
    terms = density.topic_terms(heads.select("doc_id", "text").join(topics, "doc_id"), "story", "topic", "text", 5)
    known = topics.join(terms, ["story", "topic"], "left").select("doc_id", F.col("topic").alias("known"), "terms")
    rows = docs.join(known, "doc_id", "left")
    return cluster_state.cluster_incrementally(rows, "topic", "doc_id", "text", ["event_date", "doc_id"], "head", topics=("known", "terms"))


def ledger_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all turns through a ledger, asked twice: the second time every answer is there already."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    path = f"{checkpoint_folder(spark)}/ledger"
    ledger.answered(spark, turns.where("turn % 2 = 0"), F.col("text"), path, max_tokens=20, temperature=0.0)
    found = ledger.answered(spark, turns, F.col("text"), path, max_tokens=20, temperature=0.0)
    return found.select("conv_id", "turn", F.md5("answer").alias("answer"), "answer_error")


def results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their counts as results of a run in two appends, and the head's and the rows' counts read back."""
    docs = spread(read(spark, sf_dir, "documents")).select("doc_id", "source", "text")
    path = f"{checkpoint_folder(spark)}/results"
    results.write_results(spark, docs.where("lang = 'en'").unionByName(docs.where("lang <> 'en'")).where("doc_id % 2 = 0"), path, {"engine": "stub"}, {"score": 1.0}, ("text",))
    made = results.write_results(spark, docs.where("doc_id % 2 = 1"), path, {"engine": "stub"}, {"score": 1.0}, ("text",), mode="append")
    back = results.read_results(spark, path, "doc_id long, source string, text string")
    per = back.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return per.withColumns({"rows": F.lit(made["rows"]).cast("long"), "words": F.lit(made["words"]["text"]).cast("long")})


def window_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub summary per five-day window and topic, from its documents as far as the budget goes, and its overlap with the first of them."""
    held = windows.assign_date_windows(articles(spark, sf_dir), 5, 5)
    per = tasks.budgeted(held, ["topic", "window_start"], ["event_date", "doc_id"], F.col("text"), 1000, "texts", F.count("*").alias("n"))
    out = per.withColumn("summary", models.generate(qa_generation.summary_prompt(F.col("texts"), 60), max_tokens=120)["text"])
    return out.select("topic", "window_start", "n", "summary", F.round(sm.score("summary", F.col("texts")[0], "rouge_l"), 6).alias("rouge_l"))


def window_clustering_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = windows.window_events(articles(spark, sf_dir).select("doc_id", "event_date", "text"), 5, 5)
    return cluster_state.cluster_windows(docs, "window_index", "doc_id", "text", ["event_date", "doc_id"])


def story_clustering_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles(spark, sf_dir).select("doc_id", "event_date", "topic", "text")
    return cluster_state.cluster_stories(docs, "topic", "doc_id", "text", ["event_date", "doc_id"], cap=4)


def question_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template questions from documents' keywords, with shuffled choices and the stub judge's score."""
    docs = articles(spark, sf_dir).select("doc_id", "event_date", F.array_distinct(keywords(F.col("text"), 5)).alias("words"), F.col("text").alias("article"))
    q = qa_generation.template_question(qa_generation.pick_kind(F.col("doc_id")), F.col("event_date"), F.col("words")[0], F.col("words")[1])
    asked = docs.where(F.size("words") >= 4).withColumn("q", q).where("q is not null")
    made = asked.withColumn("m", qa_generation.finished(F.col("q.question"), F.col("q.answer"), F.col("words"), 42, F.col("doc_id")))
    listed = F.array_join(F.map_values("m.choices"), " | ")
    scored = questions.judged(made, F.col("q.question"), listed, F.col("m.answer"), F.col("article"))
    return scored.select("doc_id", "q.question", "m.answer", listed.alias("choices"), F.array_join("m.reasons", ";").alias("reasons"), *[f"{a}_score" for a in questions.ASPECTS])


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles(spark, sf_dir).select("doc_id", "topic", "event_date", "text", F.array_distinct(keywords(F.col("text"), 5)).alias("words")).where(F.size("words") >= 4)
    docs = docs.withColumns({"kind": qa_generation.pick_kind(F.col("doc_id")), "target": F.col("words")[0]})
    return docs.withColumn("q", questions.questions(F.col("kind"), F.col("event_date"), F.col("text"), F.col("target")))


def question_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about documents with at most three attempts each: how many took how many, and how many failed."""
    asked = Scratch(spark).write(_asked(spark, sf_dir).select("kind", "q"), "asked")
    return asked.groupBy("kind", F.col("q.attempts").alias("attempts"), F.col("q.question").isNotNull().alias("made")).agg(F.count("*").alias("n"))


def question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten proposed candidates for each question, four of them chosen, checked and shuffled."""
    rows = _asked(spark, sf_dir).where("q.question is not null").withColumn("pool", questions.proposed(F.col("q.question"), F.col("target"), F.col("text")))
    made = rows.withColumn("m", qa_generation.finished(F.col("q.question"), F.col("target"), F.col("pool"), 42, F.col("doc_id")))
    return made.select("doc_id", F.size("pool").cast("long").alias("n_candidates"), "m.answer", F.array_join(F.map_values("m.choices"), " | ").alias("choices"), F.array_join("m.reasons", ";").alias("reasons"))


def question_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a topic's questions of one kind and day ask the same."""
    rows = _asked(spark, sf_dir).where("q.question is not null").select(F.concat_ws("/", "topic", F.col("event_date").cast("string")).alias("event"), "kind", "doc_id", "q.question")
    rows = Scratch(spark).write(rows, "asked")
    return questions.redundancy(rows, "event", "kind", "question", "doc_id")


def rubric_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries judged by the rubric's criteria."""
    rows = _pairs(spark, sf_dir)
    raw = models.generate(qa_generation.rubric_prompt(F.col("reference"), F.col("hypothesis")), temperature=0.0)["text"]
    return rows.select("doc_id", rubric_score(raw).alias("r")).groupBy("r.overall").agg(F.count("*").alias("n"))


def batched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as tasks of one prompt, and as many answers."""
    events = text_events(spark, sf_dir)
    answers = models.generate(qa_generation.batch_prompt(F.col("texts"), "###"), max_tokens=400)["text"]
    return events.select("conv_id", F.size("texts").cast("long").alias("n"), F.size(batch_answers(answers, "###", F.size("texts"))).cast("long").alias("n_answers"))


def cluster_level_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles(spark, sf_dir)
    found = cluster_state.cluster_stories(docs, "topic", "doc_id", "text", ["event_date", "doc_id"]).select("doc_id", "cluster")
    named = cluster_state.cluster_keywords(docs.join(found, "doc_id"), "topic", "cluster", "text", "doc_id")
    return named.select("topic", "cluster", F.array_join("keywords", " ").alias("keywords"))


def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows' clusters scored at once."""
    return tasks.micro_clustering(tasks.clustering(articles(spark, sf_dir), 10, 10, "doc_id", "text", "topic")[0], "topic")


def html_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.lateralJoin(html_tables.LinkTable(F.col("html").outer())).select("page_id", "ordinal", "href", "label")


def html_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("a", html_tables.article("html"))
    return Scratch(spark).write(pages.select("page_id", "a.title", F.length("a.text").alias("n_chars")), "articles")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per anchored 7-day window, counted by a stream over the events file."""
    from ..streaming.folders import checkpoint_folder

    schema = read(spark, sf_dir, "events").schema
    anchor = dated_events(spark, sf_dir).agg(F.min("event_date")).first()[0]
    stream = stateful.anchored_counts(stateful.event_stream(spark, stateful.table_path(sf_dir, "events"), schema), str(anchor), 7, 1, F.sum("event_id").alias("id_sum"))
    out = stateful.run_to_table(stream, f"counts_{uuid.uuid4().hex[:8]}", checkpoint_folder(spark))
    return windows.dense_index(out).drop("window_number")


def stream_cluster_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source clustered by a stream with a row of state for each cluster."""
    held = spark.conf.get(keyed_state.PROVIDER, None)
    keyed_state.use_rocksdb(spark)
    try:
        docs = stateful.table_stream(spark, sf_dir, "documents", read(spark, sf_dir, "documents").schema)
        stream = keyed_state.cluster_stream_keyed(docs.select("doc_id", "source", "text"), "source", "doc_id", "text", ["doc_id"])
        return stateful.run_to_parquet(stream, f"{checkpoint_folder(spark)}/clusters", checkpoint_folder(spark))
    finally:
        spark.conf.unset(keyed_state.PROVIDER) if held is None else spark.conf.set(keyed_state.PROVIDER, held)


def task_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per window of documents clustered by the stub, with their source as the truth."""
    docs = articles(spark, sf_dir)
    return tasks.clustering(docs, 5, 5, "doc_id", "text", "topic")[1]


def task_summarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles(spark, sf_dir).withColumn("reference", F.concat_ws(" ", "source", "lang"))
    return tasks.summarization(docs, 10, 10, "doc_id", "text", "reference", "topic", 500, 60)


def task_temporal_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about benchmark texts in windows of documents, answered by the stub from documents that aren't later."""
    held = windows.window_events(articles(spark, sf_dir).select("doc_id", "event_date", "text"), 5, 5)
    texts = held.select("window_index", F.col("doc_id").alias("article_id"), F.col("event_date").alias("article_date"), "text")
    start = F.lit("2024-01-01").cast("date")
    items = read(spark, sf_dir, "benchmark").withColumn("question_date", F.date_add(start, (F.col("item_id") % 30).cast("int")))
    choices = F.map_from_arrays(F.array(*[F.lit(x) for x in "abcd"]), F.slice(F.array_distinct(F.split("text", " ")), 1, 4))
    asked = items.select(F.floor(F.datediff("question_date", start) / 5).alias("window_index"), F.col("item_id").alias("question_id"), "question_date", F.concat(F.lit("When was it said that "), "text", F.lit("?")).alias("question"), choices.alias("choices"), F.lit("a").alias("answer"), F.lit(None).cast("string").alias("question_type"))
    return tasks.temporal_qa(asked, texts, 1000).drop("question")


QUERIES = {f.__name__: f for f in (
    rouge1_f, rouge2_f, summary_sequence_metrics, summary_averages, novelty_tokens, distinctiveness, embedded_similarity, embedded_token_match, word_associations, density_topics, seeded_stories, ledger_answers, results_round_trip, window_summaries, window_clustering_stub, story_clustering_stub, question_building,
    question_attempts, question_candidates, question_redundancy, rubric_judge, batched_answers, cluster_level_keywords, micro_metrics,
    task_clustering, task_summarization, task_temporal_qa, html_link_extract, html_article_text, stream_window_counts, stream_cluster_state,
)}

_PAIRS = """n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT doc_id, source AS topic, d.text AS h, b.text AS r
FROM documents d, n JOIN benchmark b ON b.item_id = doc_id % n.n)"""
_NORM = r"list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '\s+'), lambda w: w <> '')"
_SET = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"


def _rouge_sql(n: int) -> str:
    grams = lambda c: f"SELECT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g, count(*) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT doc_id, {_NORM.format(c)} AS w FROM p) WHERE len(w) >= {n}) GROUP BY ALL"
    return f"""WITH {_PAIRS}, h AS ({grams('h')}), r AS ({grams('r')}), b AS (SELECT coalesce(h.doc_id, r.doc_id) AS doc_id, coalesce(h.c, 0) AS x, coalesce(r.c, 0) AS y FROM h FULL JOIN r ON h.doc_id = r.doc_id AND h.g = r.g),
f AS (SELECT doc_id, 2 * sum(least(x, y)) / (sum(x) + sum(y)) AS f FROM b GROUP BY doc_id) SELECT p.doc_id, round(coalesce(f, 0), 6) AS f FROM p LEFT JOIN f ON f.doc_id = p.doc_id"""


_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"

ORACLE = {
    "ledger_answers": r"SELECT conv_id, turn, md5(array_to_string(list_slice(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), 1, 10), ' ')) AS answer, NULL::VARCHAR AS answer_error FROM conversations",
    "results_round_trip": r"""
SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, (SELECT count(*) FROM documents) AS rows, (SELECT CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS BIGINT) FROM documents) AS words FROM documents GROUP BY source""",
    "word_associations": r"""
WITH d AS (SELECT row_number() OVER () AS d, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS t FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations)),
w AS (SELECT d, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS w FROM d), v AS (SELECT w FROM w GROUP BY w HAVING count(*) >= 3), k AS (SELECT w.* FROM w JOIN v USING (w)),
o AS (SELECT x.w AS a, y.w AS b FROM k x JOIN k y ON x.d = y.d AND y.i > x.i AND y.i <= x.i + 3),
n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM o UNION ALL SELECT b, a FROM o) GROUP BY ALL),
s AS (SELECT a, CAST(sum(n) AS DOUBLE) AS s FROM n GROUP BY a)
SELECT n.a AS word, n.b AS context, round(ln(n * (SELECT sum(s) FROM s) / (x.s * y.s)), 6) AS pmi FROM n JOIN s x ON x.a = n.a JOIN s y ON y.a = n.b WHERE ln(n * (SELECT sum(s) FROM s) / (x.s * y.s)) > 0""",
    "rouge1_f": _rouge_sql(1),
    "rouge2_f": _rouge_sql(2),
    "novelty_tokens": f"""
WITH {_PAIRS}, f AS (SELECT *, first_value(h) OVER o AS prev, row_number() OVER o AS k FROM p WINDOW o AS (PARTITION BY topic ORDER BY doc_id)),
s AS (SELECT doc_id, {_SET.format('h')} AS h, {_SET.format('r')} AS r, CASE WHEN k > 1 THEN {_SET.format('prev')} ELSE [] END AS v FROM f), w AS (SELECT *, list_filter(h, lambda x: NOT list_contains(v, x)) AS d FROM s)
SELECT doc_id, round(CASE WHEN len(d) = 0 THEN 0.0 ELSE {_JACCARD.format('d', 'r')} END, 6) AS novelty, round({_JACCARD.format('h', 'r')}, 6) AS relevance FROM w""",
    "distinctiveness": f"""
WITH {_PAIRS}, s AS (SELECT doc_id, topic, {_SET.format('h')} AS h, {_SET.format('r')} AS r FROM p), o AS (SELECT DISTINCT topic, {_SET.format('r')} AS r FROM p),
m AS (SELECT s.doc_id, sum(1 - {_JACCARD.format('s.h', 'o.r')}) AS far, count(*) AS n FROM s JOIN o ON o.topic <> s.topic GROUP BY s.doc_id)
SELECT s.doc_id, round(coalesce(far / (n * (1 - {_JACCARD.format('s.h', 's.r')} + 1e-8)), 1.0), 5) AS distinctiveness FROM s LEFT JOIN m ON m.doc_id = s.doc_id""",
    "html_link_extract": r"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>') AS x FROM pages), i AS (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM x)
SELECT page_id, CAST(i - 1 AS INT) AS ordinal, regexp_extract(x[i], 'href="([^"]+)"', 1) AS href, trim(regexp_replace(regexp_extract(x[i], '>([^<]*)<', 1), '\s+', ' ', 'g')) AS label FROM i""",
    "stream_window_counts": """
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_id FROM events), b AS (SELECT min(d) AS lo, max(d) AS hi FROM e), w AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS s FROM b),
a AS (SELECT s AS window_start, CAST(s + INTERVAL 7 DAY AS DATE) AS window_end, count(*) AS event_count, CAST(sum(event_id) AS BIGINT) AS id_sum FROM w JOIN e ON d >= s AND d < s + INTERVAL 7 DAY GROUP BY s)
SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS window_index FROM a""",
}
