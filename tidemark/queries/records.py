"""Corpora, annotations and results written to files and read back, projections of cues, and references of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html_tables, qa_generation
from ..operators import sampling
from ..plans import clustering_metrics as cm
from ..plans import tasks
from ..sources import connectors, corpus, sinks
from ..sources.tables import articles, dated_events, read, text_events
from ..streaming import stateful
from ..streaming.folders import checkpoint_folder


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as flattened corpus rows: a file per type, a topic per user, cues from its other columns."""
    rows = dated_events(spark, sf_dir)
    none = F.array().cast("array<string>")
    order = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1
    return rows.select(
        F.col("event_type").alias("file"), F.col("user_id").alias("topic_idx"), order.alias("event_idx"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("topic_title"), F.lit("c").alias("topic_category"), "event_date", "event_id",
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("event_sum"), F.array(F.concat(F.lit("u"), F.col("event_id").cast("string"))).alias("urls"), F.array(F.concat(F.lit("text of "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 4 == 0, "...").otherwise("")), F.lit("more")).alias("texts"),
        F.when(F.col("event_id") % 3 > 0, F.array("event_type", F.lit('é "x"'))).otherwise(none).alias("people"), F.when(F.col("event_id") % 5 > 0, F.array(F.lit("here"))).otherwise(none).alias("location"), F.when(F.col("event_id") % 7 > 0, F.array(F.lit("done"))).otherwise(none).alias("result"), none.alias("relations"),
        F.when(F.col("event_id") % 2 > 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("event_attributes"),
    )


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events nested into a corpus, written as JSON, read and flattened again."""
    path = f"{checkpoint_folder(spark)}/corpus"
    sinks.write_per_file(corpus.nest(_events(spark, sf_dir)).withColumn("keywords", F.array("file")), path)
    back = corpus.flatten_events(corpus.read_topics(spark, f"{path}/*/*.json"))
    return back.groupBy("topic_title").agg(F.count("*").alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.min("event_sum").alias("event_sum"), F.sum(F.size("texts")).alias("n_texts"))


def qa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events with a question for each user's turn, ten files of them, written as JSON, read, and flattened."""
    turns = read(spark, sf_dir, "conversations")
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    asks = F.transform(F.filter("x", lambda s: s["role"] == "user"), lambda s: F.struct(F.lit("").alias("referenced_article"), F.lit("entity_tracking").alias("question_type"), s["text"].alias("question"), F.lit("a").alias("answer")))
    event = F.struct(F.lit("2024-01-02").alias("event_date"), F.col("conv_id").cast("string").alias("event_sum"), F.transform("x", lambda s: s["text"]).alias("event_text"), asks.alias("qa_pairs"))
    path = f"{checkpoint_folder(spark)}/qa"
    files = per.groupBy((F.col("conv_id") % 10).cast("string").alias("file")).agg(F.collect_list(event).alias("events"))
    sinks.write_per_file(files, path)
    back = corpus.flatten_qa(corpus.read_qa(spark, f"{path}/*/*.json"))
    return back.groupBy("event_date", "question_type").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("question_chars"), F.sum(F.length("referenced_article")).alias("article_chars"))


def cue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues as JSON text for prompts."""
    return _events(spark, sf_dir).select("event_id", corpus.cue_json().alias("cues"), corpus.cue_json(("Location",)).alias("without_places"))


def sections_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("file", corpus.has_sections().alias("usable")).agg(F.count("*").alias("n"))


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were cut, with their addresses."""
    return corpus.flatten_articles(_events(spark, sf_dir)).where(corpus.is_cut(F.col("text"))).select("url", "text")


def single_article_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as articles: two of each by hash, each a context of its own."""
    events = text_events(spark, sf_dir).select(F.lit("f").alias("file"), F.lit(0).alias("topic_idx"), F.col("conv_id").alias("event_idx"), "texts")
    return corpus.article_contexts(events).select(F.col("event_idx").alias("conv_id"), F.col("text_idx").cast("long").alias("turn_at"), F.array_join("texts", "|").alias("article"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select(F.lit("labels").alias("file"), F.col("doc_id").alias("event_idx"), F.lit(0).alias("qa_idx"), F.when(F.col("doc_id") % 4 > 0, F.col("quality") * 2).alias("question_score"), F.col("quality").alias("answer_score"), F.col("toxic").alias("choice_score"), F.when(F.col("doc_id") % 6 > 0, F.col("doc_id") % 6 == 1).alias("human_annotated"))
    return corpus.annotation_entries(rows)


def annotation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("unique_id", F.col("total_score").cast("long").alias("total_score"))


def annotation_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that nobody has annotated with scores from 1 to 3."""
    return corpus.to_annotate(_entries(spark, sf_dir), 1, 3).select("unique_id")


def csv_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV by year with a fixed header, and counted from the files."""
    path = f"{checkpoint_folder(spark)}/csv"
    orders = read(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    sinks.write_csv_by_year(orders, path, ["year", "o_orderkey", "o_orderstatus", "note"], ["o_orderkey"])
    back = spark.read.schema("year int, o_orderkey long, o_orderstatus string, note string, _year int").option("header", True).csv(path)
    return back.groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"), F.count("note").alias("n_notes"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of all labels in which those of every third document are replaced."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    new = labels.where("doc_id % 3 = 0").withColumn("quality", F.col("quality") + 10)
    return sinks.upsert(spark, labels, new, ["doc_id"]).groupBy("quality").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def append_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels appended in two runs, of which the second overlaps the first."""
    path, labels = f"{checkpoint_folder(spark)}/appended", read(spark, sf_dir, "labels")
    first = sinks.append_new(spark, labels.where("doc_id % 2 = 0"), path, ["doc_id"])
    second = sinks.append_new(spark, labels, path, ["doc_id"])
    done = spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"))
    return done.select("n", "n_ids", F.lit(first).cast("long").alias("first_run"), F.lit(second).cast("long").alias("second_run"))


def runs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in the folders of runs by model and task, read with the names of their runs."""
    base = f"{checkpoint_folder(spark)}/runs"
    events = read(spark, sf_dir, "events")
    for model, run in (("m1", "qa_s1_t5_struct_x"), ("m1", "qa_s1_t3_no_struct_x"), ("m2", "cluster_s2_t1_concat_struct_x"), ("m2", "other")):
        events.where(F.col("event_type").isNotNull()).agg(F.count("*").alias("n")).write.json(f"{base}/{model}/task/{run}")
    rows = corpus.read_runs(spark, base, "n long")
    return rows.select("model", F.col("run.task").alias("task"), F.col("run.story").alias("story"), F.col("run.texts_per_event").cast("long").alias("texts_per_event"), F.col("run.structure").alias("structure"), "n")


def reference_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of topics as joins of their languages in order, those of some from a cache."""
    docs = articles(spark, sf_dir)
    cached = docs.where("topic < 'src2'").select("topic").distinct().withColumn("label", F.lit("cached"))
    return tasks.reference_labels(docs, ["topic"], ["doc_id"], "lang", cached)


def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.first_windows(dated_events(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id")


def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.one_of(read(spark, sf_dir, "documents"), ["lang", "source"], ["doc_id"]).select("lang", "source", "doc_id")


def entities_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a few words each document names, case and all."""
    named = qa_generation.mentioned(F.array(*[F.lit(w) for w in ("the", "The", "der", "la")]), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(named, ",").alias("named"))


def metric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of labels that are there on one side only, and of none at all, as rows with an error."""
    rows = read(spark, sf_dir, "labels").select("quality", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")).alias("toxic"))
    made = [cm.scored_or_error(r, "quality", "toxic").withColumn("case", F.lit(c)) for c, r in (("unequal", rows), ("empty", rows.limit(0)), ("whole", rows.where("toxic is not null")))]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("case", "error", F.round("f1", 6).alias("f1"), "n_items")


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses fetched by a stand-in for the network that knows no address of a length divisible by five."""

    def known(url: str) -> str:
        if len(url) % 5 == 0:
            raise LookupError(url)
        return f"<p>{url}</p>"

    found = connectors.fetch_table(read(spark, sf_dir, "pages"), "url", known, tries=2, wait=0.0)
    return found.groupBy(F.col("text").isNotNull().alias("found"), F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def epoch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watermarked count of events per day and type, each micro-batch written by its number."""
    schema = read(spark, sf_dir, "events").schema
    stream = stateful.windowed_counts(stateful.event_stream(spark, stateful.table_path(sf_dir, "events"), schema), "1 day", "1 day", "365 days", "event_type")
    path = f"{checkpoint_folder(spark)}/batches"
    flat = stream.select(F.to_date("window.start").alias("day"), "event_type", "event_count")
    query = flat.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    last = Window.partitionBy("day", "event_type").orderBy(F.desc("batch"))
    back = spark.read.schema("day date, event_type string, event_count long, batch int").parquet(path)
    return back.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("day", "event_type", "event_count")


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages that are made of documents' ids, with their dates."""
    item = F.concat(F.lit('<li id="r'), F.col("doc_id").cast("string"), F.lit('"><a class="external" href="http://x/'), F.col("doc_id").cast("string"), F.lit('">t</a> <span class="reference-date">'), F.date_format("event_date", "d MMMM yyyy"), F.lit("</span></li>"))
    html = F.concat(F.lit('<h2>Other</h2><ul><li id="no">x</li></ul><h2><span id="References">R</span></h2><div><ol>'), item, F.lit('</ol></div><h2>Next</h2><ul><li id="no2">y</li></ul>'))
    pages = articles(spark, sf_dir).select("doc_id", html.alias("html"))
    return pages.lateralJoin(html_tables.ReferenceTable(F.col("html").outer())).select("doc_id", "reference_id", "link", F.col("date").cast("date").alias("date"))


def renested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as topics of as many events as their turn says, and all judged events of a role as one list that is dealt to them again."""
    turns = read(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("topic"), (F.col("turn") % 4).alias("size"))
    judged = turns.groupBy("role").agg((F.sum("size") + 2).alias("n")).select("role", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
    return corpus.by_running_offset(turns, judged, "role", "topic", "size", "at").select("role", "at", "topic", F.col("event_idx").cast("long").alias("event_idx"))


QUERIES = {f.__name__: f for f in (
    corpus_round_trip, qa_round_trip, cue_texts, sections_present, cut_texts, single_article_contexts, annotation_entries, annotation_todo, csv_by_year, cache_upsert, append_resumes, runs_read, reference_labels,
    first_windows, one_per_group, entities_mentioned, metric_errors, fetched_pages, epoch_windows, page_references, renested_events,
)}

_CUE = """list_filter([CASE WHEN event_id % 3 > 0 THEN '  "People": [' || chr(10) || '    "' || event_type || '",' || chr(10) || '    "é \\"x\\""' || chr(10) || '  ]' END{0},
CASE WHEN event_id % 7 > 0 THEN '  "Result": [' || chr(10) || '    "done"' || chr(10) || '  ]' END,
CASE WHEN event_id % 2 > 0 THEN '  "Event Attributes": {{' || chr(10) || '    "user": "' || CAST(user_id AS VARCHAR) || '"' || chr(10) || '  }}' END], lambda x: x IS NOT NULL)"""
_PLACE = """, CASE WHEN event_id % 5 > 0 THEN '  "Location": [' || chr(10) || '    "here"' || chr(10) || '  ]' END"""
_ENTRY = "e AS (SELECT 'labels_' || CAST(doc_id AS VARCHAR) || '_0' AS unique_id, CAST(CASE WHEN doc_id % 4 > 0 THEN quality * 2 ELSE 0 END + coalesce(quality, 0) + coalesce(toxic, 0) AS BIGINT) AS total_score, doc_id FROM labels)"
_RUN_ROWS = "(VALUES ('m1', 'qa', 's1', 5::BIGINT, 'struct'), ('m1', 'qa', 's1', 3, 'no_struct'), ('m2', 'cluster', 's2', 1, 'struct')) AS r(model, task, story, texts_per_event, structure)"

ORACLE = {
    "corpus_round_trip": "SELECT 'user ' || CAST(user_id AS VARCHAR) AS topic_title, count(*) AS n, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, min('event ' || CAST(event_id AS VARCHAR)) AS event_sum, CAST(2 * count(*) AS BIGINT) AS n_texts FROM events GROUP BY 1",
    "qa_round_trip": """
WITH f AS (SELECT conv_id, arg_min(text, turn) AS a FROM conversations GROUP BY conv_id)
SELECT DATE '2024-01-02' AS event_date, 'entity_tracking' AS question_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS question_chars, CAST(sum(length(a)) AS BIGINT) AS article_chars FROM conversations JOIN f USING (conv_id) WHERE role = 'user'""",
    "cue_texts": f"""
WITH c AS (SELECT event_id, {_CUE.format(_PLACE)} AS x, {_CUE.format('')} AS y FROM events)
SELECT event_id, CASE WHEN len(x) = 0 THEN '{{}}' ELSE '{{' || chr(10) || array_to_string(x, ',' || chr(10)) || chr(10) || '}}' END AS cues, CASE WHEN len(y) = 0 THEN '{{}}' ELSE '{{' || chr(10) || array_to_string(y, ',' || chr(10)) || chr(10) || '}}' END AS without_places FROM c""",
    "sections_present": "SELECT event_type AS file, (event_id % 3 > 0 OR event_id % 5 > 0) AND event_id % 7 > 0 AS usable, count(*) AS n FROM events GROUP BY ALL",
    "cut_texts": "SELECT 'u' || CAST(event_id AS VARCHAR) AS url, 'text of ' || CAST(event_id AS VARCHAR) || '...' AS text FROM events WHERE event_id % 4 = 0",
    "single_article_contexts": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_at, text FROM conversations)
SELECT conv_id, turn_at, text AS article FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY md5('42:' || CAST(turn_at AS VARCHAR))) <= 2""",
    "annotation_entries": f"WITH {_ENTRY} SELECT unique_id, total_score FROM e",
    "annotation_todo": f"WITH {_ENTRY} SELECT unique_id FROM e WHERE doc_id % 6 <> 1 AND total_score BETWEEN 1 AND 3",
    "csv_by_year": "SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, 0::BIGINT AS n_notes FROM orders GROUP BY ALL",
    "cache_upsert": "SELECT CASE WHEN doc_id % 3 = 0 THEN quality + 10 ELSE quality END AS quality, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM labels GROUP BY 1",
    "append_resumes": "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (doc_id % 2 = 0) AS first_run, count(*) FILTER (doc_id % 2 <> 0) AS second_run FROM labels",
    "runs_read": f"SELECT r.*, (SELECT count(*) FROM events) AS n FROM {_RUN_ROWS}",
    "reference_labels": "SELECT source AS topic, CASE WHEN source < 'src2' THEN 'cached' ELSE string_agg(lang, ' ' ORDER BY doc_id) END AS label FROM documents GROUP BY source",
    "first_windows": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id",
    "one_per_group": "SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) = 1",
    "entities_mentioned": "SELECT doc_id, array_to_string(list_filter(['the', 'The', 'der', 'la'], lambda w: contains(text, w)), ',') AS named FROM documents",
    "metric_errors": """
WITH k AS (SELECT quality AS t, toxic AS p FROM labels WHERE doc_id % 2 = 0), c AS (SELECT t, p, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY t) AS a, sum(n) OVER (PARTITION BY p) AS b FROM c),
s AS (SELECT sum(n * n / b) / sum(n) AS p, sum(n * n / a) / sum(n) AS r, CAST(sum(n) AS BIGINT) AS n_items FROM m)
SELECT 'unequal' AS "case", 'unequal lengths' AS error, NULL::DOUBLE AS f1, NULL::BIGINT AS n_items UNION ALL SELECT 'empty', 'empty input', NULL, NULL UNION ALL SELECT 'whole', NULL, round(2 * p * r / (p + r), 6), n_items FROM s""",
    "fetched_pages": "WITH u AS (SELECT DISTINCT url FROM pages) SELECT length(url) % 5 <> 0 AS found, length(url) % 5 = 0 AS failed, count(*) AS n, CAST(sum(CASE WHEN length(url) % 5 <> 0 THEN length(url) + 7 END) AS BIGINT) AS chars FROM u GROUP BY ALL",
    "epoch_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS event_count FROM events GROUP BY ALL",
    "renested_events": """
WITH t AS (SELECT role, conv_id * 100 + turn AS topic, turn % 4 AS size FROM conversations), o AS (SELECT *, CAST(sum(size) OVER (PARTITION BY role ORDER BY topic) - size AS BIGINT) AS b FROM t),
j AS (SELECT role, unnest(range(CAST(sum(size) AS BIGINT) + 2)) AS i FROM t GROUP BY role)
SELECT j.role, j.i AS "at", o.topic, j.i - o.b AS event_idx FROM j LEFT JOIN o ON o.role = j.role AND j.i >= o.b AND j.i < o.b + o.size""",
    "page_references": "SELECT doc_id, 'r' || CAST(doc_id AS VARCHAR) AS reference_id, 'http://x/' || CAST(doc_id AS VARCHAR) AS link, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date FROM documents",
}
