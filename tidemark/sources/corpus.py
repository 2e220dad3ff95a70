"""Nested JSON corpora: schemas of both layouts, readers, flattening to canonical tables, and nesting again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import strict_date
from ..functions.text import truthy

CUES = "People array<string>, Location array<string>, Result array<string>, Relations array<string>, `Event Attributes` map<string,string>"
TOPIC_EVENT = f"struct<event_date: string, event_sum: string, event_urls: array<string>, event_text: array<string>, People: array<string>, Location: array<string>, Result: array<string>, Relations: array<string>, `Event Attributes`: map<string,string>>"
TOPICS = f"keywords array<string>, topics array<struct<topic_title: string, topic_category: string, topic_url: string, start_date: string, last_date: string, events: array<{TOPIC_EVENT}>>>, _corrupt_record string"
QA_PAIR = "struct<referenced_article: string, question_type: string, question: string, candidate_choices: array<string>, choices: map<string,string>, answer: string>"
SANITY = "struct<is_valid: boolean, qa_checks: array<struct<index: int, is_valid: boolean, reasons: array<string>>>, redundancy_check: struct<result_recognition: struct<is_redundant: boolean, reason: string>, entity_tracking: struct<is_redundant: boolean, reason: string>>>"
QA = f"events array<struct<event_date: string, event_sum: string, event_text: array<string>, structured_data: struct<{CUES.replace('array<', ': array<').replace('map<', ': map<').replace(' :', ':')}>, qa_pairs: array<{QA_PAIR}>, sanity_check: {SANITY}>>, metadata struct<story_num: int, generated_at: string, total_pairs: int>, _corrupt_record string"
# Cue fields in the order in which they are listed.
FIELDS = ("People", "Location", "Result", "Relations", "Event Attributes")


def read_topics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file with ``file``; files of a glob or list are read in one job."""
    return spark.read.schema(TOPICS).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_qa(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(QA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def flatten_events(corpus: DataFrame) -> DataFrame:
    """One row per event with a valid date, with ordinals, topic columns and the raw date; a topic without title is 'Unknown Topic'."""
    topics = corpus.select("file", F.posexplode("topics").alias("topic_idx", "t"))
    events = topics.select("file", "topic_idx", "t", F.posexplode("t.events").alias("event_idx", "e"))
    out = events.select(
        "file", "topic_idx", "event_idx", F.coalesce("t.topic_title", F.lit("Unknown Topic")).alias("topic_title"), "t.topic_category", F.col("t.start_date").alias("topic_start"), F.col("t.last_date").alias("topic_last"),
        strict_date(F.col("e.event_date")).alias("event_date"), F.col("e.event_date").alias("event_date_raw"), "e.event_sum", F.col("e.event_urls").alias("urls"), F.col("e.event_text").alias("texts"),
        F.col("e.People").alias("people"), F.col("e.Location").alias("location"), F.col("e.Result").alias("result"), F.col("e.Relations").alias("relations"), F.col("e.`Event Attributes`").alias("event_attributes"),
    )
    return out.where("event_date is not null")


def flatten_texts(events: DataFrame) -> DataFrame:
    """One row per text, with ``truth``, the number of its event in order of topic and event."""
    w = F.dense_rank().over(_window("file", "topic_idx", "event_idx"))
    return events.withColumn("truth", w - 1).select("*", F.posexplode("texts").alias("text_idx", "text"))


def _window(part: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)


def flatten_articles(events: DataFrame) -> DataFrame:
    """One row per (url, text) pair; the longer of both lists is cut."""
    n = F.least(F.size("urls"), F.size("texts"))
    pairs = F.arrays_zip(F.slice("urls", F.lit(1), n).alias("url"), F.slice("texts", F.lit(1), n).alias("text"))
    return events.select("file", "topic_idx", "event_idx", "topic_title", "event_date", F.posexplode(pairs).alias("text_idx", "x")).select("*", "x.url", "x.text").drop("x")


def flatten_qa(corpus: DataFrame) -> DataFrame:
    """One row per question with its event; the referenced article falls back to the first text."""
    events = corpus.select("file", F.posexplode("events").alias("event_idx", "e"))
    pairs = events.select("file", "event_idx", "e", F.posexplode("e.qa_pairs").alias("qa_idx", "q"))
    article = F.coalesce(F.nullif("q.referenced_article", F.lit("")), F.try_element_at("e.event_text", F.lit(1)), F.lit(""))
    return pairs.select("file", "event_idx", "qa_idx", strict_date(F.col("e.event_date")).alias("event_date"), "q.question_type", "q.question", "q.choices", "q.answer", article.alias("referenced_article"), "e.sanity_check")


def valid_questions(qa: DataFrame) -> DataFrame:
    """Questions whose check at their place is valid; a missing check is invalid, without any sanity check all are valid."""
    at = F.filter("sanity_check.qa_checks", lambda c: c["index"] == F.col("qa_idx"))
    ok = F.coalesce(F.try_element_at(at, F.lit(1))["is_valid"], F.lit(False))
    return qa.where(F.col("sanity_check").isNull() | ok)


def without_redundant(qa: DataFrame, seed: int = 42) -> DataFrame:
    """Of question types judged redundant in an event, one question stays, chosen by hash."""
    from ..operators.sampling import order_key

    check = "sanity_check.redundancy_check"
    redundant = F.when(F.col("question_type") == "result_recognition", F.col(f"{check}.result_recognition.is_redundant")).when(F.col("question_type") == "entity_tracking", F.col(f"{check}.entity_tracking.is_redundant"))
    rank = F.row_number().over(_part(["file", "event_idx", "question_type"], order_key(seed, "qa_idx")))
    return qa.withColumn("_r", F.coalesce(redundant, F.lit(False))).withColumn("_n", rank).where("NOT _r OR _n = 1").drop("_r", "_n")


def _part(keys: list[str], order: Column):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order)


def cues(exclude: tuple[str, ...] = ()) -> Column:
    """The filled cue fields of a flattened event as a struct; null if none is filled."""
    kinds = {"People": "people", "Location": "location", "Result": "result", "Relations": "relations", "Event Attributes": "event_attributes"}
    parts = {k: F.when(truthy(F.col(c), "array"), F.col(c)) for k, c in kinds.items() if k not in exclude}
    some = F.lit(False)
    for c in parts.values():
        some = some | c.isNotNull()
    return F.when(some, F.struct(*[c.alias(k) for k, c in parts.items()]))


#: Cue fields that prompts show, by the columns of a flattened event.
SHOWN = {"People": "people", "Location": "location", "Result": "result", "Event Attributes": "event_attributes"}


def _quoted(c: Column) -> Column:
    """A JSON string; letters beyond ASCII stay as they are."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def cue_json(exclude: tuple[str, ...] = ()) -> Column:
    """The filled cue fields that prompts show as JSON text, indented by two; relations are left out."""
    parts = []
    for name, c in SHOWN.items():
        if name in exclude:
            continue
        if c == "event_attributes":
            lines = F.transform(F.map_entries(c), lambda e: F.concat(F.lit("    "), _quoted(e["key"]), F.lit(": "), _quoted(e["value"])))
            opened, closed, some = "{", "}", F.col(c).isNotNull() & (F.size(F.map_keys(c)) > 0)
        else:
            lines = F.transform(F.col(c), lambda v: F.concat(F.lit("    "), _quoted(v)))
            opened, closed, some = "[", "]", truthy(F.col(c), "array")
        parts.append(F.when(some, F.concat(F.lit(f'  "{name}": {opened}\n'), F.array_join(lines, ",\n"), F.lit(f"\n  {closed}"))))
    body = F.concat_ws(",\n", *parts)
    return F.when(body == "", "{}").otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}")))


def has_sections() -> Column:
    """Flattened events that questions can be asked about: people or places, a result, and an article."""
    some = lambda c: F.coalesce(truthy(F.col(c), "array"), F.lit(False))
    return (some("people") | some("location")) & some("result") & some("texts")


def is_cut(text: Column) -> Column:
    """Texts that end in three dots are taken for truncated and worth fetching again."""
    return F.coalesce(F.endswith(text, F.lit("...")), F.lit(False))


def article_contexts(events: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """An event once for each of at most ``n`` of its articles, chosen by hash, with that article alone as ``texts``."""
    from ..operators.sampling import order_key

    each = events.select("*", F.posexplode("texts").alias("text_idx", "article"))
    rank = F.row_number().over(_part(["file", "topic_idx", "event_idx"], order_key(seed, "text_idx")))
    return each.withColumn("_n", rank).where(F.col("_n") <= n).withColumn("texts", F.array("article")).drop("_n")


def annotation_entries(judged: DataFrame) -> DataFrame:
    """``judged`` (file, event_idx, qa_idx and three scores) with unique_id and total_score, in which a null score is 0."""
    scores = ("question_score", "answer_score", "choice_score")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in scores[1:]), F.coalesce(F.col(scores[0]), F.lit(0)))
    return judged.withColumns({"unique_id": F.concat_ws("_", "file", F.col("event_idx").cast("string"), F.col("qa_idx").cast("string")), "total_score": total})


def to_annotate(entries: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Entries that nobody has annotated, with a total score from ``low`` to ``high``."""
    left = entries.where(~F.coalesce("human_annotated", F.lit(False)))
    left = left if low is None else left.where(F.col("total_score") >= low)
    return left if high is None else left.where(F.col("total_score") <= high)


def cue_lines(date: Column) -> Column:
    """The dated text of an event's cues: a line for each filled field, attributes as key: value; relations are left out."""
    line = lambda name, c: F.when(truthy(F.col(c), "array"), F.concat(F.lit(f"- {name}: "), F.array_join(c, ", ")))
    attributes = F.array_join(F.transform(F.map_entries("event_attributes"), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")
    return F.concat_ws("\n", F.concat(F.lit("["), F.date_format(date, "yyyy-MM-dd"), F.lit("]")), line("People", "people"), line("Location", "location"), line("Result", "result"), F.when(truthy(F.col("event_attributes"), "map"), F.concat(F.lit("- Event Attributes: "), attributes)))


def nest(events: DataFrame) -> DataFrame:
    """The corpus again, one row per file, topics and events in order."""
    event = F.struct("event_idx", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_sum", F.col("urls").alias("event_urls"), F.col("texts").alias("event_text"))
    topics = events.groupBy("file", "topic_idx").agg(F.first("topic_title").alias("topic_title"), F.first("topic_category").alias("topic_category"), F.date_format(F.min("event_date"), "yyyy-MM-dd").alias("start_date"), F.date_format(F.max("event_date"), "yyyy-MM-dd").alias("last_date"), F.sort_array(F.collect_list(event)).alias("events"))
    plain = F.transform("events", lambda e: F.struct(e["event_date"].alias("event_date"), e["event_sum"].alias("event_sum"), e["event_urls"].alias("event_urls"), e["event_text"].alias("event_text")))
    topic = F.struct("topic_idx", "topic_title", "topic_category", "start_date", "last_date", plain.alias("events"))
    whole = topics.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("topic_idx", topic.alias("t")))).alias("x"))
    return whole.select("file", F.transform("x", lambda s: s["t"].dropFields("topic_idx")).alias("topics"))


def by_running_offset(topics: DataFrame, judged: DataFrame, file: str, topic: str, size: str, at: str) -> DataFrame:
    """Judged events, which are one list for each file, under the topics again: the first ``size`` belong to the first topic, and so on.

    Adds ``topic`` and ``event_idx``, the place within it, to ``judged``, whose place in its list is ``at``, from 0 on.  Topics are
    few and get their offsets by a running sum; an event finds its topic by an equality on its place, so nothing is sorted.
    Events behind the last topic's have neither, topics without events get none."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(file).orderBy(topic).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = topics.where(F.col(size) > 0).select(file, topic, F.col(size).alias("_size"), before.alias("_before"))
    places = places.select(file, topic, F.posexplode(F.sequence(F.col("_before"), F.col("_before") + F.col("_size") - 1)).alias("event_idx", at))
    return judged.withColumn(at, F.col(at).cast("long")).join(places.withColumn(at, F.col(at).cast("long")), [file, at], "left")


def article_dict(raw: Column) -> Column:
    """(outlet, url, title, text) structs from a JSON object whose values are URLs or objects with url, title and text."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))

    def one(e: Column) -> Column:
        nested = F.from_json(e["value"], "url string, title string, text string")
        is_object = F.startswith(F.ltrim(e["value"]), F.lit("{"))
        pick = lambda f, other: F.when(is_object, nested[f]).otherwise(other)
        return F.struct(e["key"].alias("outlet"), pick("url", e["value"]).alias("url"), pick("title", F.lit(None)).alias("title"), pick("text", F.lit(None)).alias("text"))

    return F.transform(entries, one)


def run_name(path: Column) -> Column:
    """struct(task, story, texts_per_event, label, structure) from a run's folder name; nulls if it isn't one."""
    pattern = r"(cluster|qa|summ)_(.+?)_t(\d+)_(?:([a-z]+)_)??((?:no_)?struct)_"
    get = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return F.struct(get(1).alias("task"), get(2).alias("story"), get(3).cast("int").alias("texts_per_event"), get(4).alias("label"), get(5).alias("structure"))


def read_runs(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All results below ``base``/model/task/run with model and run columns; hidden and summary files are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "[!.]*.json").json(f"{base}/*/*/*")
    path = F.input_file_name()
    named = rows.withColumns({"model": F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+/[^/]+$", 1), "run": run_name(path)})
    return named.where(F.col("run.task").isNotNull() & ~path.contains("experiment_summary"))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of earlier runs; a path that doesn't exist yet gives an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def allowed_runs(spark: SparkSession, runs: DataFrame, stories: dict[int, list[str]]) -> DataFrame:
    """Runs of the stories that a year allows; the configuration is a small literal table."""
    table = spark.createDataFrame([(y, s) for y, names in stories.items() for s in names], "year int, story string")
    return runs.join(table, ["year", "story"], "left_semi")
