"""Windows over events and documents, window joins and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, windows
from ..sources.tables import articles, dated_events, read


def _date_window(size: int, stride: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        aggs = [F.count("*").alias("event_count"), F.countDistinct("user_id").alias("n_users")]
        return windows.date_windows(dated_events(spark, sf_dir), size, stride, *aggs)

    return query


def _date_window_sql(size: int, stride: int) -> str:
    return f"""
WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id FROM events), b AS (SELECT min(d) AS lo, max(d) AS hi FROM e),
w AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL {stride} DAY)) AS DATE) AS s FROM b),
a AS (SELECT s AS window_start, CAST(s + INTERVAL {size} DAY AS DATE) AS window_end, count(*) AS event_count, count(DISTINCT user_id) AS n_users
    FROM w JOIN e ON d >= s AND d < s + INTERVAL {size} DAY GROUP BY s)
SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS window_index FROM a"""


def per_type_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.date_windows(dated_events(spark, sf_dir), 7, 3, F.count("*").alias("event_count"), keys=["event_type"])


def count_window_100_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = windows.assign_count_windows(dated_events(spark, sf_dir), 100, 50, "event_date", "ts", "event_id", bucket=F.date_trunc("hour", "ts"))
    return assigned.groupBy("window_index").agg(F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"), F.count("*").alias("event_count"), F.sum("event_id").alias("id_sum"))


def incremental_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.incremental_windows(dated_events(spark, sf_dir), "event_date", "ts", "event_id", bucket=F.date_trunc("hour", "ts"))
    return out.select("window_index", "start_date", "end_date", "event_count", F.col("event_id").alias("new_event"))


def incremental_window_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, all events and distinct users up to it: a user is counted on the first day."""
    events = dated_events(spark, sf_dir)
    first = events.groupBy("user_id").agg(F.min("event_date").alias("event_date")).groupBy("event_date").agg(F.count("*").alias("new_users"))
    days = events.groupBy("event_date").agg(F.count("*").alias("n")).join(first, "event_date", "left")
    upto = windows.Window.orderBy("event_date").rowsBetween(windows.Window.unboundedPreceding, 0)  # one row per day
    return days.select("event_date", F.sum("n").over(upto).alias("events_so_far"), F.sum(F.coalesce("new_users", F.lit(0))).over(upto).alias("users_so_far"))


def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.window_summary(_date_window(7, 1)(spark, sf_dir))
    return out.withColumn("mean_events", F.round("mean_events", 6))


def tumbling_topic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.date_windows(articles(spark, sf_dir), 5, 5, F.count("*").alias("event_count"), F.sum("n_chars").alias("chars"), keys=["topic"])


def windows_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windows_containing(_date_window(7, 1)(spark, sf_dir), F.lit("2024-01-10").cast("date")).select("window_index", "window_start", "event_count")


def events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    return windows.in_range(dated_events(spark, sf_dir), day("2024-01-05"), day("2024-01-12")).groupBy("event_type").agg(F.count("*").alias("n"))


def window_date_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases dated like some event of value over 90 of a window, per window."""
    events = dated_events(spark, sf_dir)
    held = windows.window_events(events.where("value > 90"), 7, 7)
    units = events.where("event_type = 'purchase'").select("event_id", "event_date", "value")
    return joins.window_date_semi(units, held).groupBy("window_index").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


def asof_no_leak_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window and purchase, the clicks of the same window and user that aren't later."""
    held = windows.window_events(dated_events(spark, sf_dir), 7, 7)
    questions = held.where("event_type = 'purchase'").select("window_index", "user_id", F.col("event_id").alias("question_id"), F.col("event_date").alias("question_date"))
    texts = held.where("event_type = 'click'").select("window_index", "user_id", F.col("event_id").alias("article_id"), F.col("event_date").alias("article_date"))
    seen = joins.as_of(questions, texts, ["window_index", "user_id"], "question_date", "article_date")
    return seen.groupBy("window_index", "question_id").agg(F.count("*").alias("n_articles"), F.max("article_date").alias("latest"))


def asof_structured_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per purchase, the dated lines of what the user did before in the window, in order of time."""
    held = windows.window_events(dated_events(spark, sf_dir), 7, 7)
    questions = held.where("event_type = 'purchase'").select("window_index", "user_id", F.col("event_id").alias("question_id"), F.col("event_date").alias("question_date"))
    cues = held.where("event_type <> 'purchase'").select("window_index", "user_id", F.col("event_id").alias("cue_id"), F.col("event_date").alias("cue_date"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    seen = joins.as_of(questions, cues, ["window_index", "user_id"], "question_date", "cue_date")
    line = F.concat(F.lit("["), F.date_format("cue_date", "yyyy-MM-dd"), F.lit("] "), F.col("event_type"), F.lit(": "), F.col("k"))
    ordered = F.sort_array(F.collect_list(F.struct("cue_date", "cue_id", line.alias("line"))))
    return seen.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("context"))


def order_line_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in spans of 10 days from the first ship days of a supplier, by a bucketed range join.

    Spans and orders are brought to one row for each span and day first, as suppliers of one span meet the same orders."""
    days = lambda c: F.datediff(F.to_date(c), F.lit("1992-01-01").cast("date"))
    spans = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(days("l_shipdate")).alias("start")).withColumn("stop", F.col("start") + 10)
    points = read(spark, sf_dir, "orders").select("o_orderkey", days("o_orderdate").alias("day"))
    daily = points.groupBy("day").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))
    held = joins.range_join(daily, spans.select("start", "stop").distinct(), "day", "start", "stop", 16)
    per = held.groupBy("start", "stop").agg(F.sum("n").alias("n"), F.sum("key_sum").alias("key_sum"))
    return spans.join(per, ["start", "stop"]).select("l_suppkey", "n", "key_sum")


QUERIES = {
    "date_sliding_window_7_1": _date_window(7, 1),
    "date_tumbling_7": _date_window(7, 7),
    "date_gap_window_3_10": _date_window(3, 10),
} | {f.__name__: f for f in (per_type_sliding_window, count_window_100_50, incremental_window_events, incremental_window_daily, window_summary, tumbling_topic_windows, windows_on_date, events_in_range, window_date_semi_join, asof_no_leak_articles, asof_structured_context, order_line_range_join)}

_HELD = """e AS (SELECT *, CAST(ts AS DATE) AS d FROM events), b AS (SELECT min(d) AS lo FROM e),
i AS (SELECT *, datediff('day', lo, d) // 7 AS j FROM e, b), h AS (SELECT *, dense_rank() OVER (ORDER BY j) - 1 AS window_index FROM i)"""

ORACLE = {
    "date_sliding_window_7_1": _date_window_sql(7, 1),
    "date_tumbling_7": _date_window_sql(7, 7),
    "date_gap_window_3_10": _date_window_sql(3, 10),
    "per_type_sliding_window": """
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), b AS (SELECT event_type, min(d) AS lo, max(d) AS hi FROM e GROUP BY event_type),
w AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 3 DAY)) AS DATE) AS s FROM b),
a AS (SELECT e.event_type, s AS window_start, CAST(s + INTERVAL 7 DAY AS DATE) AS window_end, count(*) AS event_count FROM w JOIN e ON e.event_type = w.event_type AND d >= s AND d < s + INTERVAL 7 DAY GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_start) - 1 AS window_index FROM a""",
    "count_window_100_50": """
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_id, row_number() OVER (ORDER BY CAST(ts AS DATE), ts, event_id) - 1 AS r FROM events), n AS (SELECT count(*) AS n FROM e),
w AS (SELECT unnest(range(0, (n - 100) // 50 + 1)) AS window_index FROM n)
SELECT window_index, min(d) AS start_date, max(d) AS end_date, count(*) AS event_count, CAST(sum(event_id) AS BIGINT) AS id_sum FROM w JOIN e ON r >= window_index * 50 AND r < window_index * 50 + 100 GROUP BY window_index""",
    "incremental_window_events": """
SELECT row_number() OVER o - 1 AS window_index, min(CAST(ts AS DATE)) OVER () AS start_date, CAST(ts AS DATE) AS end_date, row_number() OVER o AS event_count, event_id AS new_event
FROM events WINDOW o AS (ORDER BY CAST(ts AS DATE), ts, event_id)""",
    "incremental_window_daily": """
WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id FROM events), days AS (SELECT DISTINCT d FROM e)
SELECT days.d AS event_date, count(*) AS events_so_far, count(DISTINCT user_id) AS users_so_far FROM days JOIN e ON e.d <= days.d GROUP BY days.d""",
    "window_summary": f"""
SELECT count(*) AS n_windows, CAST(sum(event_count) AS BIGINT) AS total_events, round(avg(event_count), 6) AS mean_events, min(event_count) AS min_events, max(event_count) AS max_events FROM ({_date_window_sql(7, 1)})""",
    "tumbling_topic_windows": """
WITH a AS (SELECT source AS topic, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS d, n_chars FROM documents), b AS (SELECT *, min(d) OVER (PARTITION BY topic) AS lo FROM a),
g AS (SELECT topic, CAST(lo + CAST((d - lo) // 5 * 5 AS INTEGER) AS DATE) AS window_start, count(*) AS event_count, CAST(sum(n_chars) AS BIGINT) AS chars FROM b GROUP BY ALL)
SELECT *, CAST(window_start + 5 AS DATE) AS window_end, row_number() OVER (PARTITION BY topic ORDER BY window_start) - 1 AS window_index FROM g""",
    "windows_on_date": f"""
SELECT window_index, window_start, event_count FROM ({_date_window_sql(7, 1)}) WHERE window_start <= DATE '2024-01-10' AND window_end > DATE '2024-01-10'""",
    "events_in_range": "SELECT event_type, count(*) AS n FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12' GROUP BY event_type",
    "window_date_semi_join": """
WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM events), v AS (SELECT d FROM e WHERE value > 90), b AS (SELECT min(d) AS lo FROM v),
i AS (SELECT DISTINCT d, datediff('day', lo, d) // 7 AS j FROM v, b), w AS (SELECT d, dense_rank() OVER (ORDER BY j) - 1 AS window_index FROM i)
SELECT window_index, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM w JOIN e ON e.d = w.d WHERE event_type = 'purchase' GROUP BY window_index""",
    "asof_no_leak_articles": f"""
WITH {_HELD} SELECT q.window_index, q.event_id AS question_id, count(*) AS n_articles, max(a.d) AS latest FROM h q JOIN h a ON q.window_index = a.window_index AND q.user_id = a.user_id AND a.d <= q.d
WHERE q.event_type = 'purchase' AND a.event_type = 'click' GROUP BY ALL""",
    "asof_structured_context": f"""
WITH {_HELD} SELECT q.event_id AS question_id, string_agg('[' || strftime(a.d, '%Y-%m-%d') || '] ' || a.event_type || ': ' || json_extract_string(a.props, '$.k'), chr(10) ORDER BY a.d, a.event_id) AS context
FROM h q JOIN h a ON q.window_index = a.window_index AND q.user_id = a.user_id AND a.d <= q.d WHERE q.event_type = 'purchase' AND a.event_type <> 'purchase' GROUP BY q.event_id""",
    "order_line_range_join": """
WITH s AS (SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM s JOIN orders ON CAST(o_orderdate AS DATE) >= d AND CAST(o_orderdate AS DATE) < d + 10 GROUP BY l_suppkey""",
}
