"""A news search service as a Python data source, for tables and for streams.

The service answers one query for one day; a read is the days between ``start`` and ``end``, dealt to at most ``parallel``
tasks that together make at most ``per_second`` calls in a second.  Filters on the date narrow the days before anything is
asked.  A call that meets 429 or a server error is made again after a pause; any other refusal gives no articles for its
day, as does a day without any.  Days are answered in whole, so a task that is repeated gives the same rows as far as the
service does.  A stream's offset is the next day to ask for; it reads up to yesterday, or ``end``.

    register(spark)
    spark.read.format("tidemark_news").option("service", url).option("keywords", '["flood", "dam"]').option("start", "2024-01-01").option("end", "2024-01-31").load()

Defined cases: without keywords nothing is asked; articles without a field have a null there; ``start`` after ``end`` is no day.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .connectors import with_retries

SCHEMA = "date date, rank int, uri string, url string, title string, body string, outlet string"
#: Articles of a day, tasks and calls a second at most, and tries of a call with the seconds between.
COUNT, PARALLEL, PER_SECOND, TRIES, WAIT = 30, 8, 4.0, 3, 60.0


def request_body(keywords: list[str], day: date, count: int, language: str, key: str) -> dict:
    """What the service expects for the articles of one day that hold all keywords, the most relevant first."""
    # The names and settings of the service's interface.
    words = {"keyword": " AND ".join(keywords), "keywordSearchMode": "exact"}
    when = {"dateStart": day.isoformat(), "dateEnd": day.isoformat(), "lang": language}
    settings = {"resultType": "articles", "articlesSortBy": "rel", "articlesCount": count, "includeArticleEventUri": False, "articleBodyLen": -1}
    return {"query": {"$query": {"$and": [words, when]}}, **settings, "apiKey": key}


def articles_of(answer: str) -> list[dict]:
    """The articles of an answer; none if it holds none."""
    try:
        held = json.loads(answer)
    except ValueError:
        return []
    found = held.get("articles") if isinstance(held, dict) else None
    results = found.get("results") if isinstance(found, dict) else None
    return [r for r in results or [] if isinstance(r, dict)]


@dataclass
class Days(InputPartition):
    """The days that a task asks for, one after another."""

    days: tuple[date, ...]

    def __init__(self, days: tuple[date, ...]) -> None:
        self.days = days


class _Service:
    def __init__(self, options: dict[str, str]) -> None:
        get = lambda k, default: type(default)(options.get(k, default))
        self.url, self.key, self.language = options["service"], options.get("api_key", ""), options.get("language", "eng")
        self.keywords = [w for w in json.loads(options.get("keywords", "[]")) if w]
        self.count, self.parallel, self.per_second, self.tries, self.wait = get("count", COUNT), get("parallel", PARALLEL), get("per_second", PER_SECOND), get("tries", TRIES), get("wait", WAIT)

    def dealt(self, days: list[date]) -> list[Days]:
        """Every n-th day to each task, so that busy weeks don't meet in one."""
        if not self.keywords:
            return [Days(())]
        n = max(1, min(self.parallel, len(days)))
        return [Days(tuple(days[i::n])) for i in range(n)]

    def post(self, day: date) -> str:
        body = json.dumps(request_body(self.keywords, day, self.count, self.language, self.key)).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "User-Agent": "tidemark"})
        with urllib.request.urlopen(request, timeout=60.0) as response:
            return response.read().decode("utf-8", "replace")

    def rows(self, days: tuple[date, ...], at_once: int) -> Iterator[tuple]:
        pause, last = at_once / self.per_second, 0.0
        for day in days:
            time.sleep(max(0.0, last + pause - time.monotonic()))
            last = time.monotonic()
            answer, _ = with_retries(lambda _: self.post(day), self.url, self.tries, self.wait)
            for rank, a in enumerate(articles_of(answer or "")):
                outlet = a.get("source")
                yield day, rank, a.get("uri"), a.get("url"), a.get("title"), a.get("body"), outlet.get("title") if isinstance(outlet, dict) else outlet


def span(first: date, last: date) -> list[date]:
    return [first + timedelta(i) for i in range((last - first).days + 1)]


class NewsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.service = _Service(options)
        self.days = span(date.fromisoformat(options["start"]), date.fromisoformat(options["end"]))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the date choose the days; Spark applies the others."""
        tests = {EqualTo: lambda d, v: d == v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v, In: lambda d, v: d in v}
        for f in filters:
            if type(f) in tests and f.attribute == ("date",):
                self.days = [d for d in self.days if tests[type(f)](d, f.value)]
            else:
                yield f

    def partitions(self) -> list[Days]:
        return self.service.dealt(self.days)

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.service.rows(partition.days, min(self.service.parallel, max(1, len(self.days))))


class NewsStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.service, self.start, self.end = _Service(options), options["start"], options.get("end")

    def initialOffset(self) -> dict:
        return {"day": self.start}

    def latestOffset(self) -> dict:
        done = date.today() - timedelta(1)
        last = min(done, date.fromisoformat(self.end)) if self.end else done
        return {"day": max(date.fromisoformat(self.start), last + timedelta(1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Days]:
        return self.service.dealt(span(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(1)))

    def read(self, partition: Days) -> Iterator[tuple]:
        return self.service.rows(partition.days, self.service.parallel)

    def commit(self, end: dict) -> None:
        pass


class NewsSource(DataSource):
    """``tidemark_news``; options: service, keywords (a JSON list), start, end, and api_key, language, count, parallel, per_second, tries, wait."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_news"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NewsReader:
        return NewsReader(dict(self.options))

    def streamReader(self, schema: StructType) -> NewsStream:
        return NewsStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets its filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NewsSource)
