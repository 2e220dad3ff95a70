"""Pages and news: fetching with retries as a column, and the same search over a table of documents where there is no network."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[str], str]


def http_fetch(url: str, timeout: float = 30.0) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "tidemark"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read().decode(response.headers.get_content_charset() or "utf-8", "replace")


def with_retries(fetch: Fetcher, url: str, tries: int = 3, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(text, error): waits and tries again after 429 and server errors, gives up at once on other answers."""
    error = "not tried"
    for attempt in range(tries):
        try:
            return fetch(url), None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code != 429 and e.code < 500:
                break
        except Exception as e:  # noqa: BLE001  a page that fails is a row with an error
            error = f"{type(e).__name__}: {e}"
        if attempt + 1 < tries:
            sleep(wait)
    return None, error


def fetched(url: Column | str, fetch: Fetcher = http_fetch, tries: int = 3, wait: float = 60.0) -> Column:
    """struct(text, error) of each URL; fetch distinct URLs and join them back, so that none is fetched twice."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([with_retries(fetch, u, tries, wait) for u in batch], columns=["text", "error"])

    return run(url)


def fetch_table(rows: DataFrame, url: str, fetch: Fetcher = http_fetch, tries: int = 3, wait: float = 60.0) -> DataFrame:
    """(url, text, error) of the distinct URLs of a table."""
    return rows.select(url).where(F.col(url).isNotNull()).distinct().withColumn("_f", fetched(url, fetch, tries, wait)).select(url, "_f.text", "_f.error")


def search(documents: DataFrame, words: Sequence[str], text: str, lang: str, language: str, date: str, day: Column, count: int, *ties: str) -> DataFrame:
    """Documents of a day and language that hold all words, most mentions first."""
    low = F.lower(F.col(text))
    hits = documents.where((F.col(lang) == language) & (F.col(date) == day))
    mentions = F.lit(0)
    for w in words:
        n = F.size(F.split(low, r"\Q" + w.lower() + r"\E")) - 1
        hits, mentions = hits.where(F.contains(low, F.lit(w.lower()))), mentions + n
    return hits.withColumn("mentions", mentions).orderBy(F.desc("mentions"), *ties).limit(count)
