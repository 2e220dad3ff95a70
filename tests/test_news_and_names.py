"""The news source against a local stand-in of the service, and names against planted ones."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import proper_nouns
from tidemark.operators import names
from tidemark.plans import clustering_metrics as cm
from tidemark.sources.news import register


@pytest.fixture
def service(spark):
    """Two articles a day; the 3rd fails once with 503, the 4th always with 400, the 5th has no articles, the 6th no JSON."""
    asked: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            words, when = body["query"]["$query"]["$and"]
            day = when["dateStart"]
            asked[day] += 1
            code = 503 if day.endswith("-03") and asked[day] == 1 else 400 if day.endswith("-04") else 200
            results = [{"uri": f"{day}/{i}", "title": words["keyword"], "body": f"n={body['articlesCount']}", "source": {"title": "o"}} for i in range(0 if day.endswith("-05") else 2)]
            answer = b"oops" if day.endswith("-06") else json.dumps({"articles": {"results": results}}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    options = {"service": f"http://127.0.0.1:{server.server_port}/", "keywords": '["flood", "dam"]', "start": "2024-01-01", "end": "2024-01-08", "per_second": "1000", "wait": "0.01", "count": "7"}
    yield options, asked
    server.shutdown()


def test_days_are_read_in_several_tasks(spark, service):
    options, asked = service
    df = spark.read.format("tidemark_news").options(**options, parallel="3").load()
    found = df.withColumn("part", F.spark_partition_id()).collect()
    assert {str(r.date)[-2:] for r in found} == {"01", "02", "03", "07", "08"} and len(found) == 10 and {r.part for r in found} == {0, 1, 2}
    assert asked == {f"2024-01-0{i}": 2 if i == 3 else 1 for i in range(1, 9)}
    assert {(r.title, r.body, r.outlet, r.url) for r in found} == {("flood AND dam", "n=7", "o", None)} and {r["rank"] for r in found} == {0, 1}
    assert spark.read.format("tidemark_news").options(**options | {"keywords": "[]"}).load().collect() == []
    assert spark.read.format("tidemark_news").options(**options | {"start": "2024-02-01"}).load().collect() == []


def test_filters_on_the_date_choose_the_days(spark, service):
    options, asked = service
    df = spark.read.format("tidemark_news").options(**options).load()
    found = df.where("date >= '2024-01-02' AND date < '2024-01-04' AND rank = 1").collect()
    assert sorted(r.uri for r in found) == ["2024-01-02/1", "2024-01-03/1"] and set(asked) == {"2024-01-02", "2024-01-03"}


def test_the_stream_goes_on_where_it_stopped(spark, service, tmp_path):
    options, asked = service

    def run(end: str) -> list:
        stream = spark.readStream.format("tidemark_news").options(**options | {"end": end}).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.uri for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("2024-01-02") == [f"2024-01-0{i}/{k}" for i in (1, 2) for k in (0, 1)]
    assert run("2024-01-07") == [f"2024-01-0{i}/{k}" for i in (1, 2, 3, 7) for k in (0, 1)]
    assert asked["2024-01-01"] == asked["2024-01-02"] == 1


def test_names_are_told_from_capitals(spark):
    rng = np.random.default_rng(4)
    planted, common = ["Paris", "Ana", "Lima", "Oslo"], ["river", "market", "winter", "report", "city", "walks"]
    texts = []
    for i in range(200):
        inside = [str(rng.choice(planted)) if rng.random() < 0.2 else str(rng.choice(common)) for _ in range(7)]
        # Headlines write every word with a capital, now and then.
        inside = [w.capitalize() for w in inside] if i % 12 == 0 else inside
        texts.append(" ".join([inside[0].capitalize(), *inside[1:]]) + ". The end!")
    texts += ["He met Maria Lopez there. Then Maria Lopez left, and Maria Lopez came"] * 3 + [None, "", "Only"]
    docs = spark.createDataFrame([("g", t) for t in texts], "g string, t string")
    places = names.word_places(docs, "g", "t")
    known = {r.name for r in names.names(places).collect()}
    assert known == {w.lower() for w in [*planted, "Maria", "Lopez"]}
    rule = {w for r in docs.select(proper_nouns(F.col("t")).alias("p")).collect() for w in r.p or []}
    assert len(rule & set(planted)) / len(rule) < 0.7  # what a capital alone would take for names
    counts = {r.name: r.n for r in names.name_counts(places, names.names(places), "g").collect()}
    assert counts["paris"] == sum(t.split().count("Paris") + t.split().count("Paris.") for t in texts if t) and counts["maria"] == 9
    pairs = {(r.first, r.second): r.n for r in names.firm_pairs(places, names.names(places)).collect()}
    assert pairs == {("maria", "lopez"): 9}


def test_expected_information_is_the_whole_sum(spark):
    """Terms far from the mean are left out by a bound; the sum over all of them is the same."""
    from math import exp, lgamma, log

    sizes_a, sizes_b = [900, 500, 340, 60], [1000, 700, 99, 1]
    n = sum(sizes_a)
    rng = np.random.default_rng(1)
    truth, predicted = np.repeat(range(4), sizes_a), rng.permutation(np.repeat(range(4), sizes_b))
    found = cm.expected_information(cm.contingency(spark.createDataFrame(list(zip(truth.tolist(), predicted.tolist())), "t long, p long"), "t", "p")).first().emi
    f = lambda x: lgamma(x + 1)
    whole = sum(
        k / n * log(n * k / (a * b)) * exp(f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(k) - f(a - k) - f(b - k) - f(n - a - b + k))
        for a in sizes_a for b in sizes_b for k in range(max(1, a + b - n), min(a, b) + 1)
    )
    assert found == pytest.approx(whole, rel=1e-9)
