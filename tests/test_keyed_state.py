"""Keyed state of a stream against the batch form, over a restart, and the end of stories."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import cluster_state as cs
from tidemark.streaming import keyed_state as ks

SCHEMA = "story string, at long, ts timestamp, text string"


@pytest.fixture
def streamed(spark, tmp_path):
    before = spark.conf.get(ks.PROVIDER, None)
    ks.use_rocksdb(spark)

    def put(n: int, rows: list) -> None:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run(cap: int, **more) -> list:
        docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        if more:
            docs = docs.withWatermark("ts", "0 seconds")
        out = ks.cluster_stream_keyed(docs, "story", "at", "text", ["at"], cap, **more)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").collect()

    yield put, run, tmp_path
    spark.conf.unset(ks.PROVIDER) if before is None else spark.conf.set(ks.PROVIDER, before)


def test_stream_is_the_batch_over_a_restart(spark, streamed):
    put, run, folder = streamed
    rng = np.random.default_rng(0)
    words = [f"{a}{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = [(f"s{i % 2}", i, dt.datetime(2024, 1, 1), " ".join(rng.choice(words, 2))) for i in range(60)]
    put(0, rows[:25]), put(1, rows[25:40])
    run(3)
    put(2, rows[40:])
    found = sorted((r.story, r["at"], r.cluster) for r in run(3))
    batch = cs.cluster_stories(spark.createDataFrame(rows, SCHEMA), "story", "at", "text", ["at"], 3).collect()
    assert found == sorted((r.story, r["at"], r.cluster) for r in batch) and max(c for _, _, c in found) > 3
    state = lambda name: spark.read.format("statestore").option("path", f"{folder}/check").option("stateVarName", name).load()
    shown, hidden = state("shown").count(), state("hidden").count()
    assert shown == 2 * 3 and shown + hidden == len({(s, c) for s, _, c in found})


@pytest.mark.parametrize("name", ["stream_cluster_state", "stream_window_counts", "epoch_windows"])
def test_streams_read_tables_that_are_folders(spark, sf_dir, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    query = catalog.queries()[name]
    assert sorted(map(str, query(spark, str(tmp_path)).collect())) == sorted(map(str, query(spark, sf_dir).collect()))


def test_stories_end(spark, streamed):
    put, run, folder = streamed
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    week = 7 * 86_400_000
    put(0, [("a", 0, day(0), "apple apple"), ("a", 1, day(0), "stone stone"), ("b", 2, day(0), "iron iron")])
    put(1, [("b", 3, day(5), "gold gold")])
    put(2, [("c", 4, day(10), "paper")])  # a is over by now, b is not
    put(3, [("c", 5, day(11), "paper")])
    put(4, [("a", 6, day(11), "other"), ("b", 7, day(11), "other")])
    found = {r["at"]: r.cluster for r in run(5, time="ts", expire_after=week)}
    assert found == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 2}
