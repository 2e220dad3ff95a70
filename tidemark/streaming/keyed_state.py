"""Clusters of stories as keyed state of a stream: a row of state for each cluster, kept in RocksDB, with an end for stories that are over.

The clusters a story shows to the model, ``cap`` at most, are one map of state, those that are hidden another; a document
reads the first and, only if the model names a hidden cluster, one entry of the second.  So what a task holds is bounded by
``cap``, and what the store keeps by the number of clusters, never by documents.  A story without a document for
``expire_after`` in event time loses its state by a timer, and begins anew if it comes back.

The stream needs the RocksDB state store (``use_rocksdb``).  With the same documents in the same order it gives what the
batch form does (``cluster_state.cluster_stories``), and goes on after a restart from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.models import make_client
from ..operators.cluster_state import CAP, Cluster, ClusterState, opening

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "keywords array<string>, size long, updated long"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that maps of state and timers need."""
    spark.conf.set(PROVIDER, ROCKSDB)


class _Held(dict):
    """Clusters by number: the visible ones here, a hidden one as soon as it is asked for."""

    def __init__(self, shown, hidden) -> None:
        super().__init__((k[0], Cluster(list(v[0]), v[1], True, v[2])) for k, v in shown.iterator())
        self.before, self.hidden = set(self), hidden

    def __contains__(self, number: object) -> bool:
        if not super().__contains__(number) and isinstance(number, int) and self.hidden.containsKey((number,)):
            words, size, updated = self.hidden.getValue((number,))
            self[number] = Cluster(list(words), size, False, updated)
        return super().__contains__(number)


class StoryClusters(StatefulProcessor):
    """Assigns a story's documents, in the order of ``order`` within a micro-batch."""

    def __init__(self, names: tuple[str, str, str], order: list[str], cap: int, engine: str, options: dict, time: str | None, expire_after: int) -> None:
        self.story, self.key, self.text = names
        self.order, self.cap, self.engine, self.options, self.time, self.expire_after = order, cap, engine, options, time, expire_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.client = handle, make_client(self.engine, **self.options)
        self.shown = handle.getMapState("shown", "number int", ENTRY)
        self.hidden = handle.getMapState("hidden", "number int", ENTRY)
        self.counters = handle.getValueState("counters", "clock long, numbers int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, numbers, last = self.counters.get() if self.counters.exists() else (0, 0, 0)
        state = _Counted(_Held(self.shown, self.hidden), clock, None, numbers)
        documents = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # of one story in one micro-batch, which the trigger bounds
        found = [(state.assign(self.client, t, self.cap), state.error) for t in documents[self.text]]
        held = state.clusters
        for number, c in held.items():
            entry, to, other = (list(c.keywords), c.size, c.updated), *((self.shown, self.hidden) if c.visible else (self.hidden, self.shown))
            to.updateValue((number,), entry)
            if other.containsKey((number,)):
                other.removeKey((number,))
        if self.time:
            latest = max(last, int(documents[self.time].max().timestamp() * 1000))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest + self.expire_after)
            last = latest
        self.counters.update((state.clock, state.numbers, last))
        yield pd.DataFrame({self.story: key[0], self.key: documents[self.key], "cluster": [c for c, _ in found], "error": [e for _, e in found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.shown.clear(), self.hidden.clear(), self.counters.clear()
        return iter([])


class _Counted(ClusterState):
    """A state that knows how many clusters there are, as not all of them are at hand."""

    def __init__(self, clusters: dict, clock: int, error: str | None, numbers: int) -> None:
        super().__init__(clusters, clock, error)
        self.numbers = numbers

    def following(self) -> int:
        return self.numbers

    def take(self, number: int, keywords: list[str], cap: int = CAP) -> int:
        found = super().take(number, keywords, cap)
        self.numbers = max(self.numbers, found + 1)
        return found


def cluster_stream_keyed(docs: DataFrame, story: str, key: str, text: str, order: list[str], cap: int = CAP, engine: str = "stub", time: str | None = None, expire_after: int = 0, **options) -> DataFrame:
    """A streaming frame of (story, key, cluster, error). ``time`` names the watermarked column by which stories end ``expire_after`` milliseconds after their last document."""
    kinds = dict(docs.dtypes)
    processor = StoryClusters((story, key, text), order, cap, engine, options, time, expire_after)
    docs = docs.withColumn(text, opening(text))
    return docs.groupBy(story).transformWithStateInPandas(processor, f"{story} {kinds[story]}, {key} {kinds[key]}, cluster int, error string", "Append", "EventTime" if time else "None")
