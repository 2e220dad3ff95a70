"""The ledger of model calls, results with a commit, the prefix join, one row per key and seeded stories."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.operators import cluster_state as cs
from tidemark.operators import joins
from tidemark.plans import ledger
from tidemark.sources import results

# -------------------------------------------------------------------------------------------------------------- ledger


class Counting:
    """Writes down each call; a prompt with 'broken' raises, one with 'deadly' ends the task while the file 'armed' is there."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def generate(self, prompt: str, max_tokens: int = 500, temperature: float = 0.7) -> str:
        with open(f"{self.folder}/calls", "a") as f:
            f.write(prompt + "\n")
        if "broken" in prompt:
            raise RuntimeError("no")
        if "deadly" in prompt and os.path.exists(f"{self.folder}/armed"):
            raise SystemExit("the executor is gone")
        return prompt.upper()


@pytest.fixture
def asked(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(models.ENGINES, "counting", Counting)

    def ask(prompts: list, batch: int = 4) -> dict:
        rows = spark.createDataFrame(list(enumerate(prompts)), "k long, p string").repartition(3)
        # The class is sent along, as workers know only the engines of the library.
        engines = dict(models.ENGINES)
        monkeypatch.setattr(ledger, "make_client", lambda engine, **o: engines[engine](**o))
        out = ledger.answered(spark, rows, F.col("p"), f"file://{tmp_path}/ledger", "counting", batch=batch, workers=2, tries=2, folder=str(tmp_path)).collect()
        assert len(out) == len(prompts)
        return {r.k: (r.answer, r.answer_error) for r in out}

    calls = lambda: sorted((tmp_path / "calls").read_text().splitlines()) if (tmp_path / "calls").exists() else []
    return ask, calls, tmp_path


def test_a_prompt_is_asked_once_over_repeated_runs(asked, spark):
    ask, calls, folder = asked
    found = ask(["a", "b", "a", None, "", "broken x"])
    assert {k: v for k, v in found.items() if k < 5} == {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: ("", None), 4: ("", None)}
    assert found[5][0] is None and "RuntimeError" in found[5][1]
    assert calls() == sorted(["a", "b", "", "broken x", "broken x"])
    again = ask(["b", "c", "a"])
    assert again == {0: ("B", None), 1: ("C", None), 2: ("A", None)} and len(calls()) == 6
    ask(["broken x"])
    assert len(calls()) == 8 and ledger.stored(spark, f"file://{folder}/ledger").count() == 4
    assert ask([]) == {}


def test_a_failed_run_pays_for_no_answer_again(asked, spark):
    ask, calls, folder = asked
    (folder / "armed").write_text("")
    prompts = [f"p{i}" for i in range(30)] + ["deadly"]
    with pytest.raises(Exception):
        ask(prompts, batch=2)
    before = calls()
    journaled = [json.loads(x)["key"] for f in (folder / "ledger/journal").glob("*.jsonl") for x in f.read_text().splitlines()]
    assert journaled and not (folder / "ledger/answers").exists()
    (folder / "armed").unlink()
    found = ask(prompts, batch=2)
    assert found == {i: (p.upper(), None) for i, p in enumerate(prompts)}
    # All that was journaled is taken over; only the batches that were on their way are asked again.
    assert len(calls()) == len(prompts) + len(before) - len(journaled) and not (folder / "ledger/journal").exists()


# ------------------------------------------------------------------------------------------------------------- results


def test_results_read_back(spark, tmp_path):
    path = f"{tmp_path}/r"
    rows = spark.createDataFrame([(i, f"a b {i}" if i % 3 else None, [i, None], {"x": i / 2}) for i in range(20)], "k long, t string, l array<long>, m map<string,double>").repartition(3)
    made = results.write_results(spark, rows, path, {"model": "é"}, {"f1": 0.5}, ("t",))
    assert list(made)[:2] == ["config", "metrics"] and made["config"] == {"model": "é"} and made["rows"] == 20 and made["words"] == {"t": 39}
    back = results.read_results(spark, path, rows.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    more = results.write_results(spark, rows.where("k < 2"), path, {"model": "b"}, {}, ("t",), mode="append")
    assert more["rows"] == 22 and more["words"] == {"t": 42} and results.read_results(spark, path, rows.schema).count() == 22
    less = results.write_results(spark, rows.where("k = 5"), path, {}, {}, ("t",))
    assert less["rows"] == 1 and results.read_results(spark, path, rows.schema).count() == 1
    assert sorted(os.listdir(path)) == sorted(["results.json", *less["files"]])
    assert results.write_results(spark, rows.where("k < 0"), path, {}, {})["files"] == [] and results.read_results(spark, path, rows.schema).collect() == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/r"
    rows = spark.createDataFrame([(i, "x") for i in range(40)], "k long, t string").repartition(4)
    before = results.write_results(spark, rows, path, {}, {})
    bad = rows.withColumn("t", F.when(F.col("k") == 33, F.raise_error(F.lit("killed"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="killed"):
        results.write_results(spark, bad, path, {}, {})
    assert results.head(path) == before and sorted(os.listdir(path)) == sorted(["results.json", *before["files"]])
    assert results.read_results(spark, path, rows.schema).count() == 40
    with pytest.raises(Exception, match="count the words"):
        results.write_results(spark, rows, path, {}, {}, ("missing",))


# --------------------------------------------------------------------------------------------------------------- joins


def test_prefix_join_is_the_plain_one(spark):
    markers = [(m,) for m in ("cite_note-1", "cite_note-12", "cite_note-x", "cite_note-", "z", None)]
    refs = [(f"cite_note-{i}", 100 - i) for i in range(30)] + [("cite_note-12", 0), ("cite_note-x-long", 3), (None, 1), ("c", 2)]
    out = joins.exact_then_prefix(spark.createDataFrame(markers, "m string"), spark.createDataFrame(refs, "r string, at long"), "m", "r", "at")
    expected = {}
    for (m,) in markers:
        near = sorted((r != m, at, r) for r, at in refs if r is not None and m is not None and r.startswith(m))
        expected[m] = near[0][2] if near else None
    assert {r.m: r.r for r in out.collect()} == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "substring(r" in plan and "CartesianProduct" not in plan


def test_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", None, "n"), ("a", 1, "x"), (None, 5, "z")], "k string, at long, v string")
    assert {r.k: r.v for r in joins.one_per_key(df, ["k"], "at").collect()} == {"a": "n", None: "z"}
    last = joins.one_per_key(df, ["k"], "at", last=True)
    assert last.columns == df.columns and {r.k: r.v for r in last.collect()} == {"a": "y", None: "z"}
    assert "Window" not in last._jdf.queryExecution().executedPlan().toString()


def test_stories_go_on_from_topics(spark):
    rows = [("s", i, True, t, w, x) for i, t, w, x in ((0, 1, ["stone"], "q"), (1, 0, ["apple"], "q"), (2, -1, None, "q"), (3, None, None, "q"), (4, 0, ["apple"], "q"))]
    rows += [("s", 5, False, None, None, "stone stone"), ("s", 6, False, None, None, "apple"), ("s", 7, False, None, None, "else entirely")]
    df = spark.createDataFrame(rows, "story string, at long, head boolean, topic int, words array<string>, text string")
    found = {r.at: r.cluster for r in cs.cluster_incrementally(df, "story", "at", "text", ["at"], "head", topics=("topic", "words")).collect()}
    assert found == {0: 1, 1: 0, 2: -1, 3: -1, 4: 0, 5: 1, 6: 0, 7: 2}
    state = cs.ClusterState()
    assert [state.adopt(n, [], cap=2) for n in (0, 1, 2)] == [0, 1, 2] and [i for i, c in state.clusters.items() if c.visible] == [0, 1]
