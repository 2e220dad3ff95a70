"""A ledger of model calls: a prompt is answered once, whatever happens to the run that asked.

Rows are reduced to distinct prompts by a key of prompt, engine and settings; keys whose answers are stored drop out by an
anti-join; the others are dealt into batches.  A task answers a batch and journals it as one file in the shared folder
before it returns the rows, so a task that is repeated, on whatever executor, reads the journal instead of asking again.
When the job has committed the answers to the table, the journal goes.  A run that failed leaves its journal; the next one
takes it into the table first.  What is lost at most is a batch whose answers were on their way.

Answers are joined back to the rows by their keys.  Errors are answers of this run only and are asked again by the next.

Defined cases: a null prompt is answered like an empty one; equal prompts cost one call; an empty table asks nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import make_client
from ..sources.results import file_system
from ..sources.written import Scratch

#: Calls of a batch, which are made and journaled together.
BATCH = 64
ANSWER = "key string, text string, error string"


def call_key(prompt: Column, engine: str, settings: dict) -> Column:
    """One key for the same call: the prompt's characters, the engine and all settings."""
    named = json.dumps([engine, settings], sort_keys=True)
    return F.sha2(F.concat(F.lit(f"{len(named)}:{named}"), F.coalesce(prompt, F.lit(""))).cast("binary"), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, text): the answers of a ledger."""
    answers = f"{path.rstrip('/')}/answers"
    return spark.read.schema("key string, text string").parquet(answers) if _exists(spark, answers) else spark.createDataFrame([], "key string, text string")


def recover(spark: SparkSession, path: str) -> int:
    """Takes the journal of a run that failed into the ledger; how many answers that were."""
    journal = f"{path.rstrip('/')}/journal"
    if not _exists(spark, journal):
        return 0
    found = spark.read.schema(ANSWER).json(f"{journal}/*.jsonl") if _journals(journal) else spark.createDataFrame([], ANSWER)
    new = found.where("error IS NULL AND key IS NOT NULL").select("key", "text").dropDuplicates(["key"]).join(stored(spark, path).select("key"), "key", "left_anti")
    scratch = Scratch(spark)
    kept = scratch.write(new, "recovered")
    n = kept.count()
    if n:
        kept.write.mode("append").parquet(f"{path.rstrip('/')}/answers")
    scratch.drop(kept)
    _remove(spark, journal)
    return n


def _journals(journal: str) -> bool:
    from pyarrow import fs

    system, root = file_system(journal)
    return any(f.base_name.endswith(".jsonl") for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)))


def answered(spark: SparkSession, rows: DataFrame, prompt: Column, path: str, engine: str = "stub", max_tokens: int = 500, temperature: float = 0.7, workers: int = 8, tries: int = 3, batch: int = BATCH, **options) -> DataFrame:
    """``rows`` with the columns answer and answer_error. ``path`` is the ledger's folder, which all executors reach."""
    recover(spark, path)
    scratch, root = Scratch(spark), path.rstrip("/")
    settings = {"max_tokens": max_tokens, "temperature": temperature, **{k: v for k, v in options.items() if isinstance(v, (str, int, float, bool, list, tuple, type(None)))}}
    keyed = scratch.write(rows.withColumn("_key", call_key(prompt, engine, settings)).withColumn("_prompt", F.coalesce(prompt, F.lit(""))), "keyed")
    # Equal prompts combine on the map side; only keys and prompts that have no answer yet go on.
    todo = keyed.groupBy(F.col("_key").alias("key")).agg(F.first("_prompt").alias("prompt")).join(stored(spark, path).select("key"), "key", "left_anti")
    todo = scratch.write(todo, "todo")
    batches = max(1, -(-todo.count() // batch))

    def ask(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client(engine, **options)

        def call(text: str) -> tuple[str | None, str | None]:
            error = ""
            for _ in range(tries):
                try:
                    return client.generate(text, max_tokens, temperature), None
                except Exception as e:  # noqa: BLE001  one bad prompt must not end the run
                    error = f"{type(e).__name__}: {e}"
            return None, error

        with ThreadPoolExecutor(workers) as pool:
            for rows_ in group:
                for _, own in rows_.groupby("batch", sort=True):
                    yield _journaled(f"{root}/journal", own.sort_values("key"), lambda prompts: list(pool.map(call, prompts)))

    dealt = todo.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches))).repartition("batch").sortWithinPartitions("batch")
    # As many rows at once as a batch has, about, so that answers are journaled soon.
    found = scratch.write(dealt.mapInPandas(ask, ANSWER), "found")
    good = found.where("error IS NULL").select("key", "text")
    good.write.mode("append").parquet(f"{root}/answers")
    if _exists(spark, f"{root}/journal"):
        _remove(spark, f"{root}/journal")
    every = stored(spark, path).dropDuplicates(["key"]).withColumn("error", F.lit(None).cast("string")).union(found.where("error IS NOT NULL").select("key", "text", "error"))
    joined = keyed.join(every.select(F.col("key").alias("_key"), F.col("text").alias("answer"), F.col("error").alias("answer_error")), "_key", "left")
    return joined.drop("_key", "_prompt")


def _journaled(journal: str, rows: pd.DataFrame, ask) -> pd.DataFrame:
    """The answers of a batch, from its journal if an earlier attempt wrote one."""
    from pyarrow import fs

    system, root = file_system(journal)
    file = f"{root}/{hashlib.sha256(''.join(rows['key']).encode()).hexdigest()[:32]}.jsonl"
    if system.get_file_info(file).type == fs.FileType.File:
        with system.open_input_stream(file) as f:
            found = [json.loads(x) for x in f.read().decode().splitlines()]
    else:
        found = [{"key": k, "text": t, "error": e} for k, (t, e) in zip(rows["key"], ask(rows["prompt"].tolist()))]
        system.create_dir(root, recursive=True)
        part = f"{file}.{uuid.uuid4().hex[:8]}.part"
        with system.open_output_stream(part) as f:
            f.write("".join(json.dumps(x) + "\n" for x in found).encode())
        system.move(part, file)
    return pd.DataFrame(found, columns=["key", "text", "error"])
