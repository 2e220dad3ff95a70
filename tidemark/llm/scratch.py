"""Intermediate tables in the folder that driver and executors share, and columns by their exact names.

Operators cut lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a lost executor
costs a re-read and never a recomputation from the source.  The folder is read from the session; only where it is unset
and the master is local (tests) a temporary one is chosen.  Tables go when the JVM ends.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread  # noqa: F401  operators take it from here


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder URI below the shared root; created, and removed at the end of the JVM."""
    path = f"{shared_root(spark)}/tidemark/{label}-{uuid.uuid4().hex[:12]}"
    hadoop, fs = _path(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


#: Rows of an Arrow batch at most, as texts may be long.
BATCH_ROWS, BATCH_KEY = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Frees the shuffle files of a query at its end.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the table read back, with the schema it was written with.

    While it is written, Arrow batches are small and shuffle files go with the query; then the settings are what they were."""
    path = f"{new_folder(spark, label)}/t"
    held = {k: spark.conf.get(k, None) for k in (BATCH_KEY, CLEAN_KEY)}
    try:
        if not 0 < int(held[BATCH_KEY] or 0) <= BATCH_ROWS:
            spark.conf.set(BATCH_KEY, BATCH_ROWS)
        spark.conf.set(CLEAN_KEY, "true")
        df.write.parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of long texts goes on soon."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which at its end gives freed memory back to the system: workers live on while later steps need the room."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not every C library can

    return whole


def place(df: DataFrame, name: str) -> int:
    """Where the column of a name is: of its exact spelling, or else of the only spelling there is."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with columns _0, _1 and so on, so that no name in it can clash with another."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def narrowed(df: DataFrame, **wanted: tuple[str, str | None]) -> DataFrame:
    """Only the ``wanted`` columns of ``df``: new name = (name in df, type or None); other columns may have any names."""
    def of(name: str, kind: str | None) -> Column:
        own = F.col(f"_{place(df, name)}")
        return own.cast(kind) if kind else own

    return numbered_columns(df).select(*[of(*v).alias(k) for k, v in wanted.items()])
