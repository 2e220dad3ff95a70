"""Intermediate tables in the folder that driver and executors share: they cut lineage, and a lost executor costs a read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming.folders import checkpoint_folder

#: Rows of an Arrow batch at most while a table is written.
BATCH_ROWS, BATCH_KEY = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Frees the shuffle files of a query at its end.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one computation. ``drop`` removes those whose readers have all been written; the rest goes with the JVM."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, checkpoint_folder(spark), 0
        path, fs = self._path(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written once and read back with its schema.

        While it is written, Arrow batches are small, as texts may be long, and shuffle files go with the query."""
        self.n += 1
        folder = f"{self.root}/{self.n:04d}-{label}"
        conf, held = self.spark.conf, {k: self.spark.conf.get(k, None) for k in (BATCH_KEY, CLEAN_KEY)}
        try:
            if not 0 < int(held[BATCH_KEY] or 0) <= BATCH_ROWS:
                conf.set(BATCH_KEY, BATCH_ROWS)
            conf.set(CLEAN_KEY, "true")
            df.write.parquet(folder)
        finally:
            for k, v in held.items():
                conf.unset(k) if v is None else conf.set(k, v)
        back = self.spark.read.schema(df.schema).parquet(folder)
        back._folder = folder
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = self._path(t._folder)
            fs.delete(path, True)
