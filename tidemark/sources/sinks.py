"""Writing results: ordered CSV by year, JSON, caches that are upserted, and appends that resume by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .written import Scratch


def with_header(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    """Only the header's columns, in its order; missing ones are empty."""
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in header])


def write_csv_by_year(rows: DataFrame, path: str, header: Sequence[str], order: Sequence[str]) -> None:
    """A folder a year; its files in the order of their names are in the order of ``order``. Ranges, so that a large year is several tasks."""
    out = with_header(rows, header).withColumn("_year", F.col("year")).repartitionByRange("_year", *order).sortWithinPartitions("_year", *order)
    out.write.mode("overwrite").partitionBy("_year").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, first: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Keys in column order, those of ``first`` in front."""
    rows.select(*first, *[c for c in rows.columns if c not in first]).write.mode(mode).json(path)


def write_per_file(rows: DataFrame, path: str, file: str = "file") -> None:
    """One folder of JSON per input file, named by it; large ones are split among tasks."""
    rows.withColumn("input", F.regexp_extract(file, r"([^/]+?)(?:\.json)?$", 1)).hint("rebalance", "input").write.mode("overwrite").partitionBy("input").json(path)


def write_with_backup(spark: SparkSession, rows: DataFrame, path: str, stamp: str) -> str | None:
    """Writes JSON; what was there is renamed with the stamp first, and its new path returned."""
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = f"{path.rstrip('/')}.backup-{stamp}" if fs.exists(old) else None
    if kept:
        fs.rename(old, jvm.org.apache.hadoop.fs.Path(kept))
    rows.write.mode("error").json(path)
    return kept


def annotation_rows(rows: DataFrame, texts: str = "event_text", choices: str = "choices", cut: int = 5000) -> DataFrame:
    """Choices as four columns, lists joined, and articles joined with a rule and cut."""
    letters = {f"choice_{x}": F.try_element_at(choices, F.lit(x)) for x in "abcd"}
    joined = F.substring(F.array_join(texts, "\n\n---\n\n"), 1, cut)
    lists = {f.name: F.array_join(f.name, ", ") for f in rows.schema if f.dataType.typeName() == "array" and f.name != texts}
    return rows.withColumns(letters | lists | {texts: joined}).drop(choices)


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose keys aren't stored yet and returns their number; a restart goes on where it stopped.

    The rows to be added are written beside the table first, so what is counted is what is appended."""
    scratch = Scratch(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there:
        rows = rows.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    new = scratch.write(rows, "new")
    n = new.count()
    if n or not there:
        new.write.mode("append").parquet(path)
    scratch.drop(new)
    return n


def upsert(spark: SparkSession, cache: DataFrame | None, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cache with the rows' keys replaced; the caller writes it to a new version."""
    if cache is None:
        return rows
    return cache.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)
