"""All registered queries of the library and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import corpus, evaluation, generation, records, windowing

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (windowing, corpus, evaluation, generation, records)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
