"""Results as a Python data source: rows in files that a commit makes visible, with configuration, metrics and word counts in front.

A task writes its rows to a file of its own in a staging folder and names it in its commit message.  The driver renames the
files and then writes the head, ``results.json``: configuration and metrics first, then how many rows and words there are
and which files hold them.  Readers go by the head alone, so a run that fails, a task that was killed and an attempt that
was beaten by another leave nothing that is read, and an abort removes what they staged.  Appending writes a new head that
names old and new files.

    spark.dataSource.register(ResultSource)
    rows.write.format("tidemark_results").mode("overwrite").option("config", json).option("metrics", json).option("words", "summary").save(path)
    read_results(spark, path)

Defined cases: a null or empty text has no words; no rows give a head without files; nulls stay nulls; columns of any type
that JSON can hold; paths of any file system that pyarrow reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEAD, STAGED = "results.json", "_staged"


def file_system(path: str):
    """The file system of a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.rstrip("/")) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


@dataclass
class Written(WriterCommitMessage):
    file: str = ""
    rows: int = 0
    words: dict[str, int] = field(default_factory=dict)


def plain(value):
    """A row's value as JSON holds it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


class ResultWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:12]
        self.config, self.metrics = (json.loads(options.get(k, "{}")) for k in ("config", "metrics"))
        self.counted = [c for c in options.get("words", "").split(",") if c]
        self.names = schema.fieldNames()
        missing = set(self.counted) - set(self.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))} to count the words of")

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = file_system(self.path)
        name, rows, words = f"part-{task.partitionId():05d}-{self.run}-{task.attemptNumber()}.jsonl", 0, dict.fromkeys(self.counted, 0)
        out = None
        for row in iterator:
            if out is None:
                system.create_dir(f"{root}/{STAGED}/{self.run}", recursive=True)
                out = system.open_output_stream(f"{root}/{STAGED}/{self.run}/{name}")
            out.write((json.dumps(dict(zip(self.names, map(plain, row))), ensure_ascii=False) + "\n").encode())
            rows += 1
            for c in self.counted:
                words[c] += len(str(row[c] or "").split())
        if out is not None:
            out.close()
        return Written(name if out is not None else "", rows, words)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        new = [m for m in messages if m is not None]
        before = {} if self.overwrite else head(self.path)
        for m in new:
            if m.file:
                system.move(f"{root}/{STAGED}/{self.run}/{m.file}", f"{root}/{m.file}")
        old = [] if self.overwrite is False else _files(system, root)
        made = {
            "config": self.config, "metrics": self.metrics, "rows": before.get("rows", 0) + sum(m.rows for m in new),
            "words": {c: before.get("words", {}).get(c, 0) + sum(m.words[c] for m in new) for c in self.counted},
            "files": before.get("files", []) + [m.file for m in new if m.file],
        }
        with system.open_output_stream(f"{root}/{STAGED}-{self.run}.json") as f:
            f.write(json.dumps(made, ensure_ascii=False, indent=2).encode())
        system.move(f"{root}/{STAGED}-{self.run}.json", f"{root}/{HEAD}")
        # Only now that no head names them do the files of an older run go.
        for name in set(old) - set(made["files"]):
            system.delete_file(f"{root}/{name}")
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*file_system(self.path))

    def _clean(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{STAGED}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGED}/{self.run}")
        if not system.get_file_info(fs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)) and system.get_file_info(f"{root}/{STAGED}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGED}")


def _files(system, root: str) -> list[str]:
    from pyarrow import fs

    return [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-")]


class ResultSource(DataSource):
    """``tidemark_results``; options: path, config and metrics (JSON objects), words (columns whose words are counted)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_results"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        return ResultWriter(dict(self.options), schema, overwrite)


def head(path: str) -> dict:
    """What a head holds, nothing if there is none."""
    from pyarrow import fs

    system, root = file_system(path)
    if system.get_file_info(f"{root}/{HEAD}").type != fs.FileType.File:
        return {}
    with system.open_input_stream(f"{root}/{HEAD}") as f:
        return json.loads(f.read())


def write_results(spark: SparkSession, rows: DataFrame, path: str, config: dict, metrics: dict, words: tuple[str, ...] = (), mode: str = "overwrite") -> dict:
    """Writes and returns the head."""
    spark.dataSource.register(ResultSource)
    options = {"config": json.dumps(config), "metrics": json.dumps(metrics), "words": ",".join(words)}
    rows.write.format(ResultSource.name()).mode(mode).options(**options).save(path)
    return head(path)


def read_results(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows that the head names."""
    files = head(path).get("files", [])
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/{f}" for f in files]) if files else spark.createDataFrame([], schema)
