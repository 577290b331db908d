"""JSON lines that a job writes whole or not at all, once a run: a Spark data source.

    spark.dataSource.register(JsonLines)
    rows.write.format("corvane_jsonl").mode("append").option("path", folder).option("run", run_id).save()

Each task writes a file of its own under a name that readers pass over; committing the job renames them and marks the run as done;
an aborted job deletes them. A run that is marked already is not written again. The folder must be one that all executors see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


def _plain(v: object) -> object:
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


class Writer(DataSourceWriter):
    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path.rstrip("/"), run

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _done(self, files: fs.FileSystem, root: str) -> bool:
        return files.get_file_info(f"{root}/_done-{self.run}").type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._files()
        if self._done(files, root):
            for _ in iterator:
                pass
            return Written(None, 0)
        files.create_dir(root, recursive=True)
        name, n = f"{self.run}-{uuid.uuid4().hex}", 0
        with files.open_output_stream(f"{root}/.{name}") as out:
            for row in iterator:
                out.write((json.dumps(_plain(row), ensure_ascii=False, sort_keys=True) + "\n").encode())
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._files()
        if self._done(files, root):
            return self.abort(messages)
        for m in messages:
            if m and m.name:
                files.move(f"{root}/.{m.name}", f"{root}/{m.name}.jsonl")
        with files.open_output_stream(f"{root}/_done-{self.run}") as out:
            out.write(str(sum(m.rows for m in messages if m)).encode())
        return None

    def abort(self, messages: list[Written | None]) -> None:
        """Takes back this run's unfinished files, also those of tasks that could not report."""
        files, root = self._files()
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}-"):
                files.delete_file(f.path)


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvane_jsonl"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a run is appended; delete the folder to start anew")
        if not self.options.get("path") or not self.options.get("run"):
            raise ValueError("the options path and run are needed")
        return Writer(self.options["path"], self.options["run"])
