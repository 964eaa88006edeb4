"""A sink for responses that holds each batch once, however often it is written."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..storage import file_system

#: Lines that a task writes at once.
LINES = 10_000


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: a file's name and its lines; no file for a task without rows."""

    name: str | None
    lines: int


class _Batches:
    """Tasks write files of their own; a batch is there once its list of files is, which is one file and comes last.

    A batch that is already listed stays as it is, and the new files go. So a batch that is
    written again, after a failure of the driver between the commit and Spark's own note of it, counts once.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator[Row]) -> Staged:
        fs, root = file_system(self.path)
        name, lines, held, out = f"files/{uuid.uuid4().hex}.json", 0, [], None
        for r in rows:
            held.append(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))
            lines += 1
            if len(held) >= LINES or out is None:
                if out is None:
                    fs.create_dir(f"{root}/files")
                    out = fs.open_output_stream(f"{root}/{name}")
                out.write(("\n".join(held) + "\n").encode())
                held = []
        if held:
            out.write(("\n".join(held) + "\n").encode())
        if out is not None:
            out.close()
        return Staged(name if lines else None, lines)

    def commit_batch(self, messages: list[Staged | None], batch: int) -> None:
        from pyarrow.fs import FileType

        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/batches")
        where = f"{root}/batches/{batch}.json"
        if fs.get_file_info(where).type != FileType.NotFound:
            return self.remove(messages)
        staged = f"{root}/batches/.{uuid.uuid4().hex}"
        with fs.open_output_stream(staged) as out:
            out.write(json.dumps({"files": [m.name for m in messages if m and m.name], "lines": sum(m.lines for m in messages if m)}).encode())
        fs.move(staged, where)

    def remove(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class _BatchWriter(_Batches, DataSourceWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.batch = int(options["batch"])

    def commit(self, messages) -> None:
        self.commit_batch(messages, self.batch)

    def abort(self, messages) -> None:
        self.remove(messages)


class _StreamWriter(_Batches, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self.commit_batch(messages, batchId)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self.remove(messages)


class Responses(DataSource):
    """Format "responses", for ``write`` with the options path and batch, a number, and for ``writeStream`` with path. The path is a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def writer(self, schema: StructType, overwrite: bool) -> _BatchWriter:
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(dict(self.options))


def write_responses(answers: DataFrame, path: str, batch: int) -> None:
    """Writes answers as a batch of the sink at path, once however often it is called; fits score_stream()'s sink with the path given."""
    answers.sparkSession.dataSource.register(Responses)
    answers.write.format("responses").mode("append").option("path", path).option("batch", batch).save()


def read_responses(spark: SparkSession, path: str, schema: str = "event_id long, status int, response string") -> DataFrame:
    """The rows of all batches that are there as a whole."""
    from pyarrow.fs import FileSelector

    fs, root = file_system(path)
    files = []
    for f in fs.get_file_info(FileSelector(f"{root}/batches", allow_not_found=True)):
        if not f.base_name.startswith("."):
            with fs.open_input_stream(f.path) as lines:
                files += [f"{path.rstrip('/')}/{name}" for name in json.loads(lines.read())["files"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
