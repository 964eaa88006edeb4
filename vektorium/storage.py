"""Folders for intermediate tables: in the one that the cluster shares, or for a local session in one of its own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder name each time, so that no two runs write to the same place."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="vektorium-")
    return f"{where.rstrip('/')}/vektorium-{uuid.uuid4().hex}"


def file_system(path: str):
    """A pyarrow file system that driver and executors share, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own, so that it is computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that stored() wrote within it; what reads them must have run by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)
