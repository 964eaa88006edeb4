"""Labelled reference records: read, checked, encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import encode_label, quantize_vector
from ..schema import DIM, LABELLED


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, gzip or plain. Unknown keys are dropped, broken input fails.

    Such a file is one task; jsonarrays.read_json_arrays() splits an uncompressed one.
    """
    return spark.read.schema(LABELLED).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json_array(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records as JSON arrays, one array in each file, compressed with gzip or as told ("none")."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"line": ["["]})
        first = True
        for b in batches:
            yield pd.DataFrame({"line": [x if first and not k else f",{x}" for k, x in enumerate(b["line"])]})
            first = first and not len(b)
        yield pd.DataFrame({"line": ["]"]})

    text = records.select(F.to_json(F.struct(*records.columns)).alias("line"))
    text.mapInPandas(lines, "line string").write.mode("overwrite").option("compression", compression).text(path)


def to_parquet(records: DataFrame, path: str, files: int) -> None:
    records.repartition(files).write.mode("overwrite").parquet(path)


def valid(records: DataFrame) -> DataFrame:
    """Each record with ``is_valid``: a vector of DIM numbers without nulls, and a label."""
    whole = F.coalesce((F.size("vector") == DIM) & ~F.exists("vector", lambda x: x.isNull()), F.lit(False))
    return records.withColumn("is_valid", whole & F.col("label").isNotNull())


def require_valid(records: DataFrame) -> DataFrame:
    """The records; reading an invalid one raises."""
    checked = valid(records)
    return checked.where(F.when(F.col("is_valid"), F.lit(True)).otherwise(F.raise_error(F.lit("a record needs 14 numbers and a label")).cast("boolean"))).drop("is_valid")


def require_at_least(records: DataFrame, k: int) -> int:
    """The number of records, if there are as many as clusters."""
    n = records.count()
    if n < k:
        raise ValueError(f"{n} records are too few for {k} clusters")
    return n


def quantised(records: DataFrame) -> DataFrame:
    """Vectors as int arrays and labels as 0 and 1; other columns stay."""
    return records.withColumn("v", quantize_vector(F.col("vector"))).withColumn("label", encode_label(F.col("label"))).drop("vector")
