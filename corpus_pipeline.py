"""A cleaning pipeline over documents: each stage works on all that the one before it kept.

Every stage takes null ids and texts, empty and very long texts, repeated rows, an empty table and
columns of any name besides doc_id and text, and all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorium.llm import decontaminate, lines, pieces, quality, simhash
from vektorium.llm.common import discard, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go: null, empty and short texts among them. Repeated rows share a verdict; there are no ties."""
    return quality.keep_good(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go from the texts, which may end up empty; every document stays, and n_chars follows.

    Null ids and texts stay as they are; rows of one id and equal text get the same result, those of
    one id and different texts are documents of their own, in the order of a hash of the text.
    """
    kept = lines.dedup_lines(spark, docs).drop("__v_lines")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, one row of it if the id is repeated; rows without an id stay. Null and empty texts are near duplicates of each other."""
    return simhash.keep_first(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none. Repeated rows share a verdict."""
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, and whether they decode to it: none for null and empty texts, whose round trip is the empty text. A row for each row."""
    return docs.select("doc_id", F.col("text"), pieces.encoded(spark).alias("e")).select(
        "doc_id",
        F.col("e.ids").alias("ids"),
        F.size("e.ids").cast("long").alias("n_pieces"),
        (F.col("e.decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: Fingerprints and piece segmentations are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again by the next, after which it goes. The last such table stays, as the result reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
