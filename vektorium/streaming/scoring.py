"""Scoring of a stream of HTTP requests, micro-batch by micro-batch. Requests carry their history, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.features import request_features
from ..functions.scalars import quantize_vector, verdict_json
from ..operators.index import Index
from ..operators.search import index_adaptive
from ..schema import FAST_PROBES, FULL_PROBES
from ..sources.requests import route_all
from ..storage import stored, temporary

REQUESTS = "event_id long, raw string"


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of (event_id, raw) from JSON files that arrive in a folder."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def answer(requests: DataFrame, index: Index, fast: int = FAST_PROBES, full: int = FULL_PROBES) -> DataFrame:
    """(event_id, status, response): the verdict for a valid scoring request, null for any other. Requests are read and parsed once; their status and features are stored."""
    asked = (F.col("status") == 200) & (F.col("method") == "POST")
    routed = route_all(requests).select("event_id", "status", asked.alias("asked"), F.when(asked, F.col("request")).alias("request"))
    # features are stored before they are quantised, as a function of an array's elements is not compiled, and what it is given neither
    held = stored(routed.select("event_id", "status", "asked", F.array(*request_features(F.col("request"))).alias("features")))
    queries = held.where("asked").select(F.col("event_id").alias("query_id"), quantize_vector(F.col("features")).alias("q"))
    votes = index_adaptive(index, queries, fast, full)
    return held.select("event_id", "status").join(votes.select(F.col("query_id").alias("event_id"), verdict_json(F.col("votes")).alias("response")), "event_id", "left")


def score_stream(requests: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, **probes) -> StreamingQuery:
    """Starts a query that answers each micro-batch and hands it to sink(answers, batch_id); a sink that writes by batch_id makes it exactly once.

    Micro-batches travel to the index, which Index.keep() holds in the executors; the tables that
    a micro-batch stores go when its sink has returned.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with temporary(batch.sparkSession):
            sink(answer(batch, index, **probes), batch_id)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
