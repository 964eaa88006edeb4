"""Scores of a stream of results, after every micro-batch those of all rows so far.

What is kept is a histogram: the counters of the confusion matrix by latency. It is an aggregate
in Spark's own state, partitioned by latency and combined before the shuffle, so a stream needs no
state of its own making, no key is hot, and a score's percentile is exact. It has a row for each different latency.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import COUNTERS, counters, scores
from ..operators.ranges import values_at_totals


def histogram(results: DataFrame, latency: str, unit: float | None = None) -> DataFrame:
    """(latency, n, tp, tn, fp, fn, err) of results (status, approved, expected_approved and a latency), which may be a stream.

    With a unit, latencies are rounded to multiples of it, which bounds the rows; a null latency has a row of its own.
    """
    x = F.col(latency).cast("double")
    x = x if unit is None else F.round(x / F.lit(float(unit))) * F.lit(float(unit))
    return results.groupBy(x.alias("latency")).agg(F.count(F.lit(1)).alias("n"), *counters())


def scored(counts: DataFrame) -> DataFrame:
    """One row: the sums of a histogram's counters, the exact and interpolated ``p99`` of its latencies (null without any), and the scores."""
    timed = counts.where("latency IS NOT NULL")
    n = timed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    p99 = None
    if n:
        at = (n - 1) * 0.99
        low = int(at)
        a, b = values_at_totals(timed, "latency", "n", [low, min(low + 1, n - 1)])
        p99 = a if a == b or at == low else a + (b - a) * (at - low)
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    return scores(sums.withColumn("p99", F.lit(p99).cast("double")))


def score_results(results: DataFrame, latency: str, sink: Callable[[DataFrame, int], None], checkpoint: str, unit: float | None = None) -> StreamingQuery:
    """Starts a query that hands sink(scores, batch_id) the row of scored() over all results so far, after every micro-batch.

    A restart goes on from the checkpoint's histogram. A sink that writes by batch_id holds each row once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            sink(scored(held), batch_id)
        finally:
            held.unpersist()

    return histogram(results, latency, unit).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
