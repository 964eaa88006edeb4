"""Verdicts against expectations: confusion matrix, latency percentile and composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import values_at_ranks

#: Fixed values of the score.
WEIGHTS = {"fp": 1, "fn": 3, "err": 5}
P99_FLOOR, P99_CUT, FAILURE_CUT, EPSILON_FLOOR = 1.0, 2000.0, 0.15, 0.001
SCALE, PENALTY, CUT_SCORE = 1000.0, 300.0, -3000.0


def d(x: float) -> Column:
    return F.lit(x).cast("double")


#: The columns of a confusion matrix.
COUNTERS = ("tp", "tn", "fp", "fn", "err")


def counters() -> list[Column]:
    """The aggregates COUNTERS of results (status, approved, expected_approved): positive is a denied transaction; other statuses than 200 are errors."""
    ok = F.col("status") == 200
    match = F.col("approved") == F.col("expected_approved")
    cases = (ok & match & ~F.col("approved"), ok & match & F.col("approved"), ok & ~match & ~F.col("approved"), ok & ~match & F.col("approved"), ~ok)
    return [F.count_if(F.coalesce(e, F.lit(False))).alias(c) for e, c in zip(cases, COUNTERS, strict=True)]


def confusion(results: DataFrame) -> DataFrame:
    """One row of COUNTERS."""
    return results.agg(*counters())


def percentile99(results: DataFrame, column: str) -> DataFrame:
    """One row with ``p99``, exact and interpolated; null without values. NaN counts as the largest value, beyond infinity, and interpolates to NaN; nulls don't count. No task orders all values."""
    spark = results.sparkSession
    n = results.agg(F.count(column).alias("n")).first()["n"]
    if not n:
        return spark.createDataFrame([(None,)], "p99 double")
    at = (n - 1) * 0.99
    low = int(at)
    found = [float(x) for x in values_at_ranks(results, column, low, min(low + 1, n - 1))]
    a, b = found[0], found[-1]
    return spark.createDataFrame([(a if a == b or at == low else a + (b - a) * (at - low),)], "p99 double")


def scores(counts: DataFrame) -> DataFrame:
    """counts (tp, tn, fp, fn, err, p99) with the weighted errors, rates and scores."""
    c = F.col
    n = c("tp") + c("tn") + c("fp") + c("fn") + c("err")
    weighted = WEIGHTS["fp"] * c("fp") + WEIGHTS["fn"] * c("fn") + WEIGHTS["err"] * c("err")
    share = lambda x: F.when(n > 0, x / n).otherwise(d(0))
    p99_score = F.when(c("p99") <= 0, d(0)).when(c("p99") > P99_CUT, d(CUT_SCORE)).otherwise(d(SCALE) * F.log10(d(SCALE) / F.greatest(c("p99"), d(P99_FLOOR))))
    detection = F.when(c("failure_rate") > FAILURE_CUT, d(CUT_SCORE)).otherwise(d(SCALE) * F.log10(d(1) / F.greatest(c("epsilon"), d(EPSILON_FLOOR))) - d(PENALTY) * F.log10(d(1) + c("weighted_errors")))
    rated = counts.withColumns({"n": n, "weighted_errors": weighted})
    rated = rated.withColumns({"epsilon": share(c("weighted_errors").cast("double")), "failure_rate": share((c("fp") + c("fn") + c("err")).cast("double"))})
    rated = rated.withColumns({"p99_score": p99_score, "detection_score": detection})
    return rated.withColumn("final_score", c("p99_score") + c("detection_score"))


def report(scored: DataFrame) -> DataFrame:
    """One row: the scores rounded for reading, with nulls for what a cut makes meaningless."""
    c = F.col
    cut = c("failure_rate") > FAILURE_CUT
    return scored.select(
        F.round("p99", 2).alias("p99"),
        F.round("p99_score", 2).alias("p99_score"),
        F.struct("tp", "tn", "fp", "fn", "err").alias("breakdown"),
        F.round(F.col("failure_rate") * 100, 2).alias("failure_percent"),
        "weighted_errors",
        F.when(~cut, F.round("epsilon", 6)).alias("epsilon"),
        F.round("detection_score", 2).alias("detection_score"),
        cut.alias("detection_cut"),
        F.round("final_score", 2).alias("final_score"),
    )


def write_report(reported: DataFrame, path: str) -> None:
    """The report as one JSON file in a folder, nulls included."""
    reported.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def label_stats(labelled: DataFrame, label: str) -> DataFrame:
    """One row: total, counts and rates of the two labels."""
    return labelled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 1).alias("fraud_count"),
        F.count_if(F.col(label) == 0).alias("legit_count"),
    ).withColumns({"fraud_rate": F.col("fraud_count") / F.col("total"), "legit_rate": F.col("legit_count") / F.col("total")})
