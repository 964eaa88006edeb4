import math
import random

import pytest
from pyspark.sql import functions as F

from vektorium.operators import evaluate
from vektorium.operators.ranges import values_at_totals
from vektorium.streaming.evaluation import histogram, score_results, scored

SCHEMA = "id long, status int, approved boolean, expected_approved boolean, ms double"
SCORES = ["tp", "tn", "fp", "fn", "err", "p99", "n", "weighted_errors", "epsilon", "failure_rate", "p99_score", "detection_score", "final_score"]


def results(spark, ids):
    r = lambda k: random.Random(k)
    rows = [(k, 500 if k % 41 == 0 else 200, k % 3 == 0, (k + (k % 29 == 0)) % 3 == 0 if k % 31 else None, None if k % 53 == 0 else round(r(k).expovariate(0.01), 3)) for k in ids]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    """The scores of the batch operators."""
    counts = evaluate.confusion(df).crossJoin(evaluate.percentile99(df, "ms"))
    return evaluate.scores(counts).select(SCORES).first()


def close(a, b):
    return all(x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True))


def test_each_batch_is_scored_with_all_before_it(spark, tmp_path):
    """Also after a restart, which goes on from the state."""
    source, got = str(tmp_path / "in"), {}

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        score_results(stream, "ms", lambda row, batch: got.update({batch: row.select(SCORES).first()}), str(tmp_path / "checkpoint")).awaitTermination()

    cuts = [0, 700, 701, 1500]
    for a, b in zip(cuts, cuts[1:]):
        results(spark, range(a, b)).coalesce(1).write.mode("append").json(source)
        run()
    last = max(got)
    assert close(got[last], plain(results(spark, range(1500)))) and close(got[0], plain(results(spark, range(700))))
    assert len(got) >= 3


def test_no_results(spark):
    none = results(spark, range(1)).where("false")
    assert scored(histogram(none, "ms")).select(SCORES).first() == plain(none)


def test_a_unit_bounds_the_rows(spark):
    counts = histogram(results(spark, range(2000)), "ms", 10)
    assert counts.count() < 120 and counts.agg(F.sum("n")).first()[0] == 2000
    assert counts.where("latency IS NULL").first()["n"] == 38


INF, NAN = math.inf, math.nan
VALUES = {
    "spread": [random.Random(5).lognormvariate(3, 4) for _ in range(3000)],
    "close": [1e15 + k for k in range(2500)] + [1.0 + k * 2**-52 for k in range(2500)],
    "signs": [-INF, -1e308, -5.0, -0.25, -1e-300, 0.0, 5e-324, 1e-300, 2.0, 1.7e308, 1.797e308, INF, NAN],
    "one": [7.5],
}


@pytest.mark.parametrize("name", VALUES)
def test_ranks_of_weighted_values(spark, name):
    weighted = [(float(x), 1 + k % 5) for k, x in enumerate(VALUES[name])] + [(None, 3), (1.5, 0)]
    every = sorted((x for x, w in weighted if x is not None for _ in range(w)), key=lambda x: (x != x, x))
    n = len(every)
    ranks = list(range(n + 1)) if n < 50 else [0, 1, n // 3, n // 2, n - 2, n - 1, n]
    got = values_at_totals(spark.createDataFrame(weighted, "x double, w long"), "x", "w", ranks)
    assert [repr(x) for x in got] == [repr(x) for x in [every[r] if r < n else None for r in ranks]]
