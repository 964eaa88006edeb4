from pyspark.sql import Window
from pyspark.sql import functions as F

from vektorium.plans import queries
from vektorium.sources import fixtures


def test_a_filter_parses_a_request_once(spark, small):
    """A filter on the status goes below the columns it is made of; the body is parsed once there, and once for what is selected."""
    plan = queries.reject_malformed(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3 and plan.count("to_json") <= 3
    spark.catalog.clearCache()


def test_no_sliding_frame(spark, small):
    """A user's last day is told by two frames that only grow."""
    t = fixtures.transactions(spark, small)
    assert "RangeFrame, -86400000000" not in t._jdf.queryExecution().optimizedPlan().toString()
    e = fixtures.events(spark, small).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-fixtures.DAY_US, 0)
    want = {r["event_id"]: r["n"] for r in e.select("event_id", (F.count(F.lit(1)).over(day) - 1).alias("n")).collect()}
    assert {r["event_id"]: r["tx_count_24h"] for r in t.select("event_id", "tx_count_24h").collect()} == want


def test_arriving_files_are_bounded(spark, small, monkeypatch, tmp_path):
    """More requests are more files of the stream, so that a micro-batch stays as it is."""
    made = []
    monkeypatch.setattr(queries, "scratch", lambda spark: made.append(str(tmp_path / f"s{len(made)}")) or made[-1])
    monkeypatch.setattr(queries, "FILE_REQUESTS", 100)
    monkeypatch.setattr(queries, "FILE_MEMBERS", 100)
    assert queries.stream_scores(spark, small).count() == 1_000
    files = [f for p in made for f in __import__("pathlib").Path(p).glob("in/*.json")]
    assert len(files) >= 10
    spark.catalog.clearCache()
