import pytest
from compare import rows_of

from vektorium.plans import oracle, queries

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    spark.catalog.clearCache()
    if name not in SQL:
        assert len(got) > 0
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_stream_answers_like_a_batch(spark, small):
    from vektorium.functions.scalars import verdict_json
    from pyspark.sql import functions as F

    answers = queries.stream_scores(spark, small).where("response IS NOT NULL")
    clusters, members, _ = queries._index(spark, small)
    points = queries.fixtures.vectors(spark, small)
    every = points.select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    votes = queries.search.ivf_adaptive(every, clusters, members, queries.FAST, queries.FULL)
    both = answers.join(votes, answers["event_id"] == votes["query_id"]).select("response", verdict_json(F.col("votes")).alias("want"))
    spark.catalog.clearCache()
    assert both.count() > 300 and both.where("response != want").isEmpty()


def test_streams_leave_no_tables(spark, small, monkeypatch, tmp_path):
    """What micro-batches store goes with them; the index and the sink's files stay."""
    from vektorium import storage

    made = []
    monkeypatch.setattr(storage, "scratch", lambda spark: made.append(str(tmp_path / f"t{len(made)}")) or made[-1])
    queries.stream_scores(spark, small).count()
    spark.catalog.clearCache()
    assert made and not any((tmp_path / f"t{k}").exists() for k in range(len(made)))


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
