"""That nothing is computed again which is known already."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektorium.operators import index, kmeans, search
from vektorium.plans import queries as plans
from vektorium.schema import DIM
from vektorium.sources import fixtures


def test_vectors_are_quantised_by_one_expression(spark, small):
    plan = fixtures.vectors(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-10000") == 1


def test_seeding_meets_each_candidate_once(spark):
    p = spark.createDataFrame([(k, [k * k * (d + 3) % 9_973 for d in range(DIM)]) for k in range(400)], "row_id long, v array<int>")
    k, rounds = 4, 3
    work = spark.sparkContext.accumulator(0)
    assert kmeans.seed_parallel(p, k, 7, rounds, work=work).count() == k
    assert work.value % 400 == 0 and 1 < work.value // 400 < 1 + 4 * rounds * k  # one for each candidate


@pytest.mark.parametrize("scale", [1, 0.37, 1 << 24])
def test_least_distances(monkeypatch, scale):
    """Products of matrices where they are exact, else sums; ties to the first."""
    rng = np.random.default_rng(3)
    points, centres = (rng.integers(-10_000, 10_001, (n, DIM)) * scale for n in (500, 40))
    centres[30:] = centres[:10]
    points[:40] = centres
    monkeypatch.setattr(kmeans, "CELLS", 4_000)
    at, d = kmeans._least(points.astype(np.float64), centres.astype(np.float64))
    want = kmeans._distances(points.astype(np.float64), centres.astype(np.float64))
    assert (at == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all() and at.max() < 30


def test_an_index_assigns_its_members_once(spark, small, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def counted(points, centroids, assign=index.assign):
        seen = F.udf(lambda c: (met.add(1), c)[1], "int").asNondeterministic()
        return assign(points, centroids).withColumn("cluster_id", seen("cluster_id"))

    monkeypatch.setattr(index, "assign", counted)
    clusters, members, _ = plans._index(spark, small)
    n = members.count()
    assert clusters.agg(F.sum("n")).first()[0] == n and met.value == n
    spark.catalog.clearCache()


def test_a_stream_reads_requests_once(spark, small, tmp_path):
    """Answers come from one reading of the requests, whose parts are stored."""
    from vektorium.operators.index import Index, write
    from vektorium.streaming.scoring import answer

    clusters, members, _ = plans._index(spark, small)
    write(clusters, members, str(tmp_path / "i"), files=4)
    met, found = spark.sparkContext.accumulator(0), Index(spark, str(tmp_path / "i"))
    seen = F.udf(lambda raw: (met.add(1), raw)[1], "string").asNondeterministic()
    requests = fixtures.http_requests(spark, small)
    answers = answer(requests.withColumn("raw", seen("raw")), found, plans.FAST, plans.FULL).collect()
    assert sum(r["response"] is not None for r in answers) > 300 and len(answers) == requests.count() == met.value
    found.close()
    spark.catalog.clearCache()


def test_plain_routes_are_those_of_route(spark, small):
    from vektorium.sources.requests import route, route_all

    requests = fixtures.http_requests(spark, small)
    assert sorted(map(str, route_all(requests).collect())) == sorted(map(str, route(requests).collect()))


def test_two_near_cells_bound_the_others(spark):
    """Copies that lie in two cells: the second one's bound the distance beyond which no further cell is met."""
    # 400 places far apart with three members in each of two halves of the last dimension, and members between
    v = [[k % 20 * 500, k // 20 * 500] + [0] * (DIM - 3) + [side * 40] for k in range(400) for side in (0, 1) for _ in range(3)]
    members = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(v)], "row_id long, v array<int>, label int, cluster_id int").cache()
    probed = spark.createDataFrame([(i, v[i], 0, 1) for i in range(0, len(v), 24)], "query_id long, q array<int>, cluster_id int, probe_rank int")
    work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = search.ranked(search.near_cells(*search.cells(members, 3), search.gathered(probed), 5, work), 5, "dist", "row_id").groupBy("query_id").agg(F.max("dist").alias("kth")).collect()
    assert len(found) == 100 and {r["kth"] for r in found} == {1_600}
    assert work[1].value <= 100 * 2 * 4 * DIM


@pytest.mark.parametrize("copies", [False, True])
def test_near_in_block_is_exact(copies):
    """What single precision leaves is measured exactly; with many copies of one vector ties go to the first."""
    rng = np.random.default_rng(11)
    v = rng.integers(-10_000, 10_001, (DIM, 3_000)).astype(float)
    v[:, 100:1_500] = v[:, :1] if copies else v[:, 100:101] + rng.integers(0, 3, (DIM, 1_400))
    q = np.concatenate([v[:, [0, 100, 200, 2_000]].T, rng.integers(-10_000, 10_001, (40, DIM))])
    every = ((q[:, :, None] - v) ** 2).sum(axis=1)
    for cutoff in (np.full(len(q), search.FAR), np.sort(every, axis=1)[:, 3].astype(np.int64)):
        i, j, d, _ = search.near_in_block(q, cutoff, v, 5)
        want = [(a, b, every[a, b]) for a in range(len(q)) for b in np.lexsort((np.arange(3_000), every[a]))[:5] if every[a, b] <= cutoff[a]]
        assert list(zip(i.tolist(), j.tolist(), d.tolist(), strict=True)) == want
