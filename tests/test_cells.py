import numpy as np
import pytest
from pyspark.sql import functions as F

from vektorium.operators import cells, search
from vektorium.schema import DIM


@pytest.fixture(scope="module")
def clumps():
    """2,400 vectors in 60 clumps, 400 of them copies of one, in three clusters."""
    rng = np.random.default_rng(5)
    v = np.clip(rng.integers(0, 9, (60, DIM))[rng.integers(0, 60, 2_400)] * 1200 + rng.integers(-60, 60, (2_400, DIM)), 0, 10_000)
    v[::6] = v[0]
    return v, rng.integers(0, 3, 2_400)


@pytest.fixture(scope="module")
def members(spark, clumps):
    v, cluster = clumps
    return spark.createDataFrame([(k, x.tolist(), k % 2, int(c)) for k, (x, c) in enumerate(zip(v, cluster, strict=True))], "row_id long, v array<int>, label int, cluster_id int").cache()


@pytest.fixture(scope="module")
def probed(spark, clumps):
    v, _ = clumps
    rows = [(k, v[k].tolist(), c, r) for k in range(0, 2_400, 50) for r, c in enumerate((k % 3, (k + 1) % 3), 1)]
    return spark.createDataFrame(rows, "query_id long, q array<int>, cluster_id int, probe_rank int").cache()


def distances(clumps, query, cluster, dims=DIM):
    v, of = clumps
    at = np.flatnonzero(of == cluster)
    return at, ((v[at, :dims] - v[query, :dims]) ** 2).sum(axis=1)


def test_few_pairs_meet(spark, clumps, members, probed, monkeypatch):
    """A query meets the members near to it alone, and finds what all of them give."""
    monkeypatch.setattr(search, "POINT_BLOCK", 16)
    monkeypatch.setattr(cells, "RUN", 3)
    work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = search.ranked(search.near_cells(*search.cells(members), search.gathered(probed), 5, work), 5, "dist", "probe_rank", "row_id").collect()
    every = 0
    for k in range(0, 2_400, 50):
        want = []
        for rank, c in enumerate((k % 3, (k + 1) % 3), 1):
            at, d = distances(clumps, k, c)
            every += len(at)
            want += sorted(zip(d.tolist(), [rank] * len(at), at.tolist(), strict=True))[:5]
        assert [(r["dist"], r["probe_rank"], r["row_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == k] == sorted(want)[:5]
    assert work[1].value < 0.4 * every * DIM


def test_scanned_lists(clumps, members, probed):
    got = {(r["query_id"], r["cluster_id"]): (r["n"], r["nearest"]) for r in search.scanned(probed, members).collect()}
    assert got == {(k, c): (len(d), d.min()) for k in range(0, 2_400, 50) for c in (k % 3, (k + 1) % 3) for d in [distances(clumps, k, c)[1]]}


@pytest.mark.parametrize("limit", [1, 3_000_000, 100_000_000])
def test_filtered_members(clumps, members, probed, monkeypatch, limit):
    monkeypatch.setattr(search, "POINT_BLOCK", 16)
    want = {}
    for k in range(0, 2_400, 50):
        whole, part = (np.concatenate([distances(clumps, k, c, dims)[1] for c in (k % 3, (k + 1) % 3)]) for dims in (DIM, 4))
        if (part < limit).any():
            want[k] = ((part < limit).sum(), whole[part < limit].min())
    assert {r["query_id"]: (r["n"], r["nearest"]) for r in search.filtered(probed, members, 4, limit).collect()} == want


def test_cells_of_few_or_no_members(spark, members, probed):
    held = search.cells(members.limit(0))
    assert held.blocks.count() == 0 and search.top(probed, held).count() == 0 and search.scanned(probed, held).count() == 0
    assert search.filtered(probed, members.limit(0), 4, 100).count() == 0
    assert search.top(probed, members.where("cluster_id = 1 AND row_id % 6 = 0").limit(3)).where("rank > 3").isEmpty()
