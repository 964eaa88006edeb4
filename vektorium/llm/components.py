"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one forest of the local contraction holds at most.
FOREST_EDGES = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each run of at most FOREST_EDGES edges by the stars of its components; the smallest id is the centre."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def stars():
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    n = 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
            n += 1
            if n >= FOREST_EDGES:
                yield stars()
                n = 0
    if parent:
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them. Edges run from larger to smaller ids."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(id, component) for each id at an edge to another id; a component is named by its smallest id.

    Loops, repeated edges and both directions of an edge don't matter; edges with a null end are left
    out; no edges give no rows. Edges are first contracted where they lie, in forests of bounded size,
    which already joins most of a component; then large-star and small-star steps alternate until
    nothing changes. Each step only groups and joins by id, and a hot id's rows are pre-aggregated or
    split. Every step is checkpointed.
    """
    now = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u != v")
    now = cut(now.mapInArrow(_forests, "u long, v long"))
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
        mark = (seen["n"], seen["h"])
        now = cut(_small_star(_large_star(now)))
