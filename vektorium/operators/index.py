"""The inverted-file index: clusters with boxes, and their members."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_SIZE, DIM, INDEX_VERSION, TOP_K
from ..sources.records import require_at_least
from . import cells
from .kmeans import MAX_CENTROIDS, assign, centroid_matrix, rounded
from .ranges import numbered
from .tree import Balls, balls

#: Members of a stored block, about.
MEMBER_BLOCK = 4_096
#: Centroids from which on their balls are searched.
TREE_FROM = 1_024
BLOCKS = cells.BLOCKS


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def boxes(members: DataFrame, centroids: DataFrame, dims: int = DIM) -> DataFrame:
    """(cluster_id, bb_min, bb_max, n) for every centroid; those without members have boxes of zeros."""
    at = [F.get("v", F.lit(k)) for k in range(dims)]
    found = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(x) for x in at]).alias("bb_min"), F.array(*[F.max(x) for x in at]).alias("bb_max"))
    zero = F.array_repeat(F.lit(0), dims)
    joined = centroids.select("cluster_id").join(found, "cluster_id", "left")
    return joined.select("cluster_id", F.coalesce("bb_min", zero).alias("bb_min"), F.coalesce("bb_max", zero).alias("bb_max"), F.coalesce("n", F.lit(0)).alias("n"))


def block_offsets(clusters: DataFrame) -> DataFrame:
    """(cluster_id, n_blocks, offset): blocks of BLOCK_SIZE members and the blocks before them. A row a cluster, so one ordered window will do."""
    blocks = clusters.select("cluster_id", F.ceil(F.col("n") / BLOCK_SIZE).cast("long").alias("n_blocks"))
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)).cast("long"))


def block_slots(members: DataFrame) -> DataFrame:
    """members with ``block`` and ``lane``: their place in the cluster by row_id. A hot cluster is numbered in ranges of row_id."""
    placed = numbered(members, "row_id", "cluster_id")
    return placed.withColumns({"block": F.floor(F.col("place") / BLOCK_SIZE).cast("int"), "lane": F.pmod("place", F.lit(BLOCK_SIZE)).cast("int")}).drop("place")


def build(points: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): clusters (cluster_id, c, ci, bb_min, bb_max, n), members (row_id, v, label, cluster_id). Fewer points than clusters raise a ValueError."""
    require_at_least(points, centroids.count())
    members = assign(points, centroids).drop("d")
    return rounded(centroids).join(boxes(members, centroids), "cluster_id"), members


def packed(members: DataFrame, clusters: DataFrame, block: int = MEMBER_BLOCK, dims: int = DIM) -> tuple[DataFrame, DataFrame]:
    """(clusters, blocks): members as rows of binary arrays, and clusters with what search needs to find and prune them.

    A cluster's members are cut into cells of about ``block`` neighbours (cells.packed()), so that a hot
    cluster is many rows and a search reads those whose box is near. ``nearest`` holds distances to the rounded centroid;
    clusters get ``first_block``, ``n_blocks`` and ``nearest``, the TOP_K least of all their blocks.
    """
    ids, ci = centroid_matrix(clusters, "ci")
    places, blocks = cells.packed(members, block, dims, (ids, ci.astype(np.int64)))
    # a row a cluster, of which centroid_matrix() has checked that there are MAX_CENTROIDS at most
    placed = clusters.select("cluster_id").join(F.broadcast(places), "cluster_id", "left")
    return placed.select("cluster_id", F.coalesce("first_block", F.lit(0)).cast("long").alias("first_block"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks")), blocks


def unpacked(blocks: DataFrame, dims: int = DIM) -> DataFrame:
    """The members (row_id, v, label, cluster_id) of blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cluster, n, rows, vectors, labels in zip(*[b[c].to_pylist() for c in ("cluster_id", "n", "rows", "vectors", "labels")], strict=True):
                v = np.frombuffer(vectors, np.int16).reshape(dims, n).T.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(rows, np.int64)), pa.ListArray.from_arrays(np.arange(0, (n + 1) * dims, dims, dtype=np.int32), v.ravel()), pa.array(np.frombuffer(labels, np.int8).astype(np.int32)), pa.array(np.full(n, cluster, np.int32))],
                    ["row_id", "v", "label", "cluster_id"],
                )

    return blocks.select("cluster_id", "n", "rows", "vectors", "labels").mapInArrow(unpack, "row_id long, v array<int>, label int, cluster_id int")


def write(clusters: DataFrame, members: DataFrame, path: str, files: int = 64) -> None:
    """Parquet under path, laid out for search: members as blocks, bucketed and sorted by block, a file a bucket.

    Tables go to a new folder each time; the row of meta data that names it comes last, so a
    reader meets the old index or the new one, never a part of either.
    """
    spark, name = clusters.sparkSession, f"tables-{uuid.uuid4().hex}"
    where, table = f"{path}/{name}", f"index_{uuid.uuid4().hex}"
    placed, blocks = packed(members, clusters)
    try:
        blocks.repartition(files, "block_id").write.format("parquet").bucketBy(files, "block_id").sortBy("block_id").option("path", f"{where}/members").saveAsTable(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # an external table, whose files stay
    held = spark.read.schema(BLOCKS).parquet(f"{where}/members")
    near = held.select("cluster_id", F.explode("nearest").alias("d")).groupBy("cluster_id").agg(F.slice(F.sort_array(F.collect_list("d")), 1, TOP_K).alias("nearest"))  # TOP_K for each block
    whole = clusters.join(placed, "cluster_id").join(near, "cluster_id", "left")
    whole.withColumn("nearest", F.coalesce("nearest", F.array().cast("array<bigint>"))).coalesce(1).write.parquet(f"{where}/clusters")
    k = spark.read.parquet(f"{where}/clusters").count()
    n = held.agg(F.sum("n").alias("n")).first()["n"] or 0  # one number a block is read
    meta = [(INDEX_VERSION, DIM, BLOCK_SIZE, k, n, files, name)]
    spark.createDataFrame(meta, "version int, dim int, block_size int, k long, n long, files int, tables string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


class Index:
    """A written index: ``clusters``, its ``blocks``, by size or as ``buckets`` by block_id, and ``members`` unpacked from them, of which there are ``n``."""

    def __init__(self, spark: SparkSession, path: str):
        """Opens the index at path if it is of this version and shape, with as many clusters and members as its meta data say; any other raises."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if (meta["version"], meta["dim"], meta["block_size"]) != (INDEX_VERSION, DIM, BLOCK_SIZE):
            raise ValueError(f"not an index of version {INDEX_VERSION}: {meta}")
        where = f"{path}/{meta['tables']}"
        self.spark, self.clusters, self.n = spark, spark.read.parquet(f"{where}/clusters"), meta["n"]
        blocks = spark.read.schema(BLOCKS).parquet(f"{where}/members")
        if (self.clusters.count(), blocks.agg(F.sum("n").alias("n")).first()["n"] or 0) != (meta["k"], meta["n"]):
            raise ValueError(f"an index of other numbers of clusters and members than {meta}")
        # Spark knows of buckets by its catalog alone
        self.table = f"index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({BLOCKS}) USING parquet CLUSTERED BY (block_id) SORTED BY (block_id) INTO {meta['files']} BUCKETS LOCATION '{where}/members'")
        self.buckets, self.blocks, self.kept = spark.table(self.table), blocks, False
        self.members = unpacked(blocks)
        self.lists = cluster_lists(self.clusters)
        self.sent = spark.sparkContext.broadcast(self.lists)
        self.boxes = spark.sparkContext.broadcast(cells.boxes(blocks))

    def keep(self) -> Index:
        """Holds the blocks in the executors from their first use on, in memory as far as it goes and else on their disks; a lost executor's are read again. Small sets of queries then travel to them."""
        self.blocks, self.kept = self.blocks.persist(StorageLevel.MEMORY_AND_DISK), True
        return self

    def close(self) -> None:
        """Lets go of what the session and the executors hold; the files stay."""
        if self.kept:
            self.blocks.unpersist()
        self.sent.destroy()
        self.boxes.destroy()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


class Lists(NamedTuple):
    """The clusters of an index as arrays, by id: at most MAX_CENTROIDS."""

    ids: np.ndarray
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    nearest: np.ndarray  # of TOP_K columns; infinite where a cluster has fewer members
    first_block: np.ndarray
    n_blocks: np.ndarray
    tree: Balls | None  # of the centroids, if they are many


def cluster_lists(clusters: DataFrame) -> Lists:
    columns = ["cluster_id", "ci", "bb_min", "bb_max", "nearest", "first_block", "n_blocks"]
    rows = sorted(clusters.select(*columns).limit(MAX_CENTROIDS + 1).collect(), key=lambda r: r[0])
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    near = np.full((len(rows), TOP_K), np.inf)
    for k, r in enumerate(rows):
        near[k, : len(r["nearest"])] = r["nearest"]
    of = lambda c, t: np.array([r[c] for r in rows], t)
    return Lists(of("cluster_id", np.int32), of("ci", np.float64), of("bb_min", np.float64), of("bb_max", np.float64), near, of("first_block", np.int64), of("n_blocks", np.int64), balls(of("ci", np.float64)) if len(rows) >= TREE_FROM else None)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of a written index; Index searches it where it lies."""
    found = Index(spark, path)
    found.close()
    return found.clusters, found.members
