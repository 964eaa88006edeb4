"""Cells: members cut into boxes of bounded size, so that a search meets only those that may matter. Exact.

Cuts are chosen on a bounded sample of the members; boxes are those of all of them, so a sample that misleads costs
time and no neighbour. Shapes: members (row_id, v, label, cluster_id), blocks as in BLOCKS, a cell or a part of a large one each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DIM, TOP_K

#: Rows that choose the cuts, and cells, at most.
SAMPLE, MAX_CELLS = 262_144, 65_536
#: A cell of more than so many times its size is dealt by hash.
LARGE = 4
#: Neighbouring blocks whose common box is looked at first.
RUN = 64
BLOCKS = "block_id long, cluster_id int, n int, rows binary, vectors binary, labels binary, nearest array<bigint>, low array<int>, high array<int>"


class Cuts(NamedTuple):
    """A binary tree for each cluster: node x goes to ``right`` if v[dim] > cut, else to ``left``; a leaf has dim -1 and its number as ``left``."""

    clusters: np.ndarray
    roots: np.ndarray
    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaf(self, cluster: np.ndarray, v: np.ndarray) -> np.ndarray:
        node = self.roots[np.searchsorted(self.clusters, cluster)]
        going = np.arange(len(v))
        while len(going := going[self.dim[node[going]] >= 0]):
            x = node[going]
            node[going] = np.where(v[going, self.dim[x]] > self.cut[x], self.right[x], self.left[x])
        return self.left[node]


def cuts(clusters: np.ndarray, cluster: np.ndarray, v: np.ndarray, size: float) -> tuple[Cuts, np.ndarray]:
    """Trees over a sample (cluster, v), cut at the median of the dimension that varies most until a leaf has ``size`` rows at most or rows that are all alike, and each leaf's cluster. Leaves are numbered so that neighbours are close."""
    dim, cut, kids, roots, owner = [], [], [], [], []

    def node() -> int:
        dim.append(-1), cut.append(0.0), kids.append([0, 0])
        return len(dim) - 1

    order = np.argsort(cluster, kind="stable")
    for c, lo, hi in zip(clusters, np.searchsorted(cluster[order], clusters), np.searchsorted(cluster[order], clusters, side="right"), strict=True):
        roots.append(node())
        todo = [(roots[-1], order[lo:hi])]
        while todo:
            x, rows = todo.pop()
            w = v[rows]
            spread = w.var(axis=0) if len(rows) > 1 else np.zeros(v.shape[1])
            at = int(spread.argmax())
            if len(rows) <= size or not spread[at]:
                kids[x][0] = len(owner)
                owner.append(c)
                continue
            middle = np.median(w[:, at])
            above = w[:, at] > middle
            if not above.any():
                middle = w[:, at].mean()
                above = w[:, at] > middle
            dim[x], cut[x], kids[x] = at, float(middle), [node(), node()]
            todo += [(kids[x][1], rows[above]), (kids[x][0], rows[~above])]
    left, right = np.array(kids, np.int64).reshape(-1, 2).T
    return Cuts(clusters, np.array(roots, np.int64), np.array(dim, np.int64), np.array(cut), left, right), np.array(owner, np.int32)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of arrays of ``dims`` numbers as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def packed(members: DataFrame, size: int, dims: int = DIM, centres: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """(places, blocks): members as blocks, and (cluster_id, first_block, n_blocks) of the clusters that have any.

    Blocks (block_id, cluster_id, n, rows, vectors, labels, nearest, low, high) hold row ids in order, int16 vectors by
    dimension, the TOP_K least squared distances to the cluster's place in ``centres`` (ids in order, vectors), if told, and the box of the
    vectors. A cluster's blocks have neighbouring ids.
    """
    counted = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CELLS + 1).toArrow()
    if counted.num_rows > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} clusters")
    n = int(np.sum(counted["n"].to_numpy()))
    size, taken = max(size, -(-n // (MAX_CELLS // 2))), min(1.0, SAMPLE / max(n, 1))
    some = members.where(F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(1 << 20)) < int(taken * (1 << 20))) if taken < 1 else members
    sample = some.select("cluster_id", "v").limit(2 * SAMPLE).toArrow()
    tree, owner = cuts(np.sort(counted["cluster_id"].to_numpy()), sample["cluster_id"].to_numpy(), matrix(sample["v"], dims), size * taken)
    spark = members.sparkSession
    sent = spark.sparkContext.broadcast((tree, centres))

    @F.arrow_udf("int")
    def leaf(cluster: pa.Array, v: pa.Array) -> pa.Array:
        return pa.array(sent.value[0].leaf(cluster.to_numpy(zero_copy_only=False), matrix(v, dims)), pa.int32())

    placed = members.select("row_id", "v", "label", "cluster_id", leaf("cluster_id", "v").alias("leaf"))
    held = np.zeros(len(owner), np.int64)
    for r in placed.groupBy("leaf").count().toArrow().to_batches():
        held[r["leaf"].to_numpy()] = r["count"].to_numpy()
    parts = np.where(held > LARGE * size, -(-held // size), 1)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]]) if len(parts) else parts
    shape = spark.createDataFrame(pa.table({"leaf": pa.array(np.arange(len(parts)), pa.int32()), "first": pa.array(first, pa.int64()), "parts": pa.array(parts, pa.int64())}))
    # a row a cell, of which there are about MAX_CELLS at most
    dealt = placed.join(F.broadcast(shape), "leaf").select((F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("parts"))).alias("block_id"), "cluster_id", "row_id", "v", "label")

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows["row_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v = matrix(rows["v"], dims)[order].astype(np.int64)
        near, centres = [], sent.value[1]
        if centres is not None:
            gap = v - centres[1][np.searchsorted(centres[0], rows["cluster_id"][0].as_py())]
            near = np.sort((gap * gap).sum(axis=1))[:TOP_K].tolist()
        return pa.table({
            "block_id": rows["block_id"][:1], "cluster_id": rows["cluster_id"][:1], "n": pa.array([len(ids)], pa.int32()), "rows": [ids[order].astype(np.int64).tobytes()], "vectors": [np.ascontiguousarray(v.T).astype(np.int16).tobytes()],
            "labels": [rows["label"].to_numpy()[order].astype(np.int8).tobytes()], "nearest": pa.array([near], pa.list_(pa.int64())), "low": pa.array([v.min(axis=0).tolist()], pa.list_(pa.int32())), "high": pa.array([v.max(axis=0).tolist()], pa.list_(pa.int32())),
        })

    found, begin = np.unique(owner, return_index=True)
    blocks_in = np.add.reduceat(parts, begin) if len(parts) else parts
    places = pa.table({"cluster_id": pa.array(found, pa.int32()), "first_block": pa.array(first[begin] if len(parts) else first, pa.int64()), "n_blocks": pa.array(blocks_in, pa.int32())})
    return spark.createDataFrame(places), dealt.groupBy("block_id").applyInArrow(pack, BLOCKS)


class Boxes(NamedTuple):
    """The boxes of blocks, cluster by cluster, and those of runs of them."""

    ids: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    clusters: np.ndarray
    runs: np.ndarray  # where each cluster's runs begin, and their end
    start: np.ndarray  # where each run's blocks begin, and their end
    run_low: np.ndarray
    run_high: np.ndarray
    run_n: np.ndarray

    def runs_of(self, cluster: int) -> slice:
        at = int(np.searchsorted(self.clusters, cluster))
        return slice(int(self.runs[at]), int(self.runs[at + 1])) if at < len(self.clusters) and self.clusters[at] == cluster else slice(0, 0)

    def blocks_of(self, run: int) -> slice:
        return slice(int(self.start[run]), int(self.start[run + 1]))


def boxes(blocks: DataFrame, dims: int = DIM) -> Boxes:
    """The boxes of stored blocks: a few numbers for each block reach the driver."""
    t = blocks.select("block_id", "cluster_id", "n", "low", "high").toArrow().sort_by([("cluster_id", "ascending"), ("block_id", "ascending")])
    cluster, low, high = t["cluster_id"].to_numpy(), *(matrix(t[c], dims).astype(np.float64) for c in ("low", "high"))
    clusters, begin = np.unique(cluster, return_index=True)
    ends, start, runs = np.append(begin, len(cluster))[1:], [], [0]
    for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
        start += range(a, b, RUN)
        runs.append(len(start))
    at = np.array(start, np.int64)
    run_low, run_high = (np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(at) else (low, high)
    n = t["n"].to_numpy().astype(np.int64)
    return Boxes(t["block_id"].to_numpy(), n, low, high, clusters, np.array(runs, np.int64), np.append(at, len(cluster)), run_low, run_high, np.add.reduceat(n, at) if len(at) else n)


def least(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least squared distance from each row of q to each box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        x = q[:, k : k + 1]
        gap = np.maximum(np.maximum(low[:, k] - x, x - high[:, k]), 0)
        out += gap * gap
    return out


def most(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest squared distance from each row of q to anything in each box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        x = q[:, k : k + 1]
        gap = np.maximum(x - low[:, k], high[:, k] - x)
        out += gap * gap
    return out


def first_blocks(held: Boxes, q: np.ndarray, owner: np.ndarray, cluster: np.ndarray, cutoff: np.ndarray, count: int = 1) -> np.ndarray:
    """For each query the ``count`` nearest blocks of its clusters (cluster[i] is one of query owner[i]), as their places in ``held``, in order; -1 instead of those beyond its cutoff."""
    best, out = np.full((len(q), count), np.inf), np.full((len(q), count), -1)
    for c in np.unique(cluster):
        at, runs = owner[cluster == c], held.runs_of(c)
        low = least(q[at], held.run_low[runs], held.run_high[runs])
        order = np.argsort(low, axis=1)
        for turn in range(low.shape[1]):  # a query takes up runs in order until the next one's box is beyond its best blocks; boxes of runs overlap
            r = order[:, turn]
            bound = low[np.arange(len(at)), r]
            some = np.flatnonzero((bound < best[at, -1]) & (bound <= cutoff[at]))
            if not len(some):
                break
            some = some[np.argsort(r[some], kind="stable")]
            for part in np.split(some, np.flatnonzero(np.diff(r[some])) + 1):
                own, blocks = at[part], held.blocks_of(runs.start + int(r[part[0]]))
                d = least(q[own], held.low[blocks], held.high[blocks])
                d[d > cutoff[own, None]] = np.inf
                few = min(count, d.shape[1])
                near = np.argpartition(d, few - 1, axis=1)[:, :few]
                d, place = np.concatenate([best[own], np.take_along_axis(d, near, 1)], axis=1), np.concatenate([out[own], near + blocks.start], axis=1)
                first = np.argsort(d, axis=1, kind="stable")[:, :count]
                best[own], out[own] = np.take_along_axis(d, first, 1), np.take_along_axis(place, first, 1)
    return np.where(np.isfinite(best), out, -1)


def pairs(held: Boxes, q: np.ndarray, owner: np.ndarray, cluster: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of owner and cluster, place of a block in ``held``) of all blocks that are no farther than the query's cutoff."""
    entries, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(cluster):
        entry, runs = np.flatnonzero(cluster == c), held.runs_of(c)
        near = least(q[owner[entry]], held.run_low[runs], held.run_high[runs]) <= cutoff[owner[entry], None]
        for r in np.flatnonzero(near.any(axis=0)):
            own, blocks = entry[near[:, r]], held.blocks_of(runs.start + r)
            i, j = np.nonzero(least(q[owner[own]], held.low[blocks], held.high[blocks]) <= cutoff[owner[own], None])
            entries.append(own[i])
            places.append(j + blocks.start)
    return np.concatenate(entries), np.concatenate(places)


def settled(held: Boxes, q: np.ndarray, owner: np.ndarray, cluster: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, owner, place): each query's members in blocks that are nearer than limit as a whole, and its blocks that may hold some that are and some that aren't."""
    n, owners, places = np.zeros(len(q), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(cluster):
        at, runs = owner[cluster == c], held.runs_of(c)
        whole = most(q[at], held.run_low[runs], held.run_high[runs]) < limit
        np.add.at(n, at, whole @ held.run_n[runs])
        part = ~whole & (least(q[at], held.run_low[runs], held.run_high[runs]) < limit)
        for r in np.flatnonzero(part.any(axis=0)):
            own, blocks = at[part[:, r]], held.blocks_of(runs.start + r)
            inner = most(q[own], held.low[blocks], held.high[blocks]) < limit
            np.add.at(n, own, inner @ held.n[blocks])
            i, j = np.nonzero(~inner & (least(q[own], held.low[blocks], held.high[blocks]) < limit))
            owners.append(own[i])
            places.append(j + blocks.start)
    return n, np.concatenate(owners), np.concatenate(places)


def probes_of(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, cluster, probe_rank) of a column ``probes``."""
    lists = b["probes"].combine_chunks() if isinstance(b, pa.Table) else b["probes"]
    if not len(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return owner, flat.field("cluster_id").to_numpy(zero_copy_only=False), flat.field("probe_rank").to_numpy(zero_copy_only=False)



def by_block(held: Boxes, place: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Pairs as a tuple for each block: its id and the bytes of each column's values."""
    order = np.argsort(place, kind="stable")
    place, columns = place[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(held.ids[place[a]]), *(c[a:b].tobytes() for c in columns)
