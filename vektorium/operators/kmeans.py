"""k-means over quantised vectors: seeding, Lloyd steps, assignment.

Centroids are at most a few thousand rows (schema.CENTROIDS), so they travel to every task; points never move to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DIM
from ..sources.records import require_at_least
from ..storage import stored, temporary
from .cells import matrix
from .ranges import at_total, numbered

#: Centroids that are collected and broadcast at most.
MAX_CENTROIDS = 65_536
#: Points whose distances to all centroids are in memory at once.
BLOCK = 2_048
#: Distances that _least() has in memory at once, about: few enough for a core's cache.
CELLS = 131_072

_MASK = (1 << 64) - 1


class Lcg:
    """A 64-bit linear congruential generator; multiplier and increment are fixed values."""

    MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state * self.MULTIPLIER + self.INCREMENT) & _MASK
        return self.state

    def below(self, n: int) -> int:
        return self.next() % n

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def after(self, steps: np.ndarray) -> np.ndarray:
        """The states so many steps on, each told alone: a step is x -> a x + c, and two of the same are one of a^2 and a c + c."""
        steps, states = steps.astype(np.uint64), np.full(len(steps), self.state, np.uint64)
        a, c = self.MULTIPLIER, self.INCREMENT
        while steps.any():
            odd = (steps & np.uint64(1)).astype(bool)
            states[odd] = states[odd] * np.uint64(a) + np.uint64(c)  # wraps around at 2^64, as it is meant to
            steps >>= np.uint64(1)
            a, c = a * a & _MASK, (a * c + c) & _MASK
        return states


def stream_states(rows: DataFrame, step: str, seed: int) -> DataFrame:
    """rows with ``state``, the unsigned state of the generator after ``step`` steps as text: a row finds its place in the stream without those before it."""

    @F.pandas_udf("string")
    def states(steps: pd.Series) -> pd.Series:
        return pd.Series(Lcg(seed).after(steps.to_numpy(np.int64)).astype(str))

    return rows.withColumn("state", states(F.col(step).cast("long")))


def centroid_matrix(centroids: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the centroids, by id; their number is bounded and checked."""
    rows = centroids.select("cluster_id", column).limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension so that they are the same wherever they are computed."""
    out = np.zeros((len(points), len(centres)))
    for k in range(points.shape[1]):
        gap = points[:, k : k + 1] - centres[:, k]
        out += gap * gap
    return out


def _least(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre, the first of several, and its squared distance.

    Small whole numbers, as quantised vectors are, give exact sums in any order, so that one product of matrices
    tells all distances; others are summed as in _distances().
    """
    at, least = np.zeros(len(points), np.int64), np.zeros(len(points))
    top = max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0))
    exact = 4 * centres.shape[1] * top * top < 1 << 53 and not (centres % 1).any() and not (points % 1).any()
    lengths, flat = (centres * centres).sum(axis=1), np.ascontiguousarray(-2 * centres.T)
    rows = max(64, CELLS // max(1, len(centres)))
    for lo in range(0, len(points), rows):
        p = points[lo : lo + rows]
        dist = p @ flat + lengths if exact else _distances(p, centres)
        best = dist.argmin(axis=1)
        at[lo : lo + rows] = best
        least[lo : lo + rows] = dist[np.arange(len(p)), best] + ((p * p).sum(axis=1) if exact else 0)
    return at, least


def nearest(centroids: DataFrame, v: Column, column: str = "c", count: int | None = None) -> Column:
    """An array of (cluster_id, d) of the ``count`` nearest centroids, all if None, nearest first; ties go to the lower id."""
    spark = centroids.sparkSession
    held = spark.sparkContext.broadcast(centroid_matrix(centroids, column))

    @F.pandas_udf("array<struct<cluster_id:int,d:double>>")
    def rank(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, centres = held.value
        for s in batches:
            out = []
            for lo in range(0, len(s), BLOCK):
                points = np.array(s.iloc[lo : lo + BLOCK].tolist(), np.float64).reshape(-1, centres.shape[1])
                dist = _distances(points, centres)
                if count == 1:
                    best = dist.argmin(axis=1)[:, None]
                else:
                    best = np.argsort(dist, axis=1, kind="stable")[:, :count]
                near = np.take_along_axis(dist, best, axis=1)
                out += [list(zip(i, x, strict=True)) for i, x in zip(ids[best].tolist(), near.tolist(), strict=True)]
            yield pd.Series(out)

    return rank(v)


def assign(points: DataFrame, centroids: DataFrame, column: str = "c") -> DataFrame:
    """points with ``cluster_id``, the nearest centroid, and ``d``, its squared distance. No shuffle."""
    held = points.sparkSession.sparkContext.broadcast(centroid_matrix(centroids, column))

    @F.arrow_udf("struct<cluster_id:int,d:double>")
    def best(v: pa.Array) -> pa.Array:
        ids, centres = held.value
        at, d = _least(matrix(v, centres.shape[1]).astype(np.float64), centres)
        return pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(d)], ["cluster_id", "d"])

    near = points.withColumn("near", best("v"))
    return near.withColumns({"cluster_id": F.col("near.cluster_id"), "d": F.col("near.d")}).drop("near")


def _means(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, c): the mean of the points of each cluster; a centroid without points stays.

    Sums are whole numbers, so they don't depend on the order; partial sums are combined before the shuffle.
    """
    sums = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(k)).cast("long")).alias(f"s{k}") for k in range(dims)])
    mean = F.array(*[F.col(f"s{k}").cast("double") * (F.lit(1).cast("double") / F.col("n")) for k in range(dims)])
    return centroids.select("cluster_id", F.col("c").alias("old")).join(sums, "cluster_id", "left").select("cluster_id", F.when(F.col("n").isNull(), F.col("old")).otherwise(mean).alias("c"))


def step(points: DataFrame, centroids: DataFrame, dims: int = DIM) -> DataFrame:
    """One Lloyd step: (cluster_id, c), each the mean of the points nearest to it; one without points stays."""
    return _means(assign(points, centroids), centroids, dims)


def _frame(spark, ids: np.ndarray, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, c, strict=True)], "cluster_id int, c array<double>")


def _half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    out = np.full(len(c), np.inf)
    for lo in range(0, len(c), BLOCK):
        d = _distances(c[lo : lo + BLOCK], c)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out[lo : lo + BLOCK] = np.sqrt(d.min(axis=1)) / 2
    return out


def lloyd(points: DataFrame, centroids: DataFrame, iterations: int, dims: int = DIM, work: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(cluster_id, c) after so many steps, the centroids of as many calls of step().

    Points (row_id, v) keep bounds between steps: how far their centroid is at most and any other at
    least, both loosened by how far centroids moved. Where the first is below the second, or
    below half the way to the nearest other centroid, nothing can have changed and no distance is
    computed; else one, and all K only if that doesn't tell. Bounds carry a margin for rounding, so ties are
    computed. ``work`` sums the distances computed and those of plain steps.
    """
    spark = points.sparkSession
    ids, c = centroid_matrix(centroids, "c")
    moved, state = None, points.select("row_id", "v", F.lit(-1).alias("at"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    with temporary(spark):
        for _ in range(iterations):
            sent = spark.sparkContext.broadcast((c, moved, _half_gaps(c)))

            @F.pandas_udf("at int, upper double, lower double")
            def bound(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
                centres, moved, half = sent.value  # noqa: B023
                for v, at, upper, lower in batches:
                    p, at, upper, lower = np.array(v.tolist(), np.float64).reshape(-1, dims), at.to_numpy(np.int64).copy(), upper.to_numpy(np.float64).copy(), lower.to_numpy(np.float64).copy()
                    need, done = np.arange(len(p)), 0
                    if moved is not None:
                        upper += moved[at]
                        lower -= moved.max(initial=0)
                        safe = np.maximum(lower, half[at]) * (1 - 1e-9) - 1e-6
                        need = np.flatnonzero(upper >= safe)
                        gap = p[need] - centres[at[need]]
                        upper[need] = np.sqrt((gap * gap).sum(axis=1))
                        done += len(need)
                        need = need[upper[need] >= safe[need]]
                    for lo in range(0, len(need), BLOCK):
                        some = need[lo : lo + BLOCK]
                        d = _distances(p[some], centres)
                        best = d.argmin(axis=1)
                        at[some], upper[some] = best, np.sqrt(d[np.arange(len(d)), best])
                        d[np.arange(len(d)), best] = np.inf
                        lower[some] = np.sqrt(d.min(axis=1))
                    if work:
                        work[0].add(done + len(need) * len(centres))
                        work[1].add(len(p) * len(centres))
                    yield pd.DataFrame({"at": at.astype(np.int32), "upper": upper, "lower": lower})

            state = stored(state.select("row_id", "v", bound("v", "at", "upper", "lower").alias("b")).select("row_id", "v", "b.*"))
            index = F.broadcast(spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "at int, cluster_id int"))  # MAX_CENTROIDS rows at most
            ids, now = centroid_matrix(_means(state.join(index, "at"), _frame(spark, ids, c), dims), "c")
            moved, c = np.sqrt(((now - c) ** 2).sum(axis=1)), now
    return _frame(spark, ids, c)


def lowest_rows(points: DataFrame, k: int) -> DataFrame:
    """(cluster_id, c): the k points with the lowest row_id as first centroids."""
    first = points.orderBy("row_id").limit(k)
    return first.select((F.row_number().over(Window.orderBy("row_id")) - 1).alias("cluster_id"), F.col("v").cast("array<double>").alias("c"))


def sample_with_replacement(points: DataFrame, m: int, seed: int) -> DataFrame:
    """(draw, row_id, v): m draws, no more than there are points, each any of the points. Draws are made on a numbering of the points by row_id. No points give no draws."""
    n = points.count()
    rng = Lcg(seed)
    draws = points.sparkSession.createDataFrame([(k, rng.below(n)) for k in range(min(m, n))], "draw int, place long")
    ids = numbered(points.select("row_id"), "row_id")
    drawn = F.broadcast(draws).join(ids, "place").select("draw", "row_id")  # bounded by m
    return F.broadcast(drawn).join(points.select("row_id", "v"), "row_id").select("draw", "row_id", "v")


def distance_weights(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """points with ``w``, the squared distance to the nearest chosen centroid."""
    return assign(points, chosen).withColumn("w", F.col("d").cast("long")).drop("d", "cluster_id")


def weighted_pick(points: DataFrame, pick: int) -> DataFrame:
    """The first row by row_id at which the running weight ``acc`` reaches pick; no row if it never does. Ranges of row_id are summed first; only the one that holds the row is ordered."""
    held = at_total(points, "row_id", F.col("w"), pick)
    if held is None:
        return points.withColumn("acc", F.lit(0).cast("long")).limit(0)
    running = held.withColumn("acc", (F.col("before") + F.sum("w").over(Window.orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    return running.where(F.col("acc") >= pick).orderBy("row_id").limit(1).drop("before")


def seed_plus_plus(sample: DataFrame, k: int, seed: int) -> DataFrame:
    """(cluster_id, c): k-means++ on a sample of bounded size (schema.SAMPLE_SIZE): every next centroid is drawn by squared distance to those chosen."""
    rows = sample.select("row_id", "v").orderBy("row_id").collect()
    points = np.array([r["v"] for r in rows], np.float64)
    rng = Lcg(seed)
    chosen = [rng.below(len(points))]
    least = _distances(points, points[chosen[-1:]])[:, 0]
    while len(chosen) < min(k, len(points)):
        acc = np.cumsum(least)
        chosen.append(int(min(np.searchsorted(acc, rng.unit() * acc[-1], side="left"), len(points) - 1)) if acc[-1] > 0 else 0)
        least = np.minimum(least, _distances(points, points[chosen[-1:]])[:, 0])
    return sample.sparkSession.createDataFrame([(i, points[p].tolist()) for i, p in enumerate(chosen)], "cluster_id int, c array<double>")


def _draw(seed: int, turn: int) -> Column:
    """A number from 0 to 1 of each row_id, the same in every run."""
    return F.pmod(F.xxhash64("row_id", F.lit(seed).cast("long"), F.lit(turn).cast("long")), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _nearer(held: DataFrame, known: int, new: list[list[int]], work: Accumulator | None = None) -> DataFrame:
    """held (row_id, v, at, w) after new candidates, numbered on from those known: which of them all is nearest, the first of several, and its squared distance."""
    sent = held.sparkSession.sparkContext.broadcast(np.array(new, np.float64))

    @F.arrow_udf("struct<at:int,w:bigint>")
    def nearer(v: pa.Array, at: pa.Array, w: pa.Array) -> pa.Array:
        best, d = _least(matrix(v, sent.value.shape[1]).astype(np.float64), sent.value)
        at, w, d = at.to_numpy(), w.to_numpy(), d.astype(np.int64)
        if work:
            work.add(len(d) * len(sent.value))
        return pa.StructArray.from_arrays([pa.array(np.where(d < w, best + known, at).astype(np.int32)), pa.array(np.minimum(d, w))], ["at", "w"])

    return held.select("row_id", "v", nearer("v", "at", "w").alias("near")).select("row_id", "v", "near.*")


def seed_parallel(points: DataFrame, k: int, seed: int, rounds: int = 5, factor: int = 2, work: Accumulator | None = None) -> DataFrame:
    """(cluster_id, c): k-means|| over all points (row_id, v): rounds of oversampling, then k-means++ on the few candidates.

    The point of the smallest draw is the first candidate. In every round each point becomes one
    with a probability of factor * k times its share of the summed squared distances to the candidates
    so far, by its own draw; the nearest candidate and its distance are kept between rounds, and a point
    is compared with a candidate once. Candidates, some factor * k a round, are weighted by the points nearest to them;
    nothing but they and sums reaches the driver. Fewer different points than k give as many centroids. ``work`` sums the distances computed.
    """
    spark = points.sparkSession
    with temporary(spark):
        first = points.select("row_id", "v").orderBy(_draw(seed, 0), "row_id").limit(1).collect()
        if not first:
            raise ValueError("no points to choose centroids from")
        candidates, new, held = [], [r["v"] for r in first], points.select("row_id", "v", F.lit(-1).alias("at"), F.lit(1 << 62).alias("w"))
        for turn in range(1, rounds + 1):
            held, candidates, new = stored(_nearer(held, len(candidates), new, work)), candidates + new, []
            total = held.agg(F.sum("w").alias("t")).first()["t"]
            if not total:
                break
            chosen = held.where((F.col("w") > 0) & (_draw(seed, turn) * F.lit(float(total)) < F.col("w") * F.lit(float(factor * k)))).orderBy("row_id").limit(MAX_CENTROIDS + 1).collect()
            new = [r["v"] for r in chosen]
            if len(candidates) + len(new) > MAX_CENTROIDS:
                raise ValueError(f"more than {MAX_CENTROIDS} candidates; take fewer rounds or a smaller factor")
            if not new:
                break
        if new:
            held, candidates = _nearer(held, len(candidates), new, work), candidates + new
        weights = {r["at"]: r["n"] for r in held.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = _plus_plus(np.array(candidates, np.float64), np.array([weights.get(i, 0) for i in range(len(candidates))], np.float64), k, Lcg(seed))
    return _frame(spark, np.arange(len(chosen)), np.array(candidates, np.float64)[chosen])


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: Lcg) -> list[int]:
    """Which points k-means++ draws: the first by weight, each next one by weight times squared distance to those drawn; none twice while others differ from all drawn."""
    pick = lambda acc: int(min(np.searchsorted(acc, rng.unit() * acc[-1], side="right"), len(acc) - 1))
    chosen = [pick(np.cumsum(weights))]
    least = _distances(points, points[chosen])[:, 0]
    while len(chosen) < k and (acc := np.cumsum(weights * least))[-1] > 0:
        chosen.append(pick(acc))
        least = np.minimum(least, _distances(points, points[chosen[-1:]])[:, 0])
    return chosen


def fit(points: DataFrame, k: int, iterations: int, seed: int = 42, sample_size: int = 65_536, work: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(cluster_id, c) after a fixed number of Lloyd steps on a sample drawn with replacement, seeded by k-means++.

    The centroids, which are bounded, are held by the driver between steps, so no lineage grows.
    Fewer points than k, none included, raise a ValueError.
    """
    require_at_least(points, k)
    with temporary(points.sparkSession):
        sample = stored(sample_with_replacement(points, sample_size, seed).select(F.col("draw").cast("long").alias("row_id"), "v"))
        return lloyd(sample, seed_plus_plus(sample, k, seed), iterations, work=work)


def fit_all(points: DataFrame, k: int, iterations: int, seed: int = 42, work: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(cluster_id, c) after Lloyd steps over all points, seeded by k-means||. Fewer points than k raise a ValueError."""
    require_at_least(points, k)
    return lloyd(points, seed_parallel(points, k, seed), iterations, work=work)


def rounded(centroids: DataFrame) -> DataFrame:
    """centroids with ``ci``, the vector in whole numbers, halves away from zero."""
    return centroids.withColumn("ci", F.transform("c", lambda x: F.round(x).cast("int")))
