"""The nearest of many centroids by balls around groups of them, without a distance to each."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Balls(NamedTuple):
    """Points of whole numbers in groups that follow one another; every point of a group is within the radius of its centre."""

    points: np.ndarray
    place: np.ndarray  # of each point among those given
    start: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def balls(points: np.ndarray, rounds: int = 3, block: int = 4_096) -> Balls:
    """About as many balls as each has points: some rounds of means, begun at points evenly apart by their sum."""
    points = points.astype(np.float64)
    n = max(1, int(np.sqrt(len(points))))
    centres = points[np.argsort(points.sum(axis=1), kind="stable")[np.linspace(0, len(points) - 1, n).astype(np.int64)]]
    for turn in range(rounds + 1):
        group = np.concatenate([_squares(points[lo : lo + block], centres).argmin(axis=1) for lo in range(0, len(points), block)])
        if turn < rounds:
            size = np.bincount(group, minlength=n)
            sums = np.stack([np.bincount(group, points[:, d], n) for d in range(points.shape[1])], axis=1)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    place = np.argsort(group, kind="stable")
    start = np.searchsorted(group[place], np.arange(n + 1))
    gap = points - centres[group]
    far = np.zeros(n)
    np.maximum.at(far, group, np.sqrt((gap * gap).sum(axis=1)))
    return Balls(points[place], place, start, centres, far)


def nearest_in_balls(tree: Balls, q: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(place, squared distance) of the count nearest points of each query of whole numbers, ties to the lower place; and how many distances were computed.

    A ball can't hold a point nearer than its centre less its radius. Queries take up balls by that
    bound, and are done when the next one's is beyond the last of their best so far.
    """
    n, m, count = len(tree.points), len(q), min(count, len(tree.points))
    to_centre = np.sqrt(_squares(q, tree.centres))
    low = np.maximum(to_centre - tree.radii - 1e-6 * (1 + to_centre), 0) ** 2
    order = np.argsort(low, axis=1, kind="stable")
    best, done = np.full((m, count), np.inf), m * len(tree.centres)  # distance * n + place: whole numbers below 2^53
    for turn in range(len(tree.centres)):
        ball = order[:, turn]
        rows = np.flatnonzero(low[np.arange(m), ball] * n <= best[:, -1])
        if not len(rows):
            break
        rows = rows[np.argsort(ball[rows], kind="stable")]
        edges = np.flatnonzero(np.diff(ball[rows])) + 1
        for some in np.split(rows, edges):
            own = slice(tree.start[ball[some[0]]], tree.start[ball[some[0]] + 1])
            if own.start == own.stop:
                continue
            x, p = q[some], tree.points[own]
            d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)  # exact
            done += d.size
            both = np.concatenate([best[some], d * n + tree.place[own]], axis=1)
            best[some] = np.partition(both, count - 1, axis=1)[:, :count] if both.shape[1] > count else both
            best[some] = np.sort(best[some], axis=1)
    return (best % n).astype(np.int64), best // n, done
