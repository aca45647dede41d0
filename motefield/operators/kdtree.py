"""Splits of space along medians: leaves that deal rows over tasks, and buckets for searches inside a task.

All functions work on numpy arrays inside tasks (the leaves' medians on a bounded sample on the driver).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# these helpers travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET = 64
AT_ONCE = 4096  # candidate rows per block of queries held at a time


@dataclass
class Leaves:
    """A complete tree of median splits, in heap order from 1; leaves are numbered from 0."""

    depth: int
    axis: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, depth: int) -> Leaves:
        """Medians of the distinct rows of a sample, each along the longest side of its part."""
        sample = np.unique(sample, axis=0)
        while depth and len(sample) < 4 << depth:
            depth -= 1
        axis, value = np.zeros(1 << depth, np.int8), np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            side = np.ptp(part, axis=0) if len(part) else np.zeros(3)
            axis[node] = a = int(side.argmax())
            value[node] = v = float(np.median(part[:, a])) if len(part) else 0.0
            right = part[:, a] >= v
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]
        return Leaves(depth, axis, value)

    def number(self, xyz: np.ndarray) -> np.ndarray:
        node = np.ones(len(xyz), np.int64)
        row = np.arange(len(xyz))
        for _ in range(self.depth):
            node = 2 * node + (xyz[row, self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)

    def boxes(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the leaves, with ``low`` and ``high`` as the ends of space."""
        lows, highs = {1: np.full(3, low)}, {1: np.full(3, high)}
        for node in range(1, 1 << self.depth):
            a, v = self.axis[node], self.value[node]
            for child in (2 * node, 2 * node + 1):
                lows[child], highs[child] = lows[node].copy(), highs[node].copy()
            highs[2 * node][a] = min(v, highs[node][a])
            lows[2 * node + 1][a] = max(v, lows[node][a])
        first = 1 << self.depth
        return np.array([lows[first + k] for k in range(first)]), np.array([highs[first + k] for k in range(first)])


class Cloud:
    """Rows in buckets of at most `BUCKET`, cut at medians along the longest side, with the bounds of each bucket."""

    def __init__(self, xyz: np.ndarray, copies: np.ndarray | None = None):
        n = len(xyz)
        order = np.arange(n)
        todo, starts = [(0, n)], []
        while todo:
            a, b = todo.pop()
            if b - a <= BUCKET:
                starts.append(a)
                continue
            part = order[a:b]
            axis = int(np.ptp(xyz[part], axis=0).argmax())
            half = (b - a) // 2
            order[a:b] = part[np.argpartition(xyz[part, axis], half)]
            todo += [(a + half, b), (a, a + half)]
        self.order = order
        self.xyz = xyz[order]
        self.copies = np.ones(n, np.int64) if copies is None else copies[order]
        self.single = copies is None or bool((copies == 1).all())
        self.start = np.array(starts if n else [], np.int64)
        self.stop = np.append(self.start[1:], n) if n else self.start
        self.low = np.minimum.reduceat(self.xyz, self.start) if n else np.zeros((0, 3))
        self.high = np.maximum.reduceat(self.xyz, self.start) if n else np.zeros((0, 3))
        self.many = np.add.reduceat(self.copies, self.start) if n else np.zeros(0, np.int64)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        size = self.stop[buckets] - self.start[buckets]
        first = np.cumsum(size) - size
        return np.arange(int(size.sum())) + np.repeat(self.start[buckets] - first, size)


def far_from(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distance between a box and each of many boxes."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    return (gap * gap).sum(axis=1)


def _squares(q: np.ndarray, c: np.ndarray, half: float | None) -> np.ndarray:
    """Squared distances of all q to all c. With ``half`` a period, pairs whose nearest image is another one are infinitely far."""
    d2 = np.zeros((len(q), len(c)))
    odd = None
    for axis in range(3):
        gap = c[None, :, axis] - q[:, None, axis]
        if half is not None:
            out = (gap < -half) | (gap >= half)
            odd = out if odd is None else odd | out
        d2 += gap * gap
    if odd is not None:
        d2[odd] = np.inf
    return d2


def _least(d2: np.ndarray, copies: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The k smallest of each row, ascending, with their copies."""
    if d2.shape[1] > k:
        if copies is None:
            d2 = np.partition(d2, k - 1, axis=1)[:, :k]
        else:
            at = np.argpartition(d2, k - 1, axis=1)[:, :k]
            d2, copies = np.take_along_axis(d2, at, 1), np.take_along_axis(copies, at, 1)
    if copies is None:
        return np.sort(d2, axis=1), None
    at = np.argsort(d2, axis=1, kind="stable")
    return np.take_along_axis(d2, at, 1), np.take_along_axis(copies, at, 1)


def spread_copies(d2: np.ndarray, copies: np.ndarray | None, k: int) -> np.ndarray:
    """Each entry as often as it has copies, cut at k; shorter rows are filled with infinity."""
    if copies is not None and (copies > 1).any():
        upto = np.cumsum(np.where(np.isfinite(d2), copies, 0), axis=1)
        place = (upto[:, None, :] <= np.arange(k)[None, :, None]).sum(axis=2)
        d2 = np.take_along_axis(np.concatenate([d2, np.full((len(d2), 1), np.inf)], axis=1), np.minimum(place, d2.shape[1]), 1)
    if d2.shape[1] < k:
        d2 = np.concatenate([d2, np.full((len(d2), k - d2.shape[1]), np.inf)], axis=1)
    return d2[:, :k]


def nearest_in(cloud: Cloud, queries: Cloud, reach2: np.ndarray, k: int, half: float | None = None) -> np.ndarray:
    """Squared distances from each query to its k nearest rows of the cloud within ``reach2``, ascending and filled with infinity.

    Rows of queries (and of ``reach2`` and the result) are in bucket order. A block of queries looks at the nearest buckets first,
    which bound its k-th distances, and then at every other bucket within that bound.
    """
    out = np.full((len(queries.xyz), k), np.inf)
    if not len(cloud.start):
        return out
    for a, b, low, high in zip(queries.start, queries.stop, queries.low, queries.high):
        q = queries.xyz[a:b]
        reach = reach2[a:b].copy()
        gap2 = far_from(low, high, cloud.low, cloud.high)
        order = np.argsort(gap2, kind="stable")
        upto = np.cumsum(cloud.many[order])
        first = min(len(order), max(4, int(np.searchsorted(upto, k)) + 1))
        best: np.ndarray | None = None
        times: np.ndarray | None = None
        at = 0
        while at < len(order):
            to = first if not at else at + max(1, AT_ONCE // BUCKET)
            take = order[at:to]
            take = take[gap2[take] <= reach.max()]
            if not len(take):
                break
            rows = cloud.rows(np.sort(take))
            d2 = _squares(q, cloud.xyz[rows], half)
            d2[d2 > reach[:, None]] = np.inf
            copies = None if cloud.single else np.broadcast_to(cloud.copies[rows], d2.shape)
            if best is not None:
                d2 = np.concatenate([best, d2], axis=1)
                copies = None if copies is None else np.concatenate([times, copies], axis=1)
            best, times = _least(d2, copies, k)
            reach = np.minimum(reach, spread_copies(best, times, k)[:, k - 1])
            at = to
        if best is not None:
            out[a:b] = spread_copies(best, times, k)
    return out


def kernel_sums(cloud: Cloud, queries: Cloud, h: np.ndarray, half: float | None = None) -> np.ndarray:
    """Σ copies · w(d/h) for each query and each of its ascending radii ``h`` (rows in bucket order), with the cubic spline
    w(u) = 1 - 6u² + 6u³ up to u = 1/2, 2(1-u)³ up to 1.

    Distances are sorted once; running sums of their powers give every radius by two lookups.
    """
    out = np.zeros(h.shape)
    top2 = h[:, -1] ** 2
    for a, b, low, high in zip(queries.start, queries.stop, queries.low, queries.high):
        take = np.flatnonzero(far_from(low, high, cloud.low, cloud.high) <= top2[a:b].max())
        rows = cloud.rows(take)
        for at in range(0, len(rows), 16 * AT_ONCE):
            part = rows[at: at + 16 * AT_ONCE]
            for i in range(a, b):
                d2 = _squares(queries.xyz[i: i + 1], cloud.xyz[part], half)[0]
                near = np.flatnonzero(d2 <= top2[i])
                near = near[np.argsort(d2[near])]
                d = np.sqrt(d2[near])
                n = cloud.copies[part[near]].astype(float)
                p = [np.concatenate([[0.0], np.cumsum(n * d**e)]) for e in range(4)]
                inner, outer = np.searchsorted(d, 0.5 * h[i], "right"), np.searchsorted(d, h[i], "right")
                s = 1.0 / h[i]
                core = p[0][inner] - 6 * s * s * p[2][inner] + 6 * s**3 * p[3][inner]
                rim = [p[e][outer] - p[e][inner] for e in range(4)]
                out[i] += core + 2 * (rim[0] - 3 * s * rim[1] + 3 * s * s * rim[2] - s**3 * rim[3])
    return out
