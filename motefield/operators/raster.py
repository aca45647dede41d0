"""Particles to per-pixel sums inside the tasks: discs are added to a dense grid per task, and grids meet in one aggregate.

The projection is the one of `splat`, in the JVM. Each Arrow batch of projected discs is cut to pixel rows and pixels by numpy and
added to a grid of the screen that the task holds; a task gives out each pixel it touched once. So no row is made per disc and
pixel, and the exchange carries at most one row per task and pixel, as with `splat`. A disc that covers the screen is cut
to `AT_ONCE` pixels at a time, whatever its size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.kernels import NORMS, kernel_values
from motefield.operators.camera import Camera, literal
from motefield.operators.splat import EDGE, projected

# the Arrow helpers travel with the job, so executors need no installed copy of this package
for _name in (__name__, kernel_values.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])

AT_ONCE = 1 << 18  # pixels of discs worked on at a time
WIDE = 4  # discs whose box holds more than one of so many pixels of the screen are drawn on the whole screen


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... (count[k] of them) for each k, in one array."""
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - first, count)


def _span(center: np.ndarray, half: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First pixel centre within ``half`` of the centres on a screen, and how many."""
    low = np.maximum(np.ceil(center - half - EDGE), 0)
    high = np.minimum(np.floor(center + half + EDGE), limit - 1)
    return low.astype(np.int64), np.maximum(high - low + 1, 0).astype(np.int64)


class Grid:
    """Sums per pixel of one task: ``den`` and, with a quantity, ``num`` and ``sq``; ``hit`` marks touched pixels."""

    def __init__(self, width: int, height: int, qty: bool, kernel: str):
        self.width, self.height, self.kernel = width, height, kernel
        self.sums = np.zeros((3 if qty else 1, width * height))
        self.hit = np.zeros(width * height, bool)

    def add(self, cx, cy, rx, ry, a, q) -> None:
        seen = (cx + rx >= -EDGE) & (cx - rx <= self.width - 1 + EDGE)
        row, rows = _span(cy, ry, self.height)
        cols = _span(cx, rx, self.width)[1]
        # rows without a quantity count nowhere, and discs of odd radii are left to the rows
        wide = seen & (rows * cols * WIDE > len(self.hit)) & np.isfinite(rx) & np.isfinite(ry) & (rx > 0) & (ry > 0)
        if q is not None:
            wide &= ~np.isnan(q)
        if wide.any():
            self._wide(*(v[wide] for v in (cx, cy, rx, ry, a)), None if q is None else q[wide])
        rows = np.where(seen & ~wide, rows, 0)
        at = 0
        upto = np.cumsum(rows)
        while at < len(rows):  # pixel rows of some discs at a time; one disc has at most ``height``
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE // 8, "right")))
            disc = np.repeat(np.arange(at, to), rows[at:to])
            py = _expand(row[at:to], rows[at:to])
            dy = (py - cy[disc]) / ry[disc]
            self._rows(py, dy * dy, disc, cx, rx, a, q)
            at = to

    def _wide(self, cx, cy, rx, ry, a, q) -> None:
        """Discs over much of the screen: kernel values of all its pixels, a few discs at a time, summed by one product."""
        weights = np.stack([a] if q is None else [a, a * q, a * q * q])
        step = max(1, AT_ONCE // 8 // len(self.hit))
        space = np.empty((3, step, len(self.hit)))
        for at in range(0, len(cx), step):
            to = slice(at, at + step)
            dx = (np.arange(self.width) - cx[to, None]) / rx[to, None]
            dy = (np.arange(self.height) - cy[to, None]) / ry[to, None]
            r, value, cube = space[:, : len(dx)]
            np.add((dx * dx)[:, None, :], (dy * dy)[:, :, None], out=r.reshape(len(dx), self.height, self.width))
            if not self.hit.all():
                self.hit |= (r <= 1.0).any(axis=0)
            if self.kernel == "cubic_spline":  # both pieces end at zero
                np.sqrt(r, out=r)
                np.maximum(np.subtract(1.0, r, out=cube), 0.0, out=cube)
                np.multiply(cube, cube, out=value)
                value *= cube
                np.maximum(np.subtract(0.5, r, out=cube), 0.0, out=cube)
                np.multiply(cube, cube, out=r)
                r *= cube
                r *= 4.0
                value -= r
                value *= 2.0 * NORMS["cubic_spline"]
            else:
                value = kernel_values(self.kernel, np.minimum(r, 1.0)) * (r <= 1.0)
            self.sums += weights[:, to] @ value

    def _rows(self, py, dy2, disc, cx, rx, a, q) -> None:
        col, cols = _span(cx[disc], rx[disc] * np.sqrt(np.maximum(1.0 - dy2, 0.0)), self.width)
        upto = np.cumsum(cols)
        at = 0
        while at < len(cols):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
            row = np.repeat(np.arange(at, to), cols[at:to])
            px = _expand(col[at:to], cols[at:to])
            one = disc[row]
            dx = (px - cx[one]) / rx[one]
            r2 = dx * dx + dy2[row]
            keep = np.flatnonzero(r2 <= 1.0)
            one, cell = one[keep], py[row[keep]] * self.width + px[keep]
            sigma = a[one] * kernel_values(self.kernel, r2[keep])
            n = len(self.hit)
            weights = [sigma]
            if q is not None:
                known = ~np.isnan(q[one])
                cell, sigma, value = cell[known], sigma[known], q[one[known]]
                weights = [sigma, sigma * value, sigma * value * value]
            self.hit[cell] = True
            for total, w in zip(self.sums, weights):
                if 8 * len(cell) > n:
                    total += np.bincount(cell, w, n)
                else:  # few pixels of a large screen
                    np.add.at(total, cell, w)
            at = to

    def batch(self, names: Sequence[str]) -> pa.RecordBatch:
        cell = np.flatnonzero(self.hit)
        px, py = (cell % self.width).astype(np.int32), (cell // self.width).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(px), pa.array(py), *(pa.array(s[cell]) for s in self.sums)], list(names))


def splat_raster(df: DataFrame, cam: Camera, mass: Column | str = "mass", hsml: Column | str = "hsml", qty: Column | str | None = None,
                 kernel: str = "cubic_spline", xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The accumulator of one camera, as `splat.splat` makes it: ``px, py, [num,] den[, sq]`` for every touched pixel.

    A task holds one grid of the screen, 8 to 24 bytes a pixel. A null quantity counts in none of the sums, and so does a NaN.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    q = None if qty is None else as_col(qty).cast("double")
    # what draws nothing is sorted out in the task: as a filter it would be pushed below the projection and repeat its arithmetic
    shape = projected(df, literal(cam), as_col(mass), as_col(hsml), q, xyz=xyz)
    width, height = cam.width, cam.height
    names = ["px", "py", "den", *(["num", "sq"] if q is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = None
        for batch in batches:
            if batch.num_rows:
                grid = grid or Grid(width, height, "q" in batch.schema.names, kernel)
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # nulls are NaN
                ok = np.isfinite(cols[0]) & np.isfinite(cols[1]) & np.isfinite(cols[4])
                cols = [c[ok] for c in cols]
                grid.add(*cols[:5], cols[5] if "q" in batch.schema.names else None)
        if grid is not None:
            yield grid.batch(names)

    parts = shape.mapInArrow(run, "px int, py int, " + ", ".join(f"{n} double" for n in names[2:]))
    order = [c for c in ("num", "den", "sq") if c in names]
    return parts.groupBy("px", "py").agg(*[F.sum(c).alias(c) for c in order])


class Canvas:
    """Discs drawn one over the other: premultiplied colours, which of them are known (not null), and the number of discs per pixel."""

    def __init__(self, width: int, height: int, alpha: float, inner: float, border: Sequence[float]):
        self.alpha, self.inner, self.border = alpha, inner, border
        self.rgb, self.known = np.zeros((3, height, width)), np.zeros((3, height, width), bool)
        self.n = np.zeros((height, width), np.int64)

    def draw(self, cx: float, cy: float, rx: float, ry: float, fill: Sequence[float | None], blank: bool) -> None:
        """One disc with its border ring; a ``blank`` one has no colour at all."""
        height, width = self.n.shape
        y0, y1 = max(np.ceil(cy - ry - EDGE), 0), min(np.floor(cy + ry + EDGE), height - 1)
        x0, x1 = max(np.ceil(cx - rx - EDGE), 0), min(np.floor(cx + rx + EDGE), width - 1)
        if not (y0 <= y1 and x0 <= x1):
            return
        box = slice(int(y0), int(y1) + 1), slice(int(x0), int(x1) + 1)
        dx, dy = (np.arange(x0, x1 + 1) - cx) / rx, (np.arange(y0, y1 + 1) - cy) / ry
        r2 = dx * dx + (dy * dy)[:, None]
        hit = r2 <= 1.0
        inside = np.sqrt(r2) <= self.inner
        self.n[box] += hit
        for c, (f, b) in enumerate(zip(fill, self.border)):
            rgb, known = self.rgb[c][box], self.known[c][box]
            at = ~inside if f is None else True
            color = np.where(inside, 0.0 if f is None else f, b)
            if self.alpha >= 1.0:
                np.copyto(rgb, color, where=hit)
                np.copyto(known, at & (not blank), where=hit)
            else:
                color *= self.alpha
                if f is None:
                    color[inside] = 0.0
                np.multiply(rgb, 1.0 - self.alpha, out=rgb, where=hit)
                np.add(rgb, color, out=rgb, where=hit)
                known |= hit & at

    def batch(self, part: int) -> pa.RecordBatch:
        py, px = np.nonzero(self.n)
        colors = [pa.array(self.rgb[c][py, px], mask=~self.known[c][py, px]) for c in range(3)]
        arrays = [pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32)), pa.array(np.full(len(px), part, np.int32)), *colors, pa.array(self.n[py, px])]
        return pa.RecordBatch.from_arrays(arrays, ["px", "py", "_b", "r", "g", "b", "n"])


def painted(shape: DataFrame, cam: Camera, order: str, fill: Sequence[str], border: Sequence[float], inner: float, alpha: float) -> DataFrame:
    """Discs of `projected` drawn in ascending ``order``, by ranges of it: ``px, py, _b, r, g, b`` (premultiplied) and ``n``, the
    number of discs, per pixel and range.

    Discs, not their pixels, are sorted; each task draws its range on a canvas of its own. Where ``order`` ties, geometry decides.
    A null order is below all others; opaque discs with one have no colour.
    """
    width, height = cam.width, cam.height
    colors = [f"_f{i}" for i in range(3)]
    discs = shape.select(F.col(order).alias("_order"), *[F.col(f).cast("double").alias(c) for f, c in zip(fill, colors)], "cx", "cy", "rx", "ry")
    discs = discs.where(F.col("cx").isNotNull() & F.col("cy").isNotNull() & ~F.isnan("cx") & ~F.isnan("cy") & ~F.isnan("rx") & ~F.isnan("ry"))
    keys = ["_order", "rx", "ry", "cx", "cy", *colors]
    tasks = discs.sparkSession.sparkContext.defaultParallelism
    discs = discs.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select(
        F.spark_partition_id().alias("part"), F.col("_order").isNull().alias("blank"), "cx", "cy", "rx", "ry", *colors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canvas = part = None
        for batch in batches:
            if batch.num_rows:
                canvas = canvas or Canvas(width, height, alpha, inner, border)
                part, blank, *geometry = (batch.column(c).to_pylist() for c in ("part", "blank", "cx", "cy", "rx", "ry"))
                part = part[0]
                for none, *at, f in zip(blank, *geometry, zip(*(batch.column(c).to_pylist() for c in colors))):
                    canvas.draw(*at, f, none)
        if canvas is not None:
            yield canvas.batch(part)

    return discs.mapInArrow(run, "px int, py int, _b int, r double, g double, b double, n long")
