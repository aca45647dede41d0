"""Nearest neighbours by a balanced split of space, and smoothing lengths from them.

1. Medians of a bounded sample cut space into leaves of some ten thousand rows. Rows are dealt to them once, copies merged.
2. Each leaf finds the k nearest among its own rows. The k-th distance is a proven radius: a row whose ball meets the bounds of
   no other leaf is done.
3. The others visit the leaves their balls meet (with a period, also as images), which send back at most k distances each.
4. A leaf merges what its rows were sent.

The exchanges are keyed by leaf, none by row. The result is exact and no candidate is capped; the sample decides the balance
only. A leaf that very many rows visit is split by salts. Smoothing lengths that lie beyond the k-th neighbour are solved
over all rows in reach, by sums instead of lists, that visit the leaves in the same way.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.kdtree import Cloud, Leaves, far_from, kernel_sums, nearest_in
from motefield.session import checkpoint

# the Arrow helpers travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 50
TARGET = 32
LEAF = 16_384  # rows of a leaf, as long as that makes at most 2^DEPTH leaves
SMALL = 2048  # leaves are not made smaller than this for the sake of more tasks
DEPTH = 14
VISITS = 4 * LEAF  # a leaf with more visits is split
TRIALS = 128

POINT = "x double, y double, z double, copies long"


# ---- leaves ----------------------------------------------------------------------------------


def _xyz(table) -> np.ndarray:
    return np.stack([table.column(a).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(a).to_numpy()
                     for a in "xyz"], axis=1)


def _merged(xyz: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with the sum of their copies."""
    order = np.lexsort(xyz.T)
    xyz, copies = xyz[order], copies[order]
    first = np.ones(len(xyz), bool)
    first[1:] = (xyz[1:] != xyz[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return xyz[at], np.add.reduceat(copies, at) if len(at) else copies


def _list_column(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists, without their infinite ends."""
    ok = np.isfinite(values)
    offsets = np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[ok]))


def _matrix(column, k: int) -> np.ndarray:
    """Lists as rows of a matrix, filled with infinity."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(size), k), np.inf)
    out[np.arange(k) < size[:, None]] = column.flatten().to_numpy()
    return out


@dataclass
class Space:
    """Rows dealt to leaves: ``rows`` has ``leaf, i, x, y, z, copies``, ``d``, ascending distances to the nearest of the own leaf, and
    ``to``, the leaves that may hold nearer ones."""

    rows: DataFrame
    k: int
    period: float | None
    parts: int
    low: np.ndarray
    high: np.ndarray


def _images(period: float | None) -> list[tuple[int, np.ndarray]]:
    """Number and shift of each image of the box; 13 is the box itself."""
    if period is None:
        return [(13, np.zeros(3))]
    return [(s, (np.array([s % 3, s // 3 % 3, s // 9]) - 1) * period) for s in range(27)]


def _met(xyz: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, images, skip: int = -1) -> pa.ListArray:
    """For each row, numbers of the leaves (times 27, plus the image) that its ball meets, but for the leaf ``skip`` itself."""
    far = reach * (1 + 1e-12)
    row, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, shift in images:
        near = np.flatnonzero(far_from(xyz.min(axis=0) + shift, xyz.max(axis=0) + shift, low, high) <= far.max() ** 2)
        for leaf in near[(near != skip) | (s != 13)]:
            gap = np.maximum(np.maximum(low[leaf] - xyz - shift, xyz + shift - high[leaf]), 0.0)
            hit = np.flatnonzero((gap * gap).sum(axis=1) <= far * far)
            row.append(hit)
            number.append(np.full(len(hit), 27 * leaf + s))
    row, number = np.concatenate(row), np.concatenate(number)
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(xyz)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[order].astype(np.int32)))


def space_of(df: DataFrame, k: int, period: float | None) -> Space | None:
    """Deals the rows of ``x, y, z`` to leaves and searches each for itself. Rows with a null coordinate are left out."""
    rows = df.select(*(F.col(a).cast("double").alias(a) for a in "xyz")).where("x is not null and y is not null and z is not null")
    rows = rows.select(*((F.col(a) + F.lit(0.0)).alias(a) for a in "xyz"))  # no negative zeros
    n = rows.count()
    if not n:
        return None
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(n / LEAF, min(2 * tasks, n / SMALL), 1)
    depth = min(DEPTH, int(np.ceil(np.log2(wanted))))
    size = max(4096, 64 << depth)  # of the sample, whatever n is; copies are in it together
    sample = rows.where(F.pmod(F.xxhash64("x", "y", "z"), F.lit(max(1, n // size))) == 0).distinct().limit(4 * size).toPandas()
    leaves = Leaves.of(sample[["x", "y", "z"]].to_numpy(), depth)
    low, high = leaves.boxes(-np.inf, np.inf) if period is None else leaves.boxes(0.0, float(period))
    parts = 1 << leaves.depth
    half, images = None if period is None else period / 2, _images(period)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                xyz, copies = _merged(_xyz(batch), np.ones(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.number(xyz).astype(np.int32)), *(pa.array(xyz[:, a]) for a in range(3)),
                                                  pa.array(copies)], ["leaf", "x", "y", "z", "copies"])

    def search(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        cloud = Cloud(*_merged(_xyz(table), table.column("copies").to_numpy()))
        m = len(cloud.xyz)
        d = np.sqrt(nearest_in(cloud, cloud, np.full(m, np.inf), k, half))
        return pa.table([pa.array(np.full(m, leaf, np.int32)), pa.array(np.arange(m, dtype=np.int32)), *(pa.array(cloud.xyz[:, a]) for a in range(3)),
                         pa.array(cloud.copies), _list_column(d), _met(cloud.xyz, d[:, k - 1], low, high, images, leaf)],
                        ["leaf", "i", "x", "y", "z", "copies", "d", "to"])

    dealt = rows.mapInArrow(deal, f"leaf int, {POINT}").repartition(parts, "leaf")
    found = checkpoint(dealt.groupBy("leaf").applyInArrow(search, f"leaf int, i int, {POINT}, d array<double>, to array<int>"))
    return Space(found, k, period, parts, low, high)


def visit(space: Space, rows: DataFrame, carry: Sequence[str], search: Callable, schema: str) -> DataFrame:
    """Sends every row (with its ``carry`` columns) to the leaves in ``to`` and runs ``search(leaf rows, visitors)`` there.

    Visitors have ``home, i`` and coordinates moved to the image in question. Leaves nobody visits are not read.
    """
    calls = rows.select(F.col("leaf").alias("home"), "i", "x", "y", "z", *carry, F.explode("to").alias("to"))
    counts = calls.groupBy(F.expr("to div 27").cast("int").alias("leaf")).count().withColumn("salts", F.ceil(F.col("count") / VISITS).cast("int"))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(r["leaf"], r["salts"]) for r in counts.collect()], "leaf int, salts int")  # at most one row per leaf
    step = float(space.period or 0.0)
    moved = [(F.col(a) + (F.expr(f"to % 27 div {3**k} % 3") - 1) * step).alias(a) for k, a in enumerate("xyz")]
    calls = calls.select("home", "i", *moved, *carry, F.expr("to div 27").cast("int").alias("leaf")).join(F.broadcast(asked), "leaf")
    calls = calls.withColumn("salt", F.pmod(F.hash("home", "i"), F.col("salts"))).drop("salts")
    data = space.rows.select("leaf", "x", "y", "z", "copies").join(F.broadcast(asked), "leaf")
    data = data.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    keys = ["leaf", "salt"]
    left, right = (t.repartition(space.parts, *keys).groupBy(*keys) for t in (data, calls))
    return left.cogroup(right).applyInArrow(search, schema)


# ---- nearest neighbours ----------------------------------------------------------------------


def nearest(df: DataFrame, k: int = K, period: float | None = None) -> DataFrame:
    """``x, y, z, distances``: sorted distances to the k nearest rows of each position, itself included.

    With a period L the box is periodic on every axis. Fewer than k entries come back only if the
    table has fewer rows. Rows with a null coordinate have no neighbours and no row here.
    """
    space = space_of(df, k, period)
    if space is None:
        return df.sparkSession.createDataFrame([], "x double, y double, z double, distances array<double>")
    return nearest_of(space).select("x", "y", "z", F.col("d").alias("distances"))


def nearest_of(space: Space) -> DataFrame:
    """``leaf, i, x, y, z, d`` with the distances over all leaves."""
    k, half = space.k, None if space.period is None else space.period / 2
    far = F.coalesce(F.get("d", F.lit(k - 1)), F.lit(float("inf")))
    done = space.rows.where(F.size("to") == 0).select("leaf", "i", "x", "y", "z", "d")
    open_ = space.rows.where(F.size("to") > 0).withColumn("reach", far)

    def search(data: pa.Table, calls: pa.Table) -> pa.Table:
        found = np.zeros((0, k))
        queries = Cloud(_xyz(calls))
        if calls.num_rows and data.num_rows:
            reach = calls.column("reach").to_numpy()[queries.order] * (1 + 1e-12)
            found = nearest_in(Cloud(_xyz(data), data.column("copies").to_numpy()), queries, reach * reach, k, half)
        any_ = np.isfinite(found[:, 0])
        order = pa.array(queries.order[: len(found)][any_])
        return pa.table([calls.column("home").take(order), calls.column("i").take(order), _list_column(np.sqrt(found[any_]))], ["home", "i", "more"])

    found = visit(space, open_, ["reach"], search, "home int, i int, more array<double>")

    def merge(own: pa.Table, more: pa.Table) -> pa.Table:
        d = _matrix(own.column("d"), k)
        place = np.zeros(int(own.column("i").to_numpy().max()) + 1 if own.num_rows else 0, np.int64)
        place[own.column("i").to_numpy()] = np.arange(own.num_rows)
        row = place[more.column("i").to_numpy()]
        order = np.argsort(row, kind="stable")
        lists, row = _matrix(more.column("more"), k)[order], row[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)  # one list of every row at a time
        for t in range(int(turn.max()) + 1 if len(turn) else 0):
            now = turn == t
            d[row[now]] = np.sort(np.concatenate([d[row[now]], lists[now]], axis=1), axis=1)[:, :k]
        return pa.table([*(own.column(c) for c in ("leaf", "i", "x", "y", "z")), _list_column(d)], ["leaf", "i", "x", "y", "z", "d"])

    own = open_.select("leaf", "i", "x", "y", "z", "d").repartition(space.parts, "leaf").groupBy("leaf")
    joined = own.cogroup(found.repartition(space.parts, "home").groupBy("home")).applyInArrow(
        merge, "leaf int, i int, x double, y double, z double, d array<double>")
    return done.unionByName(joined)


# ---- smoothing lengths -----------------------------------------------------------------------


def usable_period(df: DataFrame, box_size: float | None) -> float | None:
    """The box is periodic only if its size is positive and every coordinate lies in [0, L)."""
    if not box_size or box_size <= 0:
        return None
    row = df.agg(F.min(F.least("x", "y", "z")).alias("lo"), F.max(F.greatest("x", "y", "z")).alias("hi")).first()
    inside = row["lo"] is not None and row["lo"] >= 0 and row["hi"] < box_size
    return float(box_size) if inside else None


def _neighbour_number(h: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Kernel-weighted count (4π/3)h³·ΣW(r/h) with the 3-D cubic spline of norm 8/π."""
    r = dist / h[:, None]
    w = np.where(r <= 0.5, 1 - 6 * r * r * (1 - r), 2 * np.clip(1 - r, 0, None) ** 3)
    return (32.0 / 3.0) * np.where(np.isfinite(dist), w, 0.0).sum(axis=1)


def _farthest(target: float, n: np.ndarray) -> np.ndarray:
    """How many times the last distance a solution can be: with n rows at it, the kernel w(x) counts n·w(x)."""
    need = np.minimum(3.0 * target / (32.0 * n), 1.0)
    lo, hi = np.zeros(len(n)), np.ones(len(n))
    for _ in range(60):  # w falls from 1 to 0 on [0, 1]
        x = 0.5 * (lo + hi)
        w = np.where(x <= 0.5, 1 - 6 * x * x * (1 - x), 2 * (1 - x) ** 3)
        lo, hi = np.where(w >= need, x, lo), np.where(w >= need, hi, x)
    return np.where(need < 1, 1 / np.maximum(lo, 1e-9), 1.0)


def _solve(dist: np.ndarray, sizes: np.ndarray, k: int, target: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest bracketed h with neighbour number ``target``; False where the list is too short for it; and the
    last distance. A list of fewer than k holds the whole table, so its solution may lie beyond its end."""
    last = np.maximum(np.nanmax(np.where(np.isfinite(dist), dist, np.nan), axis=1), 1e-300)
    top = np.where(sizes < k, last * _farthest(target, sizes.astype(float)), last)
    ok = (_neighbour_number(top, dist) >= target) | (sizes < k)
    lo, hi = np.zeros(len(dist)), top.copy()
    for _ in range(steps):
        mid = 0.5 * (lo + hi)
        over = _neighbour_number(np.maximum(mid, 1e-300), dist) >= target
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
    return 0.5 * (lo + hi), ok, last


def solve_lengths(lists: DataFrame, k: int, target: float = TARGET, steps: int = 40) -> DataFrame:
    """Bisection for the smoothing length on each row's own distance list, one Arrow batch at a time.

    ``solved`` is false where the neighbour number at the last distance is still below the target.
    """
    schema = "leaf int, i int, x double, y double, z double, hsml double, solved boolean, last double, reach double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sizes = pdf["d"].str.len().to_numpy()
                dist = np.full((len(pdf), sizes.max()), np.inf)
                dist[np.arange(sizes.max()) < sizes[:, None]] = np.concatenate(pdf["d"].to_numpy())
                h, ok, last = _solve(dist, sizes, k, target, steps)
                reach = np.where(sizes < k, np.inf, np.maximum(last, h))  # a short list holds the whole table
                yield pdf[["leaf", "i", "x", "y", "z"]].assign(hsml=h, solved=ok, last=last, reach=reach)

    return lists.select("leaf", "i", "x", "y", "z", "d").mapInPandas(run, schema)


def _narrowed(space: Space, open_: DataFrame, target: float) -> DataFrame:
    """One pass over the brackets ``lo..hi``: the neighbour number at TRIALS + 1 radii of each, summed over the rows within
    ``hi`` in every leaf it meets. The step that reaches the target is the new bracket, and ``cut`` the solution of a parabola
    through it and the radius next to it."""
    half, images = None if space.period is None else space.period / 2, _images(space.period)
    low, high = space.low, space.high
    parts = np.arange(TRIALS + 1) / TRIALS
    names = ["lo", "hi", "x0", "y0", "z0"]
    rows = open_.select("leaf", "i", "x", "y", "z", "lo", "hi", *(F.col(a).alias(f"{a}0") for a in "xyz"))  # x0: where it is, not its image

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, _met(_xyz(batch), batch.column("hi").to_numpy(), low, high, images)], [*batch.schema.names, "to"])

    def search(data: pa.Table, calls: pa.Table) -> pa.Table:
        queries = Cloud(_xyz(calls))
        order = pa.array(queries.order)
        lo, hi = (calls.column(c).to_numpy()[queries.order][:, None] for c in ("lo", "hi"))
        sums = kernel_sums(Cloud(_xyz(data), data.column("copies").to_numpy()), queries, lo + (hi - lo) * parts, half) if calls.num_rows else np.zeros((0, len(parts)))
        return pa.table([*(calls.column(c).take(order) for c in ("home", "i", *names)), _list_column(sums)], ["leaf", "i", *names, "sums"])

    def step(table: pa.Table) -> pa.Table:
        _, first, row = np.unique(table.column("i").to_numpy(), return_index=True, return_inverse=True)
        n = np.zeros((len(first), len(parts)))
        np.add.at(n, row, _matrix(table.column("sums"), len(parts)) * (32.0 / 3.0))
        pick = table.take(pa.array(first))
        lo, hi = pick.column("lo").to_numpy(), pick.column("hi").to_numpy()
        h = lo[:, None] + (hi - lo)[:, None] * parts
        over = n >= target
        over[:, 0] = False
        j = np.where(over.any(axis=1), over.argmax(axis=1), TRIALS)
        at = np.arange(len(first))
        cut = _crossed(target, *(m[at, c] for c in (j - 1, j, np.where(j < TRIALS, j + 1, j - 2)) for m in (n, h)))
        return pa.table([*(pick.column(c) for c in ("leaf", "i", "x0", "y0", "z0")), *(pa.array(v) for v in (h[at, j - 1], h[at, j], cut))],
                        ["leaf", "i", "x", "y", "z", "lo", "hi", "cut"])

    met = rows.mapInArrow(meet, rows.select("*", F.array(F.lit(0)).alias("to")).schema)
    sums = visit(space, met, names, search, "leaf int, i int, lo double, hi double, x0 double, y0 double, z0 double, sums array<double>")
    return sums.repartition(space.parts, "leaf").groupBy("leaf").applyInArrow(
        step, "leaf int, i int, x double, y double, z double, lo double, hi double, cut double")


def _crossed(target: float, n0, h0, n1, h1, n2, h2) -> np.ndarray:
    """Where h(n), a parabola through three points, is at the target; a line through the first two if it leaves their range."""
    flat = n1 <= n0
    line = np.where(flat, 0.5 * (h0 + h1), h0 + (h1 - h0) * np.clip((target - n0) / np.where(flat, 1.0, n1 - n0), 0.0, 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        bow = (h0 * (target - n1) * (target - n2) / ((n0 - n1) * (n0 - n2)) + h1 * (target - n0) * (target - n2) / ((n1 - n0) * (n1 - n2))
               + h2 * (target - n0) * (target - n1) / ((n2 - n0) * (n2 - n1)))
        return np.where((bow >= h0) & (bow <= h1), bow, line)


def smoothing_lengths(df: DataFrame, k: int = K, target: float = TARGET, box_size: float | None = None, passes: int = 2,
                      reach: bool = False) -> DataFrame:
    """``x, y, z, hsml`` per position: the h at which the neighbour number over *all* rows is ``target``.

    With ``reach`` also the distance up to which rows took part in it: rows beyond change nothing.

    Most rows find it within their k nearest. For the others it lies beyond the k-th distance d, and below 2d
    (k rows at half of h count k·8/3, more than the target): their brackets are narrowed over all rows they
    hold, 128 times a pass, and the last one is cut by a parabola, an error of about 1e-11 of h after two.
    A table of so few rows that none can reach the target gives the farthest distance. Rows with a null
    coordinate have no neighbours and no row here.
    """
    k = max(k, int(np.ceil(3 * target / 8)) + 1)
    space = space_of(df, k, usable_period(df, box_size))
    if space is None:
        return df.sparkSession.createDataFrame([], "x double, y double, z double, hsml double" + ", reach double" * reach)
    names = ["x", "y", "z", "hsml", *(["reach"] if reach else [])]
    solved = checkpoint(solve_lengths(nearest_of(space), k, target))
    out = solved.where("solved").select(*names)
    open_ = solved.where("not solved").select("leaf", "i", "x", "y", "z", F.col("last").alias("lo"), (F.col("last") * 2).alias("hi"))
    if open_.isEmpty():
        return out
    for _ in range(passes):
        open_ = checkpoint(_narrowed(space, open_, target))
    return out.unionByName(open_.select("x", "y", "z", F.col("cut").alias("hsml"), F.col("cut").alias("reach")).select(*names))


def with_smoothing_lengths(df: DataFrame, keep: Sequence[str] | None = None, **args) -> DataFrame:
    """``df`` with an ``hsml`` column from its own neighbours; null where a coordinate is null."""
    keep = [c for c in (keep or df.columns) if c != "hsml"]
    return df.select(*keep).join(smoothing_lengths(df.select("x", "y", "z"), **args), ["x", "y", "z"], "left")
