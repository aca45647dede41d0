"""Camera paths over many rows: frames are tested against occupied cells before any row is copied.

Rows fall into coarse cells around the path, by octave of their smoothing length. The table of occupied cells with their bounds is
small whatever the data holds; it meets all frames, and only the pairs in which a frame can see a cell are kept. A row
then meets the frames of its cell by equi-join, so a frame that sees a hundredth of space costs a hundredth of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.camera import Camera, box_meets, fan_out
from motefield.operators.skew import salted_join

SIDES = 4  # directions from the centre to each side of a cube
PAIRS = 200_000  # up to so many pairs of cell and frame (some 200 bytes each) are broadcast


def occupied(df: DataFrame, center: Sequence[float], hsml: str = "hsml") -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_cell``, and the cells in use with bounds ``lo*, hi*``, longest ``h`` and row count ``n``, from one scan.

    Cells are directions and half octaves of distance, seen from ``center``, so no bounds of the data are needed first: some 400
    per shell and octave of length in use. Rows that can draw nothing (null coordinate, length not positive) are left out.
    """
    h = F.col(hsml)
    rows = df.where((h > 0) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    gap = [F.col(a) - float(c) for a, c in zip("xyz", center)]
    far = F.greatest(*(F.abs(g) for g in gap))
    cell = F.floor(F.log2(h)) * 8192 + F.when(far > 0, F.floor(2 * F.log2(far))).otherwise(-4096)
    for g in gap:
        cell = cell * (2 * SIDES + 1) + F.when(far > 0, F.floor(g / far * SIDES)).otherwise(0)
    rows = rows.withColumn("_cell", F.coalesce(cell.cast("long"), F.lit(0).cast("long")))
    cells = rows.groupBy("_cell").agg(
        *[f(a).alias(n + a) for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))], F.max(hsml).alias("h"), F.count(F.lit(1)).alias("n"))
    return rows, cells


def seen_cells(cells: DataFrame, path: Sequence[Camera]) -> DataFrame:
    """Pairs ``_cell, cam_id`` of a cell and a frame that may see it, as a small table.

    The cells come to the driver: their number is bounded by `occupied`, whatever the data holds. Each frame is one test of all cells.
    """
    found = cells.select("_cell", *(n + a for n in ("lo", "hi") for a in "xyz"), "h").toPandas()
    low, high = ({a: found[n + a].to_numpy() for a in "xyz"} for n in ("lo", "hi"))
    hit = [np.flatnonzero(box_meets(cam, low, high, found["h"].to_numpy())) for cam in path]
    pairs = pd.DataFrame({"_cell": found["_cell"].to_numpy()[np.concatenate(hit)] if hit else [], "cam_id": np.repeat(np.arange(len(hit)), [len(h) for h in hit])})
    return cells.sparkSession.createDataFrame(pairs.astype({"_cell": "int64", "cam_id": "int32"}), "_cell long, cam_id int")


def fan_out_seen(df: DataFrame, path: Sequence[Camera], hsml: str = "hsml", name: str = "cam", few: int = PAIRS) -> DataFrame:
    """As `camera.fan_out`, without the copies of rows that lie in cells a frame cannot see. Maps stay the same.

    ``df`` has ``x, y, z`` and ``hsml``. Up to ``few`` pairs of cell and frame are broadcast; more are joined by shuffle, where the
    rows of a cell that holds much of the data are split by salts. Frames are configuration, a broadcast table.
    """
    center = [sum(c.position[k] for c in path) / len(path) for k in range(3)]
    rows, cells = occupied(df, center, hsml)
    pairs = seen_cells(cells, path)
    frames = fan_out(df.sparkSession.range(1), list(path), name).select(name, F.col(f"{name}.cam_id").alias("cam_id"))
    if pairs.count() <= few:
        out = rows.join(F.broadcast(pairs.join(F.broadcast(frames), "cam_id").drop("cam_id")), "_cell")
    else:
        out = salted_join(rows, pairs, ["_cell"], ["x", "y", "z"]).join(F.broadcast(frames), "cam_id").drop("cam_id")
    return out.drop("_cell")
