"""Whole jobs: particles to an image, and a fly-through as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.fields import FieldSpec, single_field, slot_field
from motefield.operators.camera import Camera, fields_of, literal
from motefield.operators.flight import fan_out_seen
from motefield.operators.ranges import auto_range
from motefield.operators.resolve import colored, composite_joined
from motefield.operators.splat import accumulate, contributions, splat
from motefield.session import checkpoint


def field_map(pool: DataFrame, cam: Camera, spec: FieldSpec, kernel: str = "cubic_spline", structured: bool = False) -> DataFrame:
    """Accumulator of one field; ``pool`` has x, y, z, hsml and the fields the spec names.

    Cells of a ``structured`` mesh are drawn with twice their length, so that neighbours overlap and the map does
    not show the grid.
    """
    forward, _, _ = cam.basis()
    weight, qty = single_field(pool, spec, forward, cam.position)
    return splat(pool, cam, weight, F.col("hsml") * 2.0 if structured else "hsml", qty, kernel)


def field_image(pool: DataFrame, cam: Camera, spec: FieldSpec, colormap: str = "hot", kernel: str = "cubic_spline",
                structured: bool = False) -> DataFrame:
    """Image of one field over its automatic range. The particles are read once."""
    accum = checkpoint(field_map(pool, cam, spec, kernel, structured))
    low, high, log = auto_range(accum, spec.resolve_code, spec.log).first()
    return colored(accum, cam, spec.resolve_code, low, high, log, colormap)


def six_sums(pool: DataFrame, cam: Camera, first: tuple[Column, Column | None], second: tuple[Column, Column | None],
             kernel: str = "cubic_spline") -> DataFrame:
    """``num, den, sq`` of two slots (weight, quantity) in one pass: every splat is cut to pixels once.

    The geometry carries mass 1, so each slot's weight multiplies the kernel afterwards. A row that lacks a
    slot's weight or quantity counts in none of that slot's sums; a pixel stays if either slot has any.
    """
    one = F.lit(1.0)
    cols = {n + i: one if c is None else c for i, slot in (("1", first), ("2", second)) for n, c in zip("wq", slot)}
    base = pool.select("x", "y", "z", "hsml", *[c.alias(n) for n, c in cols.items()])
    hits = contributions(base, literal(cam), one, F.col("hsml"), kernel=kernel, keep=list(cols))
    sums = {}
    for i in "12":
        s, q = F.col("sigma") * F.col("w" + i), F.col("q" + i)
        sums |= {"den" + i: F.when(q.isNotNull(), s), "num" + i: s * q, "sq" + i: s * q * q}
    six = hits.groupBy("px", "py").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    return six.where("den1 is not null or den2 is not null")


def composite_image(pool: DataFrame, cam: Camera, light: FieldSpec, tint: FieldSpec, colormap: str = "hot",
                    kernel: str = "cubic_spline") -> DataFrame:
    """Two fields on one geometry: lightness from the first, colour from the second, both auto-ranged."""
    from dataclasses import replace

    forward, _, _ = cam.basis()
    slots = [slot_field(pool, s, forward, cam.position) for s in (light, tint)]
    six = checkpoint(six_sums(pool, cam, *slots, kernel=kernel))
    ranged = []
    for i, spec in (("1", light), ("2", tint)):
        slot = six.select("px", "py", *[F.col(c + i).alias(c) for c in ("num", "den", "sq")])
        low, high, log = auto_range(slot, spec.resolve_code, spec.log, mass_weighted=i == "1").first()
        ranged.append(replace(spec, low=low, high=high, log=log))
    return composite_joined(six, *ranged, colormap)


def fly_through(pool: DataFrame, path: Sequence[Camera], spec: FieldSpec, kernel: str = "cubic_spline") -> DataFrame:
    """Accumulators of all frames of a path in one job: ``cam_id, px, py, [num,] den[, sq]``.

    Each frame has its own size, and vector fields are projected along its own lines of sight: the fields a
    projection needs travel with the row, and the frame's position is a column like its other values. A row is copied only for
    the frames that can see the cell it lies in.
    """
    frames = fan_out_seen(pool, list(path)).withColumn("cam_id", F.col("cam.cam_id"))
    cam = fields_of()
    weight, qty = single_field(frames, spec, (cam.fx, cam.fy, cam.fz), (cam.px, cam.py, cam.pz))
    base = frames.select("cam", "cam_id", cam.width.alias("across"), cam.height.alias("down"), "x", "y", "z", "hsml", weight.alias("w"), *([qty.alias("q0")] if qty is not None else []))
    hits = contributions(base, cam, F.col("w"), F.col("hsml"), F.col("q0") if qty is not None else None, kernel,
                         keep=["cam_id", "across", "down"], carry=["cam"], width=F.col("across"), height=F.col("down"))
    return accumulate(hits, ["cam_id", "px", "py"], qty is not None)
