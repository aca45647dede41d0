"""Particles to per-pixel sums: project, cut to pixels, weight with a kernel, add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.kernels import kernel as kernel_value
from motefield.operators.camera import Camera, in_depth_range, literal, ndc, view

EDGE = 1e-9  # pixel ranges are widened by this much; the exact r <= 1 test decides


def projected(df: DataFrame, cam, mass: Column, hsml: Column, qty: Column | None = None,
              keep: Sequence[str] = (), xyz: Sequence[str] = ("x", "y", "z"),
              width=None, height=None, carry: Sequence[str] = ()) -> DataFrame:
    """Screen geometry of each particle in pixels: centre ``cx, cy``, radii ``rx, ry``, and ``a`` = m/h².

    Pixel centres are the integers: column i of W has NDC 2(i+1/2)/W-1, row j of H has 1-2(j+1/2)/H.
    Only the columns the splat needs survive, so the scan is pruned and the explode stays narrow.
    A particle outside the depth range gets null geometry and yields no pixel below. ``keep`` columns
    stay to the end; ``carry`` columns (a camera struct) only until the geometry is done.
    """
    width = cam.width if width is None else width
    height = cam.height if height is None else height
    x, y, z = (F.col(c) for c in xyz)
    cols, more = [F.col(c) for c in keep], [F.col(c) for c in carry]
    extra = ["q"] if qty is not None else []
    base = df.select(*cols, *more, *[c.alias(n) for n, c in view(cam, x, y, z).items()],
                     mass.alias("m"), hsml.alias("h"), *([qty.alias("q")] if qty is not None else []))
    depth, h = F.col("depth"), F.col("h")
    seen = in_depth_range(cam, depth) & (h > 0)
    base = base.select(*cols, *more, F.when(seen, depth).alias("depth"), "right_d", "up_d", "m", F.when(seen, h).alias("h"), *extra)
    at = ndc(cam, depth, F.col("right_d"), F.col("up_d"))
    return base.select(
        *cols, ((at["nx"] + 1.0) * width / 2 - 0.5).alias("cx"), ((1.0 - at["ny"]) * height / 2 - 0.5).alias("cy"),
        (cam.focal / cam.aspect * h / depth * width / 2).alias("rx"), (cam.focal * h / depth * height / 2).alias("ry"),
        (F.col("m") / (h * h)).alias("a"), *extra,
    )


# The emptiness test of a pixel range lives in the generator, not in a filter: Catalyst would push
# such a filter down to the scan and repeat the projection arithmetic there, and the repeated code
# takes the generated method over the size the JVM compiles.


def _span(df: DataFrame, center: Column, half: Column, limit) -> DataFrame:
    """Integer range ``lo..hi`` of pixel centres within ``half`` of ``center``, clipped to the screen."""
    return df.withColumns({
        "lo": F.greatest(F.ceil(center - half - EDGE), F.lit(0)).cast("int"),
        "hi": F.least(F.floor(center + half + EDGE), limit - 1).cast("int"),
    })


def _each(test: Column | None = None) -> Column:
    lo, hi = F.col("lo"), F.col("hi")
    ok = lo <= hi if test is None else (lo <= hi) & test
    return F.explode(F.when(ok, F.sequence(lo, hi)))


def cut_rows(shape: DataFrame, width, height) -> DataFrame:
    """One row per particle and pixel row whose centre line crosses the disc."""
    cx, cy, rx, ry = (F.col(c) for c in ("cx", "cy", "rx", "ry"))
    on_screen = (cx + rx >= -EDGE) & (cx - rx <= width - 1 + EDGE)
    rows = _span(shape, cy, ry, height).withColumn("py", _each(on_screen)).drop("lo", "hi")
    dy = (F.col("py") - cy) / ry
    return rows.withColumn("dy2", dy * dy).drop("cy", "ry")


def cut_pixels(rows: DataFrame, width) -> DataFrame:
    """One row per covered pixel centre with the squared kernel radius ``r2`` (up to rounding <= 1)."""
    cx, rx = F.col("cx"), F.col("rx")
    rows = rows.withColumn("half", rx * F.sqrt(F.greatest(1.0 - F.col("dy2"), F.lit(0.0))))
    px = _span(rows, cx, F.col("half"), width).drop("half").withColumn("px", _each()).drop("lo", "hi")
    dx = (F.col("px") - cx) / rx
    return px.withColumn("r2", dx * dx + F.col("dy2")).drop("cx", "rx", "dy2")


def contributions(df: DataFrame, cam, mass: Column, hsml: Column, qty: Column | None = None,
                  kernel: str = "cubic_spline", keep: Sequence[str] = (), width=None, height=None,
                  xyz: Sequence[str] = ("x", "y", "z"), carry: Sequence[str] = (),
                  large: float | None = None) -> DataFrame:
    """Per particle and pixel: ``sigma`` = m·W(r)/h², and ``q`` if a quantity is given.

    With ``large``, discs of a bigger radius (in pixels) are cut to pixel rows first and those are
    spread over all tasks, so that a few partitions near the camera do not draw most of the pixels.
    """
    width = cam.width if width is None else width
    height = cam.height if height is None else height
    shape = projected(df, cam, mass, hsml, qty, keep, xyz, width, height, carry)
    if large is None:
        rows = cut_rows(shape, width, height)
    else:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        big = cut_rows(shape.where(F.col("ry") > large), width, height).repartition(parts)
        rows = cut_rows(shape.where(F.col("ry") <= large), width, height).unionByName(big)
    px = cut_pixels(rows, width)
    sigma = F.when(F.col("r2") <= 1.0, F.col("a") * kernel_value(kernel, F.col("r2")))
    return px.select(*keep, "px", "py", sigma.alias("sigma"), *(["q"] if qty is not None else []))


def accumulate(hits: DataFrame, by: Sequence[str] = ("px", "py"), with_qty: bool = True) -> DataFrame:
    """Additive sums per pixel: ``num`` Σσq, ``den`` Σσ, ``sq`` Σσq². A row without a quantity (null: its
    part lacks the field) counts in none of them, so means are those of the rows that have one.

    Sums are partial per map task before the exchange, so a pixel that most particles touch costs
    no more than any other. A null sigma (pixel centre outside the kernel) adds nothing.
    """
    weight = F.when(F.col("q").isNotNull(), F.col("sigma")) if with_qty else F.col("sigma")
    aggs = [F.sum(weight).alias("den")]
    if with_qty:
        hits = hits.withColumn("sigma_q", F.col("sigma") * F.col("q"))
        aggs = [F.sum("sigma_q").alias("num"), *aggs, F.sum(F.col("sigma_q") * F.col("q")).alias("sq")]
    return hits.groupBy(*by).agg(*aggs).where(F.col("den").isNotNull())


def splat(df: DataFrame, cam: Camera, mass: Column | str = "mass", hsml: Column | str = "hsml",
          qty: Column | str | None = None, kernel: str = "cubic_spline",
          xyz: Sequence[str] = ("x", "y", "z"), large: float | None = None) -> DataFrame:
    """The accumulator of one camera: ``px, py, [num,] den[, sq]`` for every touched pixel."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    q = None if qty is None else as_col(qty)
    hits = contributions(df, literal(cam), as_col(mass), as_col(hsml), q, kernel, xyz=xyz, large=large)
    return accumulate(hits, with_qty=qty is not None)
