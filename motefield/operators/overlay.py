"""Stars, markers and tracks drawn over a map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.photometry import BANDS, RGB_BANDS, attenuated, kappa, marker_radius, psf_shade
from motefield.operators.camera import Camera, in_depth_range, literal, ndc, view
from motefield.operators.ordering import bounds_of, in_bucket, neighbour_row
from motefield.operators.raster import painted
from motefield.operators.splat import EDGE, cut_pixels, cut_rows, projected


def band_table(spark) -> DataFrame:
    return spark.createDataFrame([(b, kappa(b)) for b in BANDS], "band string, kappa double")


def extinction(stars: DataFrame, luminosity: str = "luminosity", column: str = "column") -> DataFrame:
    """Dimmed luminosity per star and band. The five bands are an array literal, so no join is planned."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(kappa(b)).alias("kappa")) for b in BANDS])
    rows = stars.withColumn("b", F.explode(bands))
    lum = attenuated(F.col(luminosity), F.col(column), F.col("b.kappa"))
    return rows.select(*stars.columns, F.col("b.band").alias("band"), lum.alias("dimmed"))


def extinction_rgb(stars: DataFrame, luminosity: str = "luminosity", column: str = "column") -> DataFrame:
    """Dimmed luminosity as red, green, blue from the I, V and B bands."""
    lum, col = F.col(luminosity), F.col(column)
    return stars.withColumns({f"l_{c}": attenuated(lum, col, kappa(b)) for c, b in zip("rgb", RGB_BANDS)})


def disc_shapes(stars: DataFrame, cam: Camera, size: str, world_radius: float, exponent: float = 0.5,
                keep: Sequence[str] = ()) -> DataFrame:
    """Centre and radii of each star in pixels; a disc never shrinks below two pixels."""
    c = literal(cam)
    depth = view(c, F.col("x"), F.col("y"), F.col("z"))["depth"]
    radius = marker_radius(F.col(size), world_radius, exponent, depth, cam.focal, cam.height)
    return projected(stars, c, F.lit(1.0), radius, keep=keep)


def star_discs(stars: DataFrame, cam: Camera, size: str, world_radius: float, exponent: float = 0.5,
               keep: Sequence[str] = ()) -> DataFrame:
    """One row per star and covered pixel with ``r2``."""
    c = literal(cam)
    shape = disc_shapes(stars, cam, size, world_radius, exponent, keep)
    px = cut_pixels(cut_rows(shape, c.width, c.height), c.width)
    return px.where(F.col("r2") <= 1.0).select(*keep, "px", "py", "r2")


def psf_overlay(stars: DataFrame, cam: Camera, world_radius: float, intensity: float = 1.0, band: str | None = None,
                size: str = "luminosity", column: str | None = None) -> DataFrame:
    """Light of all stars per pixel, added and clipped to 1. RGB unless one band is named."""
    bands = RGB_BANDS if band is None else (band,) * 3
    col = F.col(column) if column else F.lit(0.0)
    lum = F.greatest(F.col(size), F.lit(1e-6))
    dim = {f"d_{c}": attenuated(F.col(size), col, kappa(b)) / lum for c, b in zip("rgb", bands)}
    hits = star_discs(stars.withColumns(dim), cam, size, world_radius, keep=list(dim))
    amp = [F.sum(psf_shade(F.col("r2"), F.col(f"d_{c}"), intensity)).alias(c) for c in "rgb"]
    sums = hits.groupBy("px", "py").agg(*amp)
    return sums.select("px", "py", *[F.least(F.lit(1.0), F.col(c)).alias(c) for c in "rgb"])


def over_in_order(hits: DataFrame, order: str, alpha: float) -> DataFrame:
    """Source-over blending per pixel in ascending ``order``: ``r, g, b`` premultiplied and ``cover``.

    Opaque drawing keeps the last colour, a partial aggregate. Otherwise blending is associative, so
    the order is cut into ranges, each (pixel, range) is folded on its own, and at most 64 range
    results per pixel are folded at the end: no pixel's full list is ever gathered.
    """
    if alpha >= 1.0:
        last = F.max_by(F.struct("r", "g", "b"), F.col(order)).alias("c")
        return hits.groupBy("px", "py").agg(last).select("px", "py", "c.r", "c.g", "c.b", F.lit(1.0).alias("cover"))
    keep = 1.0 - alpha
    cut = in_bucket(hits, order, bounds_of(hits, order))
    above = F.row_number().over(Window.partitionBy("px", "py", "_b").orderBy(F.col(order).desc())) - 1
    cut = cut.withColumn("w", alpha * F.pow(F.lit(keep), above.cast("double")))
    parts = cut.groupBy("px", "py", "_b").agg(
        *[F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n")
    )
    return _folded(parts, alpha)


def _folded(parts: DataFrame, alpha: float) -> DataFrame:
    """Ranges ``_b`` of the draw order per pixel, premultiplied and with ``n`` discs each, put over one another."""
    if alpha >= 1.0:
        last = F.max_by(F.struct("r", "g", "b"), F.col("_b")).alias("c")
        return parts.groupBy("px", "py").agg(last).select("px", "py", "c.r", "c.g", "c.b", F.lit(1.0).alias("cover"))
    keep = 1.0 - alpha
    later = Window.partitionBy("px", "py").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("t", F.pow(F.lit(keep), F.coalesce(F.sum("n").over(later), F.lit(0)).cast("double")))
    return parts.groupBy("px", "py").agg(
        *[F.sum(F.col(c) * F.col("t")).alias(c) for c in "rgb"],
        (1.0 - F.pow(F.lit(keep), F.sum("n").cast("double"))).alias("cover"),
    )


def marker_overlay(stars: DataFrame, cam: Camera, world_radius: float, order: str, size: str = "luminosity",
                   exponent: float = 0.5, border=(1.0, 1.0, 1.0), border_frac: float = 0.2, opacity: float = 1.0,
                   fill=("fill_r", "fill_g", "fill_b")) -> DataFrame:
    """Filled discs with a border ring, blended in draw order. Discs are sorted and drawn inside the tasks, see `painted`."""
    shape = disc_shapes(stars, cam, size, world_radius, exponent, keep=[order, *fill])
    return _folded(painted(shape, cam, order, fill, [float(b) for b in border], max(0.0, 1.0 - border_frac), opacity), opacity)


def blend(image: DataFrame, overlay: DataFrame, additive: bool = False) -> DataFrame:
    """An overlay on an image: added and clipped, or source-over with its ``cover``."""
    o = overlay.select("px", "py", *[F.col(c).alias("o" + c) for c in "rgb"],
                       *([] if additive else [F.col("cover").alias("oc")]))
    both = image.join(o, ["px", "py"], "left")
    zero = F.lit(0.0)
    if additive:
        rgb = [F.least(F.lit(1.0), F.col(c) + F.coalesce("o" + c, zero)).alias(c) for c in "rgb"]
    else:
        rgb = [(F.col(c) * (1.0 - F.coalesce("oc", zero)) + F.coalesce("o" + c, zero)).alias(c) for c in "rgb"]
    return both.select("px", "py", *rgb, F.lit(1.0).alias("a"))


# ---- tracks ----------------------------------------------------------------------------------


def cut_tracks(tracks: DataFrame, start: float, time: str = "aexp", key: str = "sink_id") -> DataFrame:
    """Points from ``start`` on; tracks left with fewer than two points go."""
    kept = tracks.where(F.col(time) >= start) if start > 0 else tracks
    enough = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(key)
    return kept.join(enough, key, "left_semi")


def segments(tracks: DataFrame, key: str = "sink_id", order: str = "nstep") -> DataFrame:
    """Consecutive points of a track as segments ``x, y, z`` to ``x1, y1, z1``."""
    nxt = neighbour_row(tracks, [key], order, ["x", "y", "z"])
    nxt = nxt.where(F.col("next").isNotNull()).withColumns({f"{a}1": F.col("next")[a] for a in "xyz"})
    return nxt.select(key, order, "x", "y", "z", "x1", "y1", "z1")


def slots(tracks: DataFrame, n: int, chosen: dict[int, int] | None = None, key: str = "sink_id") -> DataFrame:
    """Tracks shown in n slots: slot i holds the (i mod count)-th id, unless one is chosen for it."""
    ids = tracks.select(key).distinct()
    # ids are many only if tracks are; just the n lowest can be a default
    low = ids.orderBy(key).limit(n).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    slot = low.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.size("ids") > 0)
    pick = F.get("ids", F.col("slot") % F.size("ids"))
    for i, sid in (chosen or {}).items():
        pick = F.when(F.col("slot") == i, F.lit(sid)).otherwise(pick)
    slot = slot.select("slot", pick.cast("long").alias(key))
    return F.broadcast(slot).join(tracks, key)


def screen_segments(segs: DataFrame, cam: Camera, keep: Sequence[str] = ()) -> DataFrame:
    """Segments in pixel coordinates; those with an end behind the camera or no length are dropped."""
    c = literal(cam)
    a = view(c, F.col("x"), F.col("y"), F.col("z"))
    b = view(c, F.col("x1"), F.col("y1"), F.col("z1"))
    both = segs.select(*keep, *[v.alias(n + "0") for n, v in a.items()], *[v.alias(n + "1") for n, v in b.items()])
    both = both.where((F.col("depth0") > 0) & (F.col("depth1") > 0))
    ends = {}
    for i in "01":
        at = ndc(c, F.col("depth" + i), F.col("right_d" + i), F.col("up_d" + i))
        ends.update({"nx" + i: at["nx"], "ny" + i: at["ny"]})
    flat = both.select(*keep, *[v.alias(n) for n, v in ends.items()])
    dx, dy = F.col("nx1") - F.col("nx0"), F.col("ny1") - F.col("ny0")
    flat = flat.where(F.sqrt(dx * dx + dy * dy) >= 1e-8)
    px = {f"sx{i}": (F.col(f"nx{i}") + 1.0) * cam.width / 2 - 0.5 for i in "01"}
    py = {f"sy{i}": (1.0 - F.col(f"ny{i}")) * cam.height / 2 - 0.5 for i in "01"}
    return flat.select(*keep, *[v.alias(n) for n, v in {**px, **py}.items()])


def track_overlay(segs: DataFrame, cam: Camera, order: Sequence[str], width: float = 2.0,
                  color=("r", "g", "b")) -> DataFrame:
    """Opaque lines of a true pixel width: a pixel shows the track drawn last over its centre."""
    half = max(0.5, float(width)) / 2
    lines = screen_segments(segs, cam, keep=[*order, *color])
    x0, y0, x1, y1 = (F.col(n) for n in ("sx0", "sy0", "sx1", "sy1"))
    lo = F.greatest(F.ceil(F.least(y0, y1) - half - EDGE), F.lit(0)).cast("int")
    hi = F.least(F.floor(F.greatest(y0, y1) + half + EDGE), F.lit(cam.height - 1)).cast("int")
    rows = lines.withColumns({"lo": lo, "hi": hi})
    rows = rows.withColumn("py", F.explode(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))))
    # along a row the covered span is where |distance| <= half: bounded by the slanted line
    dx, dy = x1 - x0, y1 - y0
    length = F.sqrt(dx * dx + dy * dy)
    at = F.when(F.abs(dy) > 1e-12, x0 + (F.col("py") - y0) * dx / dy)
    reach = F.when(F.abs(dy) > 1e-12, half * length / F.abs(dy))
    left = F.greatest(F.least(x0, x1) - half, F.coalesce(at - reach, F.lit(-1e300)))
    right = F.least(F.greatest(x0, x1) + half, F.coalesce(at + reach, F.lit(1e300)))
    lo = F.greatest(F.ceil(left - EDGE), F.lit(0.0)).cast("int")
    hi = F.least(F.floor(right + EDGE), F.lit(cam.width - 1.0)).cast("int")
    rows = rows.withColumns({"lo": lo, "hi": hi})
    px = rows.withColumn("px", F.explode(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))))
    ex, ey = F.col("px") - x0, F.col("py") - y0
    px = px.withColumns({"along": (ex * dx + ey * dy) / length, "off": F.abs(ex * dy - ey * dx) / length, "len": length})
    hit = px.where((F.col("off") <= half) & (F.col("along") >= 0) & (F.col("along") <= F.col("len")))
    last = F.max_by(F.struct(*[F.col(c).alias(n) for c, n in zip(color, "rgb")]), F.struct(*order)).alias("c")
    return hit.groupBy("px", "py").agg(last).select("px", "py", "c.r", "c.g", "c.b", F.lit(1.0).alias("cover"))


def star_field(stars: DataFrame, name: str | None, fallback):
    """The named per-star field, or the fallback when it is none or absent."""
    return F.col(name).cast("double") if name and name != "None" and name in stars.columns else fallback
