"""Multi-resolution splatting: big discs go to coarse grids, which are then blended into finer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.kernels import kernel as kernel_value
from motefield.operators.camera import Camera, literal, view
from motefield.operators.splat import accumulate, cut_pixels, cut_rows, projected
from motefield.session import checkpoint

LEVELS = 6
KERNEL_CELLS = 4.0


def grid_size(n: int, level: int) -> int:
    return max(n >> level, 1)


def level_of(radius_px: Column, n_levels: int = LEVELS, kernel_cells: float = KERNEL_CELLS) -> Column:
    """Grid level of a disc: one step per doubling of its radius over ``kernel_cells`` pixels."""
    steps = (F.when(radius_px >= kernel_cells * 2.0**k, 1).otherwise(0) for k in range(1, n_levels))
    return sum(steps, F.lit(0)).cast("int")


def with_level(df: DataFrame, cam: Camera, hsml: str = "hsml", n_levels: int = LEVELS) -> DataFrame:
    c = literal(cam)
    depth = F.greatest(view(c, F.col("x"), F.col("y"), F.col("z"))["depth"], F.lit(1e-20))
    radius = F.col(hsml) * cam.focal / depth * 0.5 * cam.width
    return df.withColumn("level", level_of(radius, n_levels))


def level_ranges(df: DataFrame, n_levels: int = LEVELS) -> DataFrame:
    """Rows per level and the exclusive running count; empty levels are listed too."""
    counts = df.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n_levels).select(F.col("id").cast("int").alias("level"))
    counts = every.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    before = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


def _axis(df: DataFrame, name: str, coarse: int, fine: int) -> DataFrame:
    """Spreads a coarse index over the fine indices it feeds, with its bilinear weight on that axis."""
    c, ratio = F.col(name), coarse / fine
    lo = F.greatest(F.ceil((c - 0.5) / ratio - 0.5 - 1e-9), F.lit(0)).cast("int")
    hi = F.least(F.floor((c + 1.5) / ratio - 0.5 + 1e-9), F.lit(fine - 1)).cast("int")
    # the edge cells also feed everything beyond their centre
    lo = F.when(c == 0, 0).otherwise(lo)
    hi = F.when(c == coarse - 1, fine - 1).otherwise(hi)
    out = df.withColumn("_f", F.explode(F.sequence(lo, hi)))
    p = (F.col("_f") + 0.5) * ratio - 0.5
    base = F.floor(p)
    clamp = lambda i: F.greatest(F.lit(0), F.least(F.lit(coarse - 1), i))
    w = F.when(clamp(base) == c, 1.0 - (p - base)).otherwise(0.0) + F.when(clamp(base + 1) == c, p - base).otherwise(0.0)
    return out.withColumn(f"_w{name}", w).drop(name).withColumnRenamed("_f", name)


def upsample(accum: DataFrame, coarse: tuple[int, int], fine: tuple[int, int]) -> DataFrame:
    """Bilinear samples of a coarse accumulator at fine pixel centres, edges clamped.

    Each stored coarse pixel is scattered to the fine pixels that read it and the pieces are summed,
    so empty pixels cost nothing and no neighbour join is needed.
    """
    sums = [c for c in ("num", "den", "sq") if c in accum.columns]
    rows = _axis(_axis(accum, "px", coarse[0], fine[0]), "py", coarse[1], fine[1])
    w = F.col("_wpx") * F.col("_wpy")
    return rows.where(w > 0).groupBy("px", "py").agg(*[F.sum(F.col(c) * w).alias(c) for c in sums])


def splat_multigrid(df: DataFrame, cam: Camera, mass: str = "mass", hsml: str = "hsml", qty: str | None = None,
                    kernel: str = "cubic_spline", n_levels: int = LEVELS) -> DataFrame:
    """An approximation of the one-level map that draws no disc over more than a few hundred pixels.

    All levels are drawn in one pass (the grid size is a column); the cascade then works on the
    accumulators, which are no larger than the screen.
    """
    levelled = with_level(df, cam, hsml, n_levels)
    dims = [(grid_size(cam.width, k), grid_size(cam.height, k)) for k in range(n_levels)]
    pick = lambda axis: F.get(F.array(*[F.lit(d[axis]) for d in dims]), F.col("level"))
    levelled = levelled.withColumns({"gw": pick(0), "gh": pick(1)})
    q = None if qty is None else F.col(qty)
    keep = ["level", "gw", "gh"]
    shape = projected(levelled, literal(cam), F.col(mass), F.col(hsml), q, keep, width=F.col("gw"), height=F.col("gh"))
    px = cut_pixels(cut_rows(shape, F.col("gw"), F.col("gh")), F.col("gw"))
    sigma = F.when(F.col("r2") <= 1.0, F.col("a") * kernel_value(kernel, F.col("r2")))
    hits = px.select("level", "px", "py", sigma.alias("sigma"), *(["q"] if qty else []))
    levels = accumulate(hits, ["level", "px", "py"], qty is not None)
    # one pass over the particles; the fold reads the stored sums, at most 4/3 of a screen
    return cascade(checkpoint(levels), dims)


def cascade(levels: DataFrame, dims: list[tuple[int, int]]) -> DataFrame:
    """Folds the levels into level 0, coarsest first. ``levels`` has a ``level`` column."""
    sums = [c for c in ("num", "den", "sq") if c in levels.columns]
    at = lambda k: levels.where(F.col("level") == k).drop("level")
    carried = at(len(dims) - 1)
    for k in range(len(dims) - 1, 0, -1):
        both = at(k - 1).unionByName(upsample(carried, dims[k], dims[k - 1]))
        carried = both.groupBy("px", "py").agg(*[F.sum(c).alias(c) for c in sums])
    return carried
