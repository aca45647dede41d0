"""From accumulators to values, normalised values and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.color import composite_rgb, lookup
from motefield.operators.camera import Camera

EMPTY = 1e-30


def value(mode: int, num: Column | None, den: Column, sq: Column | None) -> Column:
    """0: the density itself, 1: weighted mean, 2: weighted standard deviation."""
    if mode == 0:
        return den
    mean = num / den
    return mean if mode == 1 else F.sqrt(F.greatest(sq / den - mean * mean, F.lit(0.0)))


def resolved(accum: DataFrame, mode: int) -> DataFrame:
    """``value`` and ``weight`` of every non-empty pixel."""
    num, sq = (F.col(c) if c in accum.columns else None for c in ("num", "sq"))
    keys = [c for c in accum.columns if c not in ("num", "den", "sq")]
    full = accum.where(F.col("den") > EMPTY)
    return full.select(*keys, value(mode, num, F.col("den"), sq).alias("value"), F.col("den").alias("weight"))


def normalised(v: Column, low, high, log: bool) -> Column:
    """0..1 over the range, on a log10 axis if asked."""
    low, high = (F.lit(float(b)) if isinstance(b, (int, float)) else b for b in (low, high))
    v = F.log10(F.greatest(v, F.lit(1e-30))) if log else v
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))


def pixel_grid(spark, cam: Camera) -> DataFrame:
    """Every pixel of the screen, made on the executors."""
    cells = spark.range(cam.width * cam.height)
    return cells.selectExpr(f"cast(id % {cam.width} as int) px", f"cast(id div {cam.width} as int) py")


def dense(accum: DataFrame, cam: Camera) -> DataFrame:
    """The accumulator with a row for every pixel, zero where nothing was drawn."""
    sums = [c for c in ("num", "den", "sq") if c in accum.columns]
    return pixel_grid(accum.sparkSession, cam).join(accum, ["px", "py"], "left").fillna(0.0, sums)


def colored(accum: DataFrame, cam: Camera, mode: int, low, high, log: bool, colormap: str = "hot") -> DataFrame:
    """Image rows ``px, py, r, g, b, a`` (0..1) for the whole screen; empty pixels are opaque black."""
    num, sq = (F.col(c) if c in accum.columns else None for c in ("num", "sq"))
    full = dense(accum, cam)
    v = F.when(F.col("den") >= EMPTY, normalised(value(mode, num, F.col("den"), sq), low, high, log))
    rgb = lookup(full.withColumn("t", v), "t", colormap)
    black = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in "rgb"]
    return rgb.select("px", "py", *black, F.lit(1.0).alias("a"))


def as_bytes(image: DataFrame) -> DataFrame:
    """8-bit channels, rounded."""
    return image.select("px", "py", *[F.round(F.col(c) * 255.0).cast("int").alias(c) for c in "rgba"])


def composite(first: DataFrame, second: DataFrame, cam: Camera, spec1, spec2, colormap: str = "hot") -> DataFrame:
    """Two accumulators on one screen: the first sets lightness, the second the colour."""
    a = first.select("px", "py", *[F.col(c).alias(c + "1") for c in ("num", "den", "sq")])
    b = second.select("px", "py", *[F.col(c).alias(c + "2") for c in ("num", "den", "sq")])
    return composite_joined(a.join(b, ["px", "py"], "full_outer"), spec1, spec2, colormap)


def composite_joined(both: DataFrame, spec1, spec2, colormap: str = "hot") -> DataFrame:
    """As :func:`composite`, from one table holding both slots' six sums."""
    def part(i, spec, empty):
        num, den, sq = (F.col(f"{c}{i}") for c in ("num", "den", "sq"))
        full = F.coalesce(den, F.lit(0.0)) >= EMPTY
        t = normalised(value(spec.resolve_code, num, den, sq), spec.low, spec.high, spec.log)
        return F.when(full, t).otherwise(F.lit(empty)), full

    light, full1 = part(1, spec1, 0.0)
    tint, full2 = part(2, spec2, 0.5)
    shown = both.select("px", "py", light.alias("light"), tint.alias("t"), (full1 | full2).alias("shown"))
    rgb = composite_rgb(lookup(shown, "t", colormap), "light")
    return rgb.select("px", "py", *[F.when(F.col("shown"), F.col(c)).otherwise(0.0).alias(c) for c in "rgb"],
                      F.lit(1.0).alias("a"))
