"""Agreement of two maps, the flat-plane second formulation, and frame-log summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.ordering import neighbour_row, percentiles
from motefield.operators.splat import accumulate, cut_pixels, cut_rows
from motefield.functions.kernels import kernel as kernel_value


def compare_maps(a: DataFrame, b: DataFrame, value: str = "den") -> DataFrame:
    """One row: mass ratio b/a, pixels with signal in both, log10 correlation, median |Δlog10|."""
    both = a.select("px", "py", F.col(value).alias("va")).join(
        b.select("px", "py", F.col(value).alias("vb")), ["px", "py"], "full_outer"
    )
    hit = (F.col("va") > 0) & (F.col("vb") > 0)
    la, lb = F.when(hit, F.log10("va")), F.when(hit, F.log10("vb"))
    logs = both.select("va", "vb", la.alias("la"), lb.alias("lb"))
    gap = F.abs(F.col("la") - F.col("lb"))
    logs = logs.withColumn("gap", gap)
    median = percentiles(logs.select("gap", F.lit(0).alias("all")), ["all"], "gap", {"m": 0.5}).select("m").scalar()
    out = logs.agg(
        (F.sum("vb") / F.sum("va")).alias("mass_ratio"),
        F.count("la").alias("overlap"),
        F.corr("la", "lb").alias("log_corr"),
    )
    return out.withColumn("median_dlog", median)


def flat_plane_density(df: DataFrame, center, distance: float, res: int, fov: float = 90.0,
                       kernel: str = "cubic_spline") -> DataFrame:
    """Surface density on the unit-distance plane: positions over -z, h over |z|, m over z².

    An independent way to the same map. Here no disc is smaller than a pixel (h at least
    2·rmax/res), and everything behind the plane gets no weight.
    """
    rmax = fov / 90.0
    x, y, z = (F.col(a) - F.lit(float(c)) for a, c in zip("xyz", center))
    flat = df.select(x.alias("x"), y.alias("y"), (z - distance).alias("z"), "mass", "hsml")
    ahead = F.when(F.col("z") < 0, -F.col("z"))
    flat = flat.select("x", "y", ahead.alias("d"), "mass", "hsml")
    size = 2.0 * rmax / res
    h = F.greatest(F.col("hsml") / F.col("d"), F.lit(size))
    flat = flat.select(
        ((F.col("x") / F.col("d") + rmax) / size - 0.5).alias("cx"),
        ((rmax - F.col("y") / F.col("d")) / size - 0.5).alias("cy"),
        F.when(F.col("d") > 0, h).alias("h"), (F.col("mass") / (F.col("d") * F.col("d"))).alias("m"),
    )
    shape = flat.select("cx", "cy", (F.col("h") / size).alias("rx"), (F.col("h") / size).alias("ry"),
                        (F.col("m") / (F.col("h") * F.col("h"))).alias("a"))
    px = cut_pixels(cut_rows(shape, F.lit(res), F.lit(res)), F.lit(res))
    sigma = F.when(F.col("r2") <= 1.0, F.col("a") * kernel_value(kernel, F.col("r2")))
    return accumulate(px.select("px", "py", sigma.alias("sigma")), with_qty=False)


def step_ratios(log: DataFrame, run: str = "run", frame: str = "frame", value: str = "ms") -> DataFrame:
    """Adds ``step``: log2 of each value over the one before it in its run."""
    rows = neighbour_row(log, [run], frame, [value], step=-1, name="_last")
    before = F.col("_last")[value]
    ratio = F.greatest(F.col(value) / F.greatest(before, F.lit(1.0)), F.lit(1e-9))
    return rows.withColumn("step", F.when(before.isNotNull(), F.log2(ratio))).drop("_last")


def summarize(log: DataFrame, run: str = "run", frame: str = "frame", value: str = "ms") -> DataFrame:
    """Per run: frames, mean, median, population deviation, 5th and 95th percentile, step deviation."""
    v = F.col(value)
    sums = step_ratios(log, run, frame, value).groupBy(run).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.stddev_pop("step").alias("step_std"))
    return sums.join(percentiles(log, [run], value, {"median": 0.5, "p5": 0.05, "p95": 0.95}), run)


def sweep(log: DataFrame, run: str = "run", value: str = "ms") -> DataFrame:
    """Per run: mean, median, total, and speed-up against the first run in name order."""
    v = F.col(value)
    per = log.groupBy(run).agg(F.avg(v).alias("mean"), F.sum(v).alias("total"), F.count(F.lit(1)).alias("frames"))
    per = per.join(percentiles(log, [run], value, {"median": 0.5}), run)
    first = per.agg(F.min_by("mean", run)).scalar()
    return per.withColumn("speedup", first / F.col("mean"))
