"""Value ranges for display: maximum-entropy limits, order statistics and the rules applied after."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.ordering import interpolate_at, pick_ranks, value_cdf
from motefield.operators.resolve import resolved
from motefield.session import checkpoint

BINS = 128
SEARCH = 32


def cdf_knots(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Normalised running weight per distinct value: ``x, yl, yr`` (at the first and the last copy)."""
    cdf = value_cdf(df, value, weight)
    total = df.agg(F.sum(weight)).scalar()
    return cdf.select(
        F.col("v").alias("x"),
        ((F.col("before") + F.col("w_first")) / total).alias("yl"),
        ((F.col("before") + F.col("w")) / total).alias("yr"),
    )


def quantile_values(knots: DataFrame, fractions: list[float]) -> DataFrame:
    """``slot, x, y``: the value at each weight fraction, the running-weight curve read the other way round."""
    ends = F.explode(F.array("yl", "yr"))
    return interpolate_at(knots.select(ends.alias("x"), F.col("x").alias("yl"), F.col("x").alias("yr")), fractions)


def candidates(n: int) -> list[float]:
    """Weight fractions tried for the limits: n from 0 to 0.45 (low), then n from 0.55 to 1 (high)."""
    steps = [i * 0.45 / (n - 1) for i in range(n)]
    return steps + [min(0.55 + s, 1.0) for s in steps]


def gap_ends(knots: DataFrame, edges: np.ndarray) -> pd.DataFrame:
    """Last and first knot of each gap between the sorted ``edges``: at most one row per edge and one more.

    Each task keeps one pair of knots per gap in arrays; they meet in one hash aggregate. No sort.
    """
    shared = knots.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        e = shared.value
        n = len(e) + 1
        lo, lo_y, hi, hi_y = np.full(n, -np.inf), np.zeros(n), np.full(n, np.inf), np.zeros(n)
        for pdf in batches:
            pdf = pdf.sort_values("x")
            x, yl, yr = (pdf[c].to_numpy() for c in ("x", "yl", "yr"))
            gap = np.searchsorted(e, x, "left")
            last = np.flatnonzero(np.append(gap[1:] != gap[:-1], True)) if len(x) else []
            first = np.flatnonzero(np.append(True, gap[1:] != gap[:-1])) if len(x) else []
            for k, here, there, y, ys, better in ((last, lo, x, lo_y, yr, np.greater), (first, hi, x, hi_y, yl, np.less)):
                k = k[better(there[k], here[gap[k]])] if len(x) else k
                if len(k):
                    here[gap[k]], y[gap[k]] = there[k], ys[k]
        full = np.flatnonzero(np.isfinite(lo))
        yield pd.DataFrame({"gap": full, "lo": lo[full], "yr": lo_y[full], "hi": hi[full], "yl": hi_y[full]})

    rows = knots.select("x", "yl", "yr").mapInPandas(run, "gap long, lo double, yr double, hi double, yl double")
    ends = rows.groupBy("gap").agg(F.max(F.struct("lo", "yr")).alias("a"), F.min(F.struct("hi", "yl")).alias("b"))
    return ends.select("gap", "a.lo", "a.yr", "b.hi", "b.yl").toPandas()


def curve_at(knots: DataFrame, x: np.ndarray) -> np.ndarray:
    """Piecewise-linear lookup at a number of positions that the caller's parameters fix; clamped at the ends."""
    edges, back = np.unique(x, return_inverse=True)
    ends = gap_ends(knots, edges)
    n = len(edges)
    lo, yr, hi, yl = (np.full(n + 1, np.nan) for _ in range(4))
    for column, name in ((lo, "lo"), (yr, "yr"), (hi, "hi"), (yl, "yl")):
        column[ends["gap"]] = ends[name]
    before = pd.DataFrame({"lo": lo, "yr": yr}).ffill().to_numpy()[:n]  # last knot in this gap or an earlier one
    after = pd.DataFrame({"hi": hi, "yl": yl}).bfill().to_numpy()[1:]  # first knot of a later gap
    (lo, yr), (hi, yl) = before.T, after.T
    with np.errstate(invalid="ignore"):
        y = yr + (edges - lo) * ((yl - yr) / (hi - lo))
    return np.where(np.isnan(lo), yl, np.where(np.isnan(hi), yr, y))[back.reshape(x.shape)]


def entropy_table(knots: DataFrame, n_bins: int = BINS, n_search: int = SEARCH) -> DataFrame:
    """Entropy of the n_bins histogram for every pair of limits: ``i, j, lo, hi, entropy``.

    The bin edges (n_search² (n_bins + 1), whatever the data) go to the tasks; one row per gap comes back.
    """
    limits = quantile_values(knots, candidates(n_search)).toPandas().sort_values("slot")["y"].to_numpy()  # 2 n_search rows
    lo, hi = limits[:n_search, None, None], limits[None, n_search:, None]
    t = np.arange(n_bins + 1)
    x = lo + t / float(n_bins) * (hi - lo)
    y = curve_at(knots, x)
    p = y[..., 1:] - y[..., :-1]
    p[..., 0] += y[..., 0]
    p[..., -1] += 1.0 - y[..., -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(p > 0, -p * np.log2(p), 0.0).sum(-1)
    i, j = np.indices(entropy.shape)
    lo, hi = np.broadcast_to(lo[..., 0], entropy.shape), np.broadcast_to(hi[..., 0], entropy.shape)
    table = pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "lo": lo.ravel(), "hi": hi.ravel(), "entropy": entropy.ravel()})
    return knots.sparkSession.createDataFrame(table, "i int, j int, lo double, hi double, entropy double")


def max_entropy_limits(df: DataFrame, value: str, weight: str, log: bool = False,
                       n_bins: int = BINS, n_search: int = SEARCH) -> DataFrame:
    """One row ``lo, hi`` (linear units) whose histogram has the most weighted entropy.

    Runs on all rows. On a log axis values of 0 or less are left out; if none are left, or there is
    no weight, the limits are the smallest and largest value. Ties go to the first pair in row order.
    """
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(weight).alias("w"),
                   F.max(F.col(value)).alias("top"))
    if log:
        shown = df.where(F.col(value) > 0)
        stats = df.agg(F.min(value).alias("lo0"), F.max(value).alias("hi0"),
                       F.min(F.when(F.col(value) > 0, F.col(value))).alias("lo1"),
                       F.max(F.when(F.col(value) > 0, F.col(value))).alias("hi1"),
                       F.sum(F.when(F.col(value) > 0, F.col(weight))).alias("w"))
        stats = stats.select(F.coalesce("lo1", "lo0", F.lit(0.0)).alias("lo"), F.coalesce("hi1", "hi0", F.lit(1.0)).alias("hi"), "w")
        df, value = shown.select(F.log10(value).alias("_v"), F.col(weight).alias("_w")), "_v"
        weight = "_w"
    first = stats.first()
    if first is None or not first["w"] or first["w"] <= 0:
        return stats.select("lo", "hi")
    knots = checkpoint(cdf_knots(df, value, weight))
    table = entropy_table(knots, n_bins, n_search)
    best = table.orderBy((F.col("hi") > F.col("lo")).desc(), F.round("entropy", 9).desc(), "i", "j").limit(1)
    out = (F.pow(F.lit(10.0), F.col(c)).alias(c) if log else F.col(c) for c in ("lo", "hi"))
    return best.select(*out)


def order_statistic_limits(df: DataFrame, value: str) -> DataFrame:
    """One row ``lo, hi``: the values at ranks n//100 and min(99n//100, n-1)."""
    n = F.col("n")
    low, high = F.floor(n / 100), F.least(F.floor(n * 99 / 100), n - 1)
    return pick_ranks(df, value, {"lo": low, "hi": high})


def finish_range(limits: DataFrame, log: bool, smallest_positive=None) -> DataFrame:
    """Display range from limits: log10 with a floor and at least 0.1 dex, else at least 1e-30 wide."""
    if log:
        floor = F.coalesce(F.lit(smallest_positive), F.lit(1e-10))
        lo = F.log10(F.greatest(F.when(F.col("lo") <= 0, floor).otherwise(F.col("lo")), F.lit(1e-30)))
        hi = F.log10(F.greatest(F.col("hi"), F.lit(1e-30)))
        width = 0.1
    else:
        lo, hi, width = F.col("lo"), F.col("hi"), 1e-30
    out = limits.select(lo.alias("lo"), hi.alias("hi"))
    mid, thin = (F.col("lo") + F.col("hi")) / 2, F.col("hi") - F.col("lo") < width
    return out.select(F.when(thin, mid - 1).otherwise(F.col("lo")).alias("lo"),
                      F.when(thin, mid + 1).otherwise(F.col("hi")).alias("hi"), F.lit(log).alias("log"))


def auto_range(accum: DataFrame, mode: int, log: bool = True, mass_weighted: bool = True,
               default=(-1.0, 3.0)) -> DataFrame:
    """One row ``lo, hi, log`` for a map.

    Negative values switch the log axis off and take order statistics. ``mass_weighted`` weights the
    entropy by accumulated mass (lightness); without it every pixel counts the same (colour).
    """
    pixels = checkpoint(resolved(accum, mode).select("value", "weight"))
    v = F.col("value")
    stats = pixels.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.min(F.when(v > 0, v)).alias("pos")).first()
    if stats["n"] == 0:
        one = accum.sparkSession.range(1)
        return one.select(F.lit(default[0]).alias("lo"), F.lit(default[1]).alias("hi"), F.lit(log).alias("log"))
    if stats["low"] < 0:
        return finish_range(order_statistic_limits(pixels, "value"), False)
    if not mass_weighted:
        pixels = pixels.withColumn("weight", F.lit(1.0))
    return finish_range(max_entropy_limits(pixels, "value", "weight", log), log, stats["pos"])


def scaled_range(df: DataFrame, factor: float) -> DataFrame:
    """Range contracted (0.8) or expanded (1.25) about its midpoint."""
    mid, half = (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) / 2 * factor
    keys = [c for c in df.columns if c not in ("lo", "hi")]
    return df.select(*keys, (mid - half).alias("lo"), (mid + half).alias("hi"))


def marker_range(df: DataFrame, value: str, log: bool) -> DataFrame:
    """One row ``lo, hi``: extremes of the finite (on a log axis: positive) values, at least 1e-6 wide."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    kept = df.where(ok & (v > 0) if log else ok)
    ends = kept.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    if log:
        ends = ends.select(F.log10("lo").alias("lo"), F.log10("hi").alias("hi"))
    return ends.select("lo", F.when(F.col("hi") - F.col("lo") < 1e-6, F.col("lo") + 1.0).otherwise(F.col("hi")).alias("hi"))
