"""Colormaps, linear table lookup and the HSV composite, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control points (position, level) per channel of the piecewise-linear maps.
RAMPS = {
    "gray": {c: [(0.0, 0.0), (1.0, 1.0)] for c in "rgb"},
    "hot": {
        "r": [(0.0, 0.0416), (0.365079, 1.0), (1.0, 1.0)],
        "g": [(0.0, 0.0), (0.365079, 0.0), (0.746032, 1.0), (1.0, 1.0)],
        "b": [(0.0, 0.0), (0.746032, 0.0), (1.0, 1.0)],
    },
    "bone": {
        "r": [(0.0, 0.0), (0.746032, 0.652778), (1.0, 1.0)],
        "g": [(0.0, 0.0), (0.365079, 0.319444), (0.746032, 0.777778), (1.0, 1.0)],
        "b": [(0.0, 0.0), (0.365079, 0.444444), (1.0, 1.0)],
    },
}
NAMED = ["magma", "inferno", "viridis", "plasma", "coolwarm", "hot", "bone", "cividis"]
SIZE = 256


def _ramp(points, x: float) -> float:
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x <= x1:
            return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return points[-1][1]


def levels(name: str | DataFrame) -> dict[str, list[int]]:
    """The 256 8-bit levels per channel: of a ramp here, of a table ``idx, r, g, b`` of 256 rows, or of one of
    matplotlib's maps where that is installed."""
    if isinstance(name, DataFrame):
        rows = name.select("idx", "r", "g", "b").orderBy("idx").take(SIZE + 1)
        if [r["idx"] for r in rows] != list(range(SIZE)):
            raise ValueError(f"a colormap table has one row for each idx from 0 to {SIZE - 1}")
        return {c: [int(r[c]) for r in rows] for c in "rgb"}
    if name in RAMPS:
        return {c: [int(_ramp(RAMPS[name][c], i / (SIZE - 1)) * 255) for i in range(SIZE)] for c in "rgb"}
    try:
        from matplotlib import colormaps
    except ImportError as err:
        raise ValueError(f"colormap {name}: give its table, or install matplotlib; without either there are {sorted(RAMPS)}") from err
    table = colormaps[name].resampled(SIZE)
    return {c: [int(table(i)[k] * 255) for i in range(SIZE)] for k, c in enumerate("rgb")}


def lut(spark, name: str) -> DataFrame:
    """The map as a table ``name, idx, r, g, b``."""
    table = levels(name)
    rows = [(name, i, *(table[c][i] for c in "rgb")) for i in range(SIZE)]
    return spark.createDataFrame(rows, "name string, idx int, r int, g int, b int")


def lookup(df: DataFrame, t: str, name: str | DataFrame) -> DataFrame:
    """Adds ``r, g, b`` (0..1) for the coordinate column ``t``: linear between entries, clamped ends.

    The table has a fixed 256 entries, so it travels as an array literal, not as a join.
    """
    u = F.greatest(F.lit(0.0), F.least(F.lit(float(SIZE - 1)), F.col(t) * float(SIZE) - 0.5))
    df = df.withColumn("_u", F.when(F.col(t).isNotNull(), u)).withColumn("_k", F.floor("_u").cast("int"))
    table = levels(name)
    out = {}
    for c in "rgb":
        arr = F.lit([float(v) for v in table[c]])
        lo = F.get(arr, F.col("_k"))
        hi = F.get(arr, F.least(F.col("_k") + 1, F.lit(SIZE - 1)))
        out[c] = (lo + (hi - lo) * (F.col("_u") - F.col("_k"))) / 255.0
    return df.withColumns(out).drop("_u", "_k")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    sector = (
        F.when(top == r, (g - b) / delta).when(top == g, (b - r) / delta + 2.0).otherwise((r - g) / delta + 4.0) / 6.0
    )
    hue = F.when(delta > 0, F.when(sector < 0, sector + 1.0).otherwise(sector)).otherwise(0.0)
    return hue, F.when(top > 0, delta / top).otherwise(0.0), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    i = F.floor(h * 6.0)
    f = h * 6.0 - i
    p, q, t = v * (1.0 - s), v * (1.0 - s * f), v * (1.0 - s * (1.0 - f))
    k = F.pmod(i, F.lit(6))

    def pick(*by_sector):
        out = F.when(k == 0, by_sector[0])
        for n, c in enumerate(by_sector[1:], 1):
            out = out.when(k == n, c)
        return out

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def composite_rgb(df: DataFrame, light: str) -> DataFrame:
    """Scales the HSV value of ``r, g, b`` by the lightness column."""
    h, s, v = rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    df = df.withColumns({"_h": h, "_s": s, "_v": v * F.col(light)}).drop("r", "g", "b")
    r, g, b = hsv_to_rgb(F.col("_h"), F.col("_s"), F.col("_v"))
    return df.withColumns({"r": r, "g": g, "b": b}).drop("_h", "_s", "_v")
