"""Camera placement from the data: bounding box, weighted medians, clip planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.camera import Camera
from motefield.operators.ordering import numbered, weighted_medians


def bounding_box(df: DataFrame) -> DataFrame:
    """One row: min and max per axis, centre and the length of the diagonal."""
    ends = df.agg(*[f(a).alias(n + a) for n, f in (("min_", F.min), ("max_", F.max)) for a in "xyz"])
    span = [F.col("max_" + a) - F.col("min_" + a) for a in "xyz"]
    mid = [((F.col("min_" + a) + F.col("max_" + a)) / 2).alias("mid_" + a) for a in "xyz"]
    return ends.select("*", *mid, F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2]).alias("extent"))


def every_nth(df: DataFrame, keys: list[str], want: int = 100) -> DataFrame:
    """Every step-th row in key order with step = n//want, so between want and 2·want rows remain."""
    step = F.greatest(F.floor(F.col("n") / want), F.lit(1))
    rows = numbered(df, keys).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    return rows.where(F.col("pos") % F.when(F.col("n") > want, step).otherwise(1) == 0).drop("n", "pos")


def medians(df: DataFrame, weight: str = "mass") -> DataFrame:
    """One row ``x, y, z`` of exact weighted medians over all rows."""
    return weighted_medians(df, ["x", "y", "z"], weight)


def frame(df: DataFrame, weight: str = "mass") -> DataFrame:
    """One row: camera position above the weighted median at the top of the data, speed, clip planes."""
    at = medians(df, weight).select(F.col("x").alias("px"), F.col("y").alias("py"))
    box = bounding_box(df)
    at = at.withColumns({"pz": box.select("max_z").scalar(), "extent": box.select("extent").scalar()})
    return at.select("px", "py", "pz", (F.col("extent") / 20).alias("speed"), (F.col("extent") * 1e-6).alias("near"),
                     (F.col("extent") * 10).alias("far"))


def framed_camera(df: DataFrame, **view) -> Camera:
    """The framing row as a :class:`Camera` (one small action)."""
    row = frame(df).first()
    return Camera((row["px"], row["py"], row["pz"]), near=row["near"], far=row["far"], **view)
