"""Random subsets by hashed key, progressive refinement and the rescaling that keeps mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1000
GROWTH = 1.4
FINE = 1 << 16


def order_key(key: str, seed: int = 0) -> Column:
    """Hash of a row key in [0, 1): a fixed random order that does not depend on partitioning."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def fraction(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, with no shuffle."""
    return df.where(order_key(key, seed) < share)


def subset(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Exactly k rows (all, if there are fewer), without sorting the table.

    A histogram of the hash finds the slice that holds the k-th row, one of that slice's own finds the slice
    in it; only this one, about 1/2^32 of the table, is ranked. ``key`` must be unique.
    """
    u = order_key(key, seed)
    rows = df.withColumn("_u", u).withColumn("_slice", F.floor(u * float(FINE * FINE)).cast("long"))
    coarse, before = _slice_of(rows.select(F.shiftright("_slice", 16).alias("s")), F.lit(0), k)
    inside = rows.where(F.shiftright("_slice", 16) == coarse)
    last, before = _slice_of(inside.select(F.col("_slice").alias("s")), before, k)
    rows = rows.withColumn("_last", last)
    whole = rows.where(F.col("_slice") < F.col("_last")).drop("_u", "_slice", "_last")
    edge = rows.where(F.col("_slice") == F.col("_last")).withColumn("_before", before)
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_u", key))
    edge = edge.withColumn("_rank", rank + F.col("_before")).where(F.col("_rank") <= k)
    return whole.unionByName(edge.drop("_u", "_slice", "_last", "_before", "_rank"))


def _slice_of(slices: DataFrame, before: Column, k: int) -> tuple[Column, Column]:
    """The slice that holds the k-th row and the number of rows ahead of it, as scalars; at most FINE slices."""
    hist = slices.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    upto = hist.withColumn("ahead", F.sum("n").over(Window.orderBy("s")) - F.col("n") + before)
    at = upto.where(F.col("ahead") < k).agg(F.max(F.struct("s", "ahead")).alias("x"))
    return at.select("x.s").scalar(), at.select("x.ahead").scalar()


def rescale(mass: Column, hsml: Column, stride: Column | float, user_scale: float = 1.0) -> tuple[Column, Column]:
    """Each kept row stands for ``stride`` rows: mass times stride, length times its cube root."""
    s = F.lit(float(stride)) if isinstance(stride, (int, float)) else stride
    return mass * s, hsml * F.cbrt(s) * user_scale


def refinement_sizes(n: int, start: int = FLOOR) -> list[int]:
    """Row budgets of progressive refinement: from the floor, times 1.4 each step, up to n."""
    size = min(max(int(start), FLOOR), n)
    out = [size]
    while size < n:
        size = min(int(size * GROWTH) + 1, n)
        out.append(size)
    return out


def refinement_levels(df: DataFrame, key: str, sizes: list[int], seed: int = 0) -> DataFrame:
    """One copy of each row per refinement level it belongs to, with ``stride`` = N/K of that level.

    Levels are nested: a row's hash puts it in one level and all later ones. The last level is the
    whole table. All levels leave one pass; their sizes grow by 1.4, so the copies add up to about
    3.5 tables.
    """
    n = sizes[-1]
    # the number of shares up to the hash, by halving: the hash is made once a row, not once a level
    steps = [1 << k for k in reversed(range(len(sizes).bit_length()))]
    shares = F.lit([s / n for s in sizes[:-1]] + [float("inf")] * (2 * steps[0] - len(sizes)))
    out = df.withColumn("_u", order_key(key, seed)).withColumn("_first", F.lit(0))
    for step in steps:
        below = F.col("_u") < F.get(shares, F.col("_first") + (step - 1))
        out = out.withColumn("_first", F.when(below, F.col("_first")).otherwise(F.col("_first") + step))
    levels = F.sequence(F.least(F.col("_first"), F.lit(len(sizes) - 1)), F.lit(len(sizes) - 1))
    out = out.withColumn("level", F.explode(levels)).drop("_u", "_first")
    strides = F.array(*[F.lit(n / s) for s in sizes])
    return out.withColumn("stride", F.get(strides, F.col("level")))
