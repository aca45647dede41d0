"""Derived fields that know when they are stale: smoothing lengths kept per part, with a print of the data they came from.

The print of a part is a count and a sum of row hashes: it does not depend on the order of rows, and copies count. When a part
changes, its rows are computed again, and of the other parts those rows whose length depends on it: each length is stored
with its reach, the distance up to which rows took part in it, and a row is asked again if the ball of its reach meets the
bounds of a changed part, as they were or as they are. The solver runs on the rows around the changed parts only. A result counts
if its own reach stays inside what the solver saw; else the region grows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.neighbours import smoothing_lengths, usable_period
from motefield.session import checkpoint

EDGES = [n + a for n in ("lo", "hi") for a in "xyz"]
Box = tuple[tuple[float, ...], tuple[float, ...]]


def row_sum(columns: Sequence[str]) -> Column:
    """Order-free sum of row hashes, an aggregate."""
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string")


def prints(df: DataFrame, key: Sequence[str], part: str) -> DataFrame:
    """``part, n, total`` and the bounds of each part's positions."""
    return df.groupBy(F.col(part).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), row_sum([*key, "x", "y", "z"]).alias("total"),
        *[f(F.col(a).cast("double")).alias(n + a) for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"])


def _stored(spark: SparkSession, path: str) -> dict:
    try:
        return {r["part"]: r for r in spark.read.parquet(path).collect()}  # one row per part
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def _box(r) -> Box | None:
    """Bounds of a part; None if it has no position."""
    return None if r is None or r["lox"] is None else (tuple(r["lo" + a] for a in "xyz"), tuple(r["hi" + a] for a in "xyz"))


def _gap(box: Box, period: float | None) -> Column:
    """Squared distance from ``x, y, z`` to a box, over the nearest image with a period."""
    total = F.lit(0.0)
    for a, lo, hi in zip("xyz", *box):
        gaps = [F.greatest(F.lit(lo) - F.col(a) - s, F.col(a) + s - F.lit(hi), F.lit(0.0)) for s in ([0.0] if period is None else [0.0, period, -period])]
        gap = gaps[0] if len(gaps) == 1 else F.least(*gaps)
        total = total + gap * gap
    return total


def _any(tests: list[Column]) -> Column:
    """Whether one of the tests holds, as a balanced tree."""
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2:]
    return tests[0]


def _wide(box: Box, by: float) -> Box:
    return tuple(v - by for v in box[0]), tuple(v + by for v in box[1])


def _holds(outer: Box, inner: Box) -> bool:
    return all(a <= b for a, b in zip(outer[0], inner[0])) and all(a >= b for a, b in zip(outer[1], inner[1]))


def _around(df: DataFrame, asked: DataFrame, key: Sequence[str], boxes: list[Box], every: list[Box], period: float | None, start: float, box_size) -> DataFrame:
    """Lengths of the asked rows, from the rows within a distance of the boxes that is doubled until all results are proven."""
    by = start
    while True:
        wide = [_wide(b, by) for b in boxes]
        whole = any(all(_holds(w, e) for e in every) for w in wide)
        near = df if whole else df.where(_any([_gap(w, None) <= 0 for w in wide]))
        found = smoothing_lengths(near.select("x", "y", "z"), box_size=box_size if whole else None, reach=True)
        solved = checkpoint(asked.join(found, ["x", "y", "z"], "left"))
        if whole:
            return solved
        inside = [F.lit(True) for _ in wide]
        for i, (low, high) in enumerate(wide):
            if period is not None:  # nothing beyond an edge of the box was seen
                low, high = tuple(max(v, 0.0) for v in low), tuple(min(v, period) for v in high)
            for a, lo, hi in zip("xyz", low, high):
                inside[i] = inside[i] & (F.col(a) - F.col("reach") >= lo) & (F.col(a) + F.col("reach") <= hi)
        placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
        if solved.where(placed & ~F.coalesce(_any(inside), F.lit(False))).isEmpty():
            return solved
        by *= 2


def kept_lengths(df: DataFrame, path: str, key: Sequence[str], part: str = "part", box_size: float | None = None) -> DataFrame:
    """``df`` (``key, part, x, y, z`` and more) with ``hsml``, from the tables at ``path`` as far as these still hold.

    ``key`` tells the rows of a part apart. Prints are compared part by part (one scan); unchanged data reads the table, and changed
    parts are computed with the rows around them. Parts should be compact in space, as `spatial.write_spatial` makes them.
    A row with a null coordinate has a null length. A call that dies is made good by the next one, as the prints are written last.
    """
    spark, lengths = df.sparkSession, f"{path}/lengths"
    now = checkpoint(prints(df, key, part))
    new = {r["part"]: r for r in now.collect()}  # one row per part
    old = _stored(spark, f"{path}/prints")
    changed = [p for p in {*new, *old} if p not in new or p not in old or (new[p]["n"], new[p]["total"]) != (old[p]["n"], old[p]["total"])]
    rows = df.select(*key, F.col(part).alias("part"), *(F.col(a).cast("double").alias(a) for a in "xyz"))
    schema = rows.select(*key, F.lit(0.0).alias("hsml"), F.lit(0.0).alias("reach"), "part").schema
    if changed:
        every = [b for b in map(_box, new.values()) if b]
        period = usable_period(df, box_size)
        if not old or set(changed) >= set(new):
            solved = rows.join(smoothing_lengths(rows.select("x", "y", "z"), box_size=box_size, reach=True), ["x", "y", "z"], "left")
            solved.select(*key, "hsml", "reach", "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(lengths)
        else:
            boxes = [b for p in changed for b in (_box(old.get(p)), _box(new.get(p))) if b]
            stored = spark.read.schema(schema).parquet(lengths)
            calm = [p for p in new if p not in changed]
            meets = _any([_gap(b, period) <= F.col("reach") * F.col("reach") for b in boxes])
            known = rows.where(F.col("part").isin(calm)).join(stored.where(F.col("part").isin(calm)), [*key, "part"])
            known = checkpoint(known.withColumn("ask", F.coalesce(meets, F.lit(False))))
            border = known.where("ask").select(*rows.columns, "reach")
            reach = border.agg(F.max("reach")).first()[0]
            side = max(max(h - lo for lo, h in zip(*b)) for b in every) if every else 1.0
            start = 2 * reach if reach and math.isfinite(reach) else side / 8 or 1.0
            asked = rows.where(F.col("part").isin(changed)).unionByName(border.drop("reach"))
            solved = _around(rows, asked, key, boxes, every, period, start, box_size) if boxes else asked.withColumns({"hsml": F.lit(None).cast("double"), "reach": F.lit(None).cast("double")})
            touched = [r["part"] for r in solved.select("part").distinct().collect()]
            rest = known.where(~F.col("ask") & F.col("part").isin(touched))
            both = checkpoint(solved.select(schema.names).unionByName(rest.select(schema.names)))
            both.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(lengths)
        now.coalesce(1).write.mode("overwrite").parquet(f"{path}/prints")
    stored = spark.read.schema(schema).parquet(lengths).where(F.col("part").isin(list(new))).select(*key, F.col("part").alias(part), "hsml")
    return df.drop("hsml").join(stored, [*key, part])
