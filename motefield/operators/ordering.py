"""Running sums, ranks and interpolation over a whole sorted table, without a one-task sort.

The table is cut into value ranges (approximate quantiles, computed as a scalar subquery of the same
plan). Each range sorts on its own; one row per range carries the offset from the ranges before it.
Rows that share a value are merged before the sort, so a value that a third of all rows hold is one
row there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def default_buckets(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions: each range is sorted by one task."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounds_of(df: DataFrame, key: str, buckets: int | None = None) -> Column:
    """Approximate quantiles of ``key`` as a scalar subquery: sorted range bounds."""
    n = buckets or default_buckets(df)
    at = [i / n for i in range(1, n)]
    return df.agg(F.percentile_approx(key, at, 10 * n)).scalar()


def in_bucket(df: DataFrame, key: str, bounds: Column, buckets: int | None = None, name: str = "_b") -> DataFrame:
    """Adds the number of bounds below ``key`` by halving: one compiled comparison per power of two, and no loop over the
    bounds (a lambda is interpreted, which took most of the time of wide tables)."""
    n = buckets or default_buckets(df)
    df = df.withColumn("_bounds", bounds).withColumn(name, F.lit(0))
    for step in (1 << k for k in reversed(range(n.bit_length()))):
        # beyond the last bound `get` is null: no step
        ahead = F.get("_bounds", F.col(name) + (step - 1)) < F.col(key)
        df = df.withColumn(name, F.when(ahead, F.col(name) + step).otherwise(F.col(name)))
    return df.drop("_bounds")


def _offsets(df: DataFrame, amount: str) -> DataFrame:
    """Sum of ``amount`` in all earlier buckets; one row per bucket, so one small task and a broadcast."""
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_b").agg(F.sum(amount).alias("_t"))
    zero = F.lit(0).cast(totals.schema["_t"].dataType)
    return F.broadcast(totals.select("_b", F.coalesce(F.sum("_t").over(before), zero).alias("_off")))


def running(df: DataFrame, key: str, amount: str, buckets: int | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over rows with a smaller ``key``. Keys must be unique."""
    cut = in_bucket(df, key, bounds_of(df, key, buckets), buckets)
    here = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(here), F.lit(0).cast(df.schema[amount].dataType))
    return cut.join(_offsets(cut, amount), "_b").withColumn("before", F.col("_off") + own).drop("_b", "_off")


def numbered(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Adds ``pos``: 0-based position of each row in the order of ``keys`` over the whole table.

    Ranges are cut on the first key; the rest break its ties, so the first key should be nearly unique.
    """
    first = keys[0]
    cut = in_bucket(df, first, bounds_of(df, first, buckets), buckets).withColumn("_one", F.lit(1).cast("long"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)).cast("long")
    return cut.withColumn("pos", rn - 1).join(_offsets(cut, "_one"), "_b").withColumn(
        "pos", F.col("pos") + F.col("_off")
    ).drop("_b", "_off", "_one")


def value_cdf(df: DataFrame, value: str, weight: str, buckets: int | None = None) -> DataFrame:
    """Running weight per distinct value: ``v, w_first, w, n, before``.

    ``before`` is the weight below the value; within equal values the lightest row comes first.
    """
    merged = df.groupBy(F.col(value).alias("v")).agg(
        F.sum(weight).alias("w"), F.min(weight).alias("w_first"), F.count(F.lit(1)).alias("n")
    )
    return running(merged, "v", "w", buckets)


def pick_ranks(df: DataFrame, value: str, ranks: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """One row with the values at 0-based ranks; each rank is a Column of ``n``, the row count."""
    merged = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(merged, "v", "c", buckets).withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    hit = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
    return ranked.agg(*[F.max(F.when(hit(k), F.col("v"))).alias(name) for name, k in ranks.items()])


def neighbour_row(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], step: int = 1,
                  name: str = "next", buckets: int | None = None) -> DataFrame:
    """Adds a struct of the following (step 1) or preceding (step -1) row's columns in each group.

    Groups are cut into ranges of ``order``, so a group that holds a third of all rows is sorted by
    many tasks; the row across a range's edge comes from a table with one row per group and range.
    ``order`` is numeric and unique in a group.
    """
    n = buckets or default_buckets(df)
    cut = in_bucket(df, order, bounds_of(df, order, n), n)
    row = F.struct(*columns)
    shift = F.lead if step > 0 else F.lag
    near = cut.withColumn("_near", shift(row).over(Window.partitionBy(*by, "_b").orderBy(order)))
    pick = F.min_by if step > 0 else F.max_by
    edges = cut.groupBy(*by, "_b").agg(pick(row, order).alias("_edge"))
    edges = edges.withColumn("_edge", shift("_edge").over(Window.partitionBy(*by).orderBy("_b")))
    out = near.join(edges, [*by, "_b"])
    return out.withColumn(name, F.coalesce("_near", "_edge")).drop("_near", "_edge", "_b")


def percentiles(df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float],
                buckets: int | None = None) -> DataFrame:
    """Exact interpolated percentiles per group: ``by`` columns and one column per fraction.

    Value ranges are counted per group; only the ranges that hold a wanted rank are read again, with
    equal values merged, so no group's values are gathered in one place.
    """
    n = buckets or default_buckets(df)
    cut = in_bucket(df.where(F.col(value).isNotNull()), value, bounds_of(df, value, n), n)
    counts = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    counts = counts.withColumns({"_before": F.sum("_n").over(group.orderBy("_b")) - F.col("_n"), "_all": F.sum("_n").over(group)})
    ranks = []
    for f in sorted(set(fractions.values())):
        at = F.lit(f) * (F.col("_all") - 1)
        ranks += [F.floor(at), F.ceil(at)]
    held = F.filter(F.array(*ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    wanted = counts.withColumn("_ranks", F.array_distinct(held)).where(F.size("_ranks") > 0).drop("_n")
    merged = cut.join(wanted, [*by, "_b"]).groupBy(*by, "_b", F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"), F.first("_ranks").alias("_ranks"))
    first = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v")) - F.col("_n")
    merged = merged.withColumn("_first", first)
    hit = merged.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_n")))))
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("_v")))
    outs = []
    for name, f in fractions.items():
        pos = F.lit(f) * (F.col("_all") - 1)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        outs.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    return hit.groupBy(*by).agg(*outs)


def weighted_medians(df: DataFrame, columns: Sequence[str], weight: str, buckets: int | None = None) -> DataFrame:
    """One row with each column's first value at which the running weight reaches half the total.

    Exact in three scans without sorting the table: approximate quantiles cut the values into ranges,
    the weight per range finds the range of the median, and only that range's values are ordered.
    """
    n = buckets or default_buckets(df)
    at = [i / n for i in range(1, n)]
    bounds = df.agg(F.array(*[F.percentile_approx(F.col(c).cast("double"), at, 10 * n) for c in columns])).scalar()
    entries = [F.struct(F.lit(i).alias("axis"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    rows = df.select(F.col(weight).alias("w"), F.explode(F.array(*entries)).alias("e")).select("w", "e.axis", "e.v")
    cut = in_bucket(rows, "v", F.get(bounds, F.col("axis")), n)
    per = Window.partitionBy("axis")
    sums = cut.groupBy("axis", "_b").agg(F.sum("w").alias("t"))  # at most one row per range and column
    marks = sums.select("axis", "_b", (F.sum("t").over(per.orderBy("_b")) - F.col("t")).alias("below"), "t",
                        (F.sum("t").over(per) * 0.5).alias("half"))
    marks = marks.where((F.col("below") < F.col("half")) & (F.col("below") + F.col("t") >= F.col("half"))).drop("t")
    inside = cut.join(F.broadcast(marks), ["axis", "_b"]).groupBy("axis", "v").agg(
        F.sum("w").alias("w"), F.first("below").alias("below"), F.first("half").alias("half"))
    upto = F.col("below") + F.sum("w").over(per.orderBy("v"))
    found = inside.withColumn("upto", upto).groupBy("axis").agg(
        F.coalesce(F.min(F.when(F.col("upto") >= F.col("half"), F.col("v"))), F.max("v")).alias("v"))
    return found.agg(*[F.max(F.when(F.col("axis") == i, F.col("v"))).alias(c) for i, c in enumerate(columns)])


def interpolate_at(knots: DataFrame, xs: Sequence[float]) -> DataFrame:
    """Lookup at a few ascending positions: ``slot, x, y``. One scan and one hash aggregate, no sort.

    Knots are as for :func:`interpolate`, but one ``x`` may come several times.
    """
    points = F.lit([float(x) for x in xs])
    cut = in_bucket(knots, "x", points, len(xs) + 1, "_g")
    ends = cut.groupBy("_g").agg(F.max(F.struct("x", "yr")).alias("lo"), F.min(F.struct("x", "yl")).alias("hi"))
    row = ends.agg(F.collect_list(F.struct("_g", "lo", "hi")).alias("all"))  # at most one entry per position
    at = row.select("all", F.posexplode(points).alias("slot", "x"))
    lo = F.array_max(F.transform(F.filter("all", lambda e: e["_g"] <= F.col("slot")), lambda e: e["lo"]))
    hi = F.array_min(F.transform(F.filter("all", lambda e: e["_g"] > F.col("slot")), lambda e: e["hi"]))
    at = at.select("slot", "x", lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    y = lo["yr"] + (F.col("x") - lo["x"]) * ((hi["yl"] - lo["yr"]) / (hi["x"] - lo["x"]))
    return at.select("slot", "x", F.when(lo.isNull(), hi["yl"]).when(hi.isNull(), lo["yr"]).otherwise(y).alias("y"))


def interpolate(knots: DataFrame, probes: DataFrame, x: str = "x", buckets: int | None = None) -> DataFrame:
    """Piecewise-linear lookup of every probe, clamped at the ends; adds ``y``.

    ``knots`` has distinct ``x`` with ``yl``, the value reached from the left, and ``yr``, the value
    left to the right (they differ where the curve jumps). The as-of match is two windows per range
    plus one carried row per range for neighbours that lie in another range.
    """
    bounds = bounds_of(knots, "x", buckets)
    others = [c for c in probes.columns if c != x]
    k = knots.select(F.col("x").alias("_x"), F.struct("x", "yr").alias("_lo"), F.struct("x", "yl").alias("_hi"),
                     F.lit(0).alias("_probe"))
    p = probes.select(F.col(x).alias("_x"), F.lit(1).alias("_probe"), *others)
    rows = in_bucket(k.unionByName(p, allowMissingColumns=True), "_x", bounds, buckets)

    # both neighbours with running frames: a frame that ends at the range's end is quadratic in Spark
    so_far = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("_b").orderBy("_x", "_probe").rowsBetween(*so_far)
    ahead = Window.partitionBy("_b").orderBy(F.col("_x").desc(), F.col("_probe").desc()).rowsBetween(*so_far)
    near = rows.withColumns({"_lo": F.last("_lo", True).over(back), "_hi": F.last("_hi", True).over(ahead)})

    per = rows.groupBy("_b").agg(F.max("_lo").alias("_lo_b"), F.min("_hi").alias("_hi_b"))
    order = Window.orderBy("_b")
    per = per.select(
        "_b",
        F.last("_lo_b", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo_b"),
        F.first("_hi_b", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_hi_b"),
    )
    near = near.where("_probe = 1").join(F.broadcast(per), "_b")
    lo, hi = F.coalesce("_lo", "_lo_b"), F.coalesce("_hi", "_hi_b")
    near = near.withColumns({"_lo": lo, "_hi": hi})
    lo, hi = F.col("_lo"), F.col("_hi")
    slope = (hi["yl"] - lo["yr"]) / (hi["x"] - lo["x"])
    y = F.when(lo.isNull(), hi["yl"]).when(hi.isNull(), lo["yr"]).otherwise(lo["yr"] + (F.col("_x") - lo["x"]) * slope)
    return near.select(F.col("_x").alias(x), *others, y.alias("y"))
