"""Connected components by alternating large-star and small-star contraction, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import staged


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: each node ``u`` of the links ``(a, b)`` that is not the least of its component, and that least.

    Nothing but a count and a checksum per round reaches the driver.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    seen = _print(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(moved.union(least).distinct(), "links")
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e


def merged(top: DataFrame, links: DataFrame) -> DataFrame:
    """``top`` of `components` after more ``links``: only the groups they join are contracted again."""
    for c in ("a", "b"):
        at = top.select(F.col("u").alias(c), F.col("v").alias("_v"))
        links = links.join(at, c, "left").withColumn(c, F.coalesce("_v", c)).drop("_v")
    over = components(links)
    if over.isEmpty():
        return top
    at = over.select(F.col("u").alias("v"), F.col("v").alias("_v"))
    return staged(top.join(at, "v", "left").select("u", F.coalesce("_v", "v").alias("v")).union(over), "components")
