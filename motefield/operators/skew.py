"""Equi-joins that stay balanced when a few keys hold much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 256


def default_parts(df: DataFrame) -> int:
    """At least 256, and no fewer than the session's shuffle partitions."""
    return max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Keys with more than 1/parts of all rows, and the number of salts that splits each evenly.

    At most ``parts`` keys can pass the test, whatever the data: this is the proven bound that lets
    the table be broadcast.
    """
    parts = parts or default_parts(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("_n") * parts > total).select(
        *keys, F.ceil(F.col("_n") * parts / total).cast("int").alias("_salts")
    )


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                parts: int | None = None, salt_small: Sequence[str] | None = None) -> DataFrame:
    """Inner equi-join; rows of ``big`` under a hot key are split, the matching ``small`` rows copied.

    ``salt_by`` must tell rows apart even if they are copies of each other. The salt is a hash of it,
    so a task that is run again sends every row where it went before. With ``salt_small`` keys that are hot
    in ``small`` are split too, and the rows of ``big`` under them copied.
    """
    hot = _hot(big, keys, parts)
    left, right, on = _dealt(big, hot, keys, salt_by, "_salt"), _copied(small, hot, keys, "_salt"), [*keys, "_salt"]
    if salt_small is not None:
        hot = _hot(small, keys, parts)
        right = _dealt(right, hot, keys, salt_small, "_salt2")
        left, on = _copied(left, hot, keys, "_salt2"), [*on, "_salt2"]
    return left.join(right, on).drop("_salt", "_salt2")


def _hot(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    return F.broadcast(hot_keys(df, keys, parts))


def _dealt(df: DataFrame, hot: DataFrame, keys: Sequence[str], salt_by: Sequence[str], name: str) -> DataFrame:
    salt = F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("_salts")).cast("int"), F.lit(0))
    return df.join(hot, list(keys), "left").withColumn(name, salt).drop("_salts")


def _copied(df: DataFrame, hot: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return df.join(hot, list(keys), "left").withColumn(name, F.explode(copies)).drop("_salts")
