"""Column densities kept between calls: a table of results by snapshot and eye position, extended by what is missing.

``store/columns`` holds the results, partitioned by snapshot and batch and bucketed by eye; ``store/commits`` names the batches that
are complete, with the eyes they cover. A call asks which of its eyes are in no commit, computes those in one job, writes
them as a batch named by its content and commits it by one small file at the end. A call that dies leaves a batch nobody
reads; the next one writes it again under the same name. Known eyes never read the gas.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.sightline import columns_at

BUCKETS = 64
COMMIT = "snapshot string, batch string, ex double, ey double, ez double"


def known_eyes(spark: SparkSession, store: str, snapshot: str) -> DataFrame:
    """``ex, ey, ez, batch`` of the committed eyes of a snapshot; one batch (the first by name) for each eye."""
    try:
        commits = spark.read.schema(COMMIT).parquet(f"{store}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        commits = spark.createDataFrame([], COMMIT)
    return commits.where(F.col("snapshot") == snapshot).groupBy("ex", "ey", "ez").agg(F.min("batch").alias("batch"))


def _bucket(eye: Sequence) -> F.Column:
    return F.pmod(F.xxhash64(*eye), F.lit(BUCKETS)).cast("int")


def columns_kept(store: str, snapshot: str, gas: DataFrame, stars: DataFrame, positions: Sequence[Sequence[float]],
                 star_id: str = "sid", **args) -> DataFrame:
    """As `sightline.columns_for_path`: ``cam_id, star_id, column, n_gas`` per frame; only eyes unknown to the store are computed.

    ``snapshot`` names the data (gas and stars): a new name whenever they change. Positions are configuration. The result reads
    the buckets of the asked eyes in the batches that hold them, and neither gas nor stars.
    """
    spark = gas.sparkSession
    frames = [tuple(float(c) + 0.0 for c in p) for p in positions]
    eyes = list(dict.fromkeys(frames))
    asked = spark.createDataFrame(eyes, "ex double, ey double, ez double")
    on = ["ex", "ey", "ez"]
    missing = sorted(tuple(r) for r in asked.join(known_eyes(spark, store, snapshot), on, "left_anti").collect())
    if missing:
        batch = hashlib.sha256(repr(missing).encode()).hexdigest()[:24]
        places = F.lit([c for eye in missing for c in eye])
        eye = {e: F.get(places, F.col("spot") * 3 + i) for i, e in enumerate(on)}
        found = columns_at(gas, stars, missing, star_id=star_id, **args).withColumns(eye).drop("spot")
        found = found.withColumnRenamed(star_id, "star_id").withColumn("bucket", _bucket([F.col(e) for e in on]))
        path = f"{store}/columns/snapshot={snapshot}/batch={batch}"
        found.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        commit = spark.createDataFrame([(snapshot, batch, *eye) for eye in missing], COMMIT)
        commit.coalesce(1).write.mode("append").parquet(f"{store}/commits")
    held = asked.join(F.broadcast(known_eyes(spark, store, snapshot)), on).withColumn("bucket", _bucket([F.col(e) for e in on])).collect()
    kind = stars.schema[star_id].dataType.simpleString()
    table = spark.read.schema(f"star_id {kind}, column double, n_gas long, ex double, ey double, ez double, snapshot string, batch string, bucket int")
    table = table.option("basePath", f"{store}/columns").parquet(*sorted({f"{store}/columns/snapshot={snapshot}/batch={r['batch']}" for r in held}))
    table = table.where(F.col("bucket").isin(sorted({r["bucket"] for r in held})))
    which = spark.createDataFrame([(i, *frame, next(r["batch"] for r in held if (r["ex"], r["ey"], r["ez"]) == frame)) for i, frame in enumerate(frames)],
                                  "cam_id int, ex double, ey double, ez double, batch string")
    return table.join(F.broadcast(which), [*on, "batch"]).select("cam_id", F.col("star_id").alias(star_id), "column", "n_gas")
