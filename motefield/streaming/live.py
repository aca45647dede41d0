"""Maps that update as particles arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.camera import Camera, literal
from motefield.operators.splat import accumulate, contributions


def live_map(stream: DataFrame, cam: Camera, mass: str = "mass", hsml: str = "hsml", qty: str | None = None,
             kernel: str = "cubic_spline") -> DataFrame:
    """Running accumulator of a particle stream: the batch splat on a streaming table.

    The state is one row of sums per touched pixel, so it is bounded by the screen. Write it with
    output mode ``update`` or ``complete``.
    """
    q = None if qty is None else F.col(qty)
    hits = contributions(stream, literal(cam), F.col(mass), F.col(hsml), q, kernel)
    return accumulate(hits, with_qty=qty is not None)


def windowed_map(stream: DataFrame, cam: Camera, time: str, width: str, late: str, mass: str = "mass",
                 hsml: str = "hsml", qty: str | None = None, kernel: str = "cubic_spline") -> DataFrame:
    """One accumulator per event-time window. Write it with `run_windows`: a window is given out once, when the
    watermark passes its end, and rows that come later than ``late`` are dropped."""
    q = None if qty is None else F.col(qty)
    marked = stream.withWatermark(time, late)
    hits = contributions(marked, literal(cam), F.col(mass), F.col(hsml), q, kernel, keep=[time])
    window: Column = F.window(time, width)
    aggs = [F.sum("sigma" if qty is None else F.when(F.col("q").isNotNull(), F.col("sigma"))).alias("den")]
    if qty is not None:
        sq = F.col("sigma") * F.col("q")
        aggs = [F.sum(sq).alias("num"), *aggs, F.sum(sq * F.col("q")).alias("sq")]
    out = hits.groupBy(window.alias("w"), "px", "py").agg(*aggs).where(F.col("den").isNotNull())
    sums = [c for c in ("num", "den", "sq") if c in out.columns]
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "px", "py", *sums)


def run_to_table(stream_map: DataFrame, path: str) -> DataFrame:
    """Processes what is there now; each batch replaces the table at ``path`` with the whole map.

    The map is written by the executors; the driver holds none of it.
    """
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/map")

    writer = stream_map.writeStream.outputMode("complete").foreachBatch(replace).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/state").start().awaitTermination()
    return stream_map.sparkSession.read.parquet(f"{path}/map")


VERSIONS = "tile int, batch long"


def _versions(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    """Committed (tile, batch) pairs."""
    try:
        return {(r["tile"], r["batch"]) for r in spark.read.schema(VERSIONS).parquet(f"{path}/versions").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def _newest(versions: set[tuple[int, int]], before: float = float("inf")) -> dict[int, int]:
    """The newest batch of each tile, of those before a batch."""
    return {t: b for t, b in sorted(versions, key=lambda v: v[1]) if b < before}


def _tiles(spark: SparkSession, path: str, schema, versions: dict[int, int]) -> DataFrame:
    """Pixels of the given versions of tiles."""
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/map/batch={b}/tile={t}" for t, b in sorted(versions.items())))


def run_updates(stream_map: DataFrame, path: str, height: int, tiles: int = 16) -> DataFrame:
    """Processes what is there now by changes: a batch gives out the pixels it touched, and only the tiles that hold them are
    written anew. Returns the map; a later call with the same path goes on from there.

    A tile is a range of pixel rows of a screen ``height`` rows high. Each batch writes the new state of its tiles to a folder with
    the batch's number, made of their newest state from *earlier* batches and the changed pixels, and then names them in
    ``versions``. A batch that is run again therefore writes the same files again, whether it died before or after that.
    """
    spark, schema = stream_map.sparkSession, stream_map.schema
    known = _versions(spark, path)

    def upsert(batch: DataFrame, number: int) -> None:
        here = batch.withColumn("tile", F.expr(f"cast(py * {tiles} div {height} as int)")).persist()
        try:
            touched = sorted(r["tile"] for r in here.select("tile").distinct().collect())  # at most ``tiles``
            if not touched:
                return
            old = {t: b for t, b in _newest(known, number).items() if t in touched}
            rest = _tiles(spark, path, schema, old).withColumn("tile", F.expr(f"cast(py * {tiles} div {height} as int)"))
            state = rest.join(here.select("px", "py"), ["px", "py"], "left_anti").unionByName(here)
            state.repartition("tile").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/map/batch={number}")
            spark.createDataFrame([(t, number) for t in touched], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
            known.update((t, number) for t in touched)
        finally:
            here.unpersist()

    writer = stream_map.writeStream.outputMode("update").foreachBatch(upsert).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/state").start().awaitTermination()
    return _tiles(spark, path, schema, _newest(_versions(spark, path)))


def run_windows(stream_map: DataFrame, path: str) -> DataFrame:
    """Processes what is there now and appends the windows that have closed to the table at ``path``.

    Closed windows leave the state, so it holds the open ones only; a later call with the same path goes on
    from there. Windows that no row has closed yet are not in the table.
    """
    writer = stream_map.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/state").option("path", f"{path}/map").start().awaitTermination()
    return stream_map.sparkSession.read.schema(stream_map.schema).parquet(f"{path}/map")
