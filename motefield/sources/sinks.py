"""Writers for accumulators and images, and the reader that takes an accumulator up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_accumulator(accum: DataFrame, path: str) -> None:
    """Sparse accumulator as Parquet; resolve, range and colour can start from it later."""
    accum.write.mode("overwrite").parquet(path)


def read_accumulator(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_image(image: DataFrame, path: str) -> None:
    """Image rows as Parquet, one folder per camera where there are several."""
    writer = image.write.mode("overwrite")
    if "cam_id" in image.columns:
        writer = writer.partitionBy("cam_id")
    writer.parquet(path)
