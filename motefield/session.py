"""Session helpers: local session for tests and bench, partition spreading, lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str = "motefield", cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and bench. On a cluster, pass in the session you have."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config(SHUFFLE_PARTITIONS, str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    A big snapshot already scans as thousands of splits and is returned unchanged, so no shuffle is
    added there; a single-row-group file would otherwise run its whole map stage in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder named by ``spark.checkpoint.dir``, else below the
    warehouse. Spark removes it once nothing refers to it (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor can reach, for tables a job writes and reads again."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()
