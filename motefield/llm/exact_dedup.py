"""Exact dedup against a persistent digest index, bucketed and sorted by digest. DataFrame code only.

The index is a bucketed Parquet table, one row per text seen: ``digest, keep_id``. A batch is reduced to
one row per digest, anti-joined with the index by sort-merge on the bucket column (the index side is
neither shuffled nor sorted), and what is new is appended with the same bucketing.

Null texts count as empty and are equal to each other. The row with the largest id of a batch stays;
a text that an earlier batch brought keeps its first keeper. Rows with a null id never stay unless all of
a group have none (then ``keep_id`` is null and none is kept). Rows that repeat id and text share one
verdict. Other columns pass through; ``digest, keep_id, group_size, kept`` are replaced if present.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm.common import shared_path, staged

#: a digest with more than 1/HOT of all rows is hot; at most HOT digests can be, the bound for broadcasting them
HOT = 256


def text_digest(text: str = "text"):
    """SHA-256 of the UTF-8 text, lowercase hex."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


class DigestIndex:
    """``DigestIndex(spark, path)`` opens the index at a shared path, or creates it.

    The bucket count is kept in ``path-buckets``, and that of an index that exists counts, not the argument. An index
    without that table is opened with the argument or the session's setting, which must be those it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        buckets = self._kept(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.buckets = buckets
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def _kept(self, buckets: int) -> int:
        beside = f"{self.path.rstrip('/')}-buckets"
        try:
            return self.spark.read.schema("buckets int").parquet(beside).first()["buckets"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.range(1).selectExpr(f"{buckets} AS buckets").write.parquet(beside)
        return buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, digests: DataFrame) -> None:
        """Adds the digests that the index lacks. ``digests``: id, digest; any number of rows per digest."""
        batch = digests.groupBy("digest").agg(F.max("id").alias("keep_id"))
        new = batch.join(self.rows().hint("merge"), "digest", "left_anti")
        new.select("digest", F.col("keep_id").cast("long").alias("keep_id")).write.bucketBy(self.buckets, "digest").sortBy(
            "digest"
        ).format("parquet").option("path", self.path).mode("append").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def verdicts(self, digests: DataFrame) -> DataFrame:
        """``id, digest, keep_id, group_size, kept`` for each row of ``digests``.

        A hot digest would put its rows into one task of the join, so those few are looked up by
        broadcast and the rest meet the index bucket by bucket.
        """
        sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        known = sizes.join(self.rows().hint("merge"), "digest", "left")
        total = digests.agg(F.count(F.lit(1))).scalar()
        hot = staged(known.where(F.col("group_size") * HOT > total), "hot")
        hit = digests.join(F.broadcast(hot), "digest", "left")
        is_hot = F.col("group_size").isNotNull()
        rest = hit.where(~is_hot).select("id", "digest").join(known.hint("merge"), "digest", "left")
        both = hit.where(is_hot).unionByName(rest)
        return both.withColumn("kept", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)))


def exact_dedup(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text",
                batches: int = 2) -> DataFrame:
    """``id, digest, keep_id, group_size, kept`` per row of ``docs``, through an index at ``path``.

    The table enters in ``batches`` ranges of the id, largest first, so that within one call the largest
    id of equal texts stays, as in a feed where each batch meets what came before it. Digests are computed
    once and staged (about 80 bytes a row).
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, path or shared_path(spark, "digest-index"))
    digests = staged(docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text).alias("digest")), "digests")
    low, high = digests.agg(F.min("id"), F.max("id")).first()
    cuts = [] if low is None else [low + (high - low + 1) * k // batches for k in range(batches - 1, 0, -1)]
    upper = None
    for cut in [*cuts, None]:
        part = digests
        if cut is not None:
            part = part.where(F.col("id") >= cut)
        elif upper is not None:
            part = part.where(F.col("id").isNull() | (F.col("id") < upper))
        if upper is not None and cut is not None:
            part = part.where(F.col("id") < upper)
        index.append(part)
        upper = cut
    return index.verdicts(digests)
