"""Sink tracks from text files ``sink_<id>.txt``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = 16  # a data line has at least this many
FILE = r"^sink_(\d+)\.txt$"


def read_tracks(spark: SparkSession, folder: str, until: float, pc_in_code: float) -> DataFrame:
    """All tracks in a folder, one row per sample."""
    lines = spark.read.text(f"{folder}/sink_*.txt").select(F.col("_metadata.file_name").alias("file"), "value")
    return parse_tracks(lines, until, pc_in_code)


def parse_tracks(lines: DataFrame, until: float, pc_in_code: float) -> DataFrame:
    """``sink_id, nstep, aexp, x, y, z`` in code units from lines of ``file, value``.

    Blank, comment, short and non-numeric lines are skipped. Samples after ``until`` are cut, and a
    sink needs two samples both before and after the cut.
    """
    sid = F.regexp_extract("file", FILE, 1)
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    tok = lines.where(sid != "").select(sid.cast("long").alias("sink_id"), F.split(text, " ").alias("t"), text.alias("s"))
    tok = tok.where((F.col("s") != "") & ~F.col("s").startswith("#") & (F.size("t") >= COLUMNS))
    num = lambda i: F.get("t", F.lit(i)).try_cast("double")
    rows = tok.select(
        "sink_id", F.get("t", F.lit(0)).try_cast("long").alias("nstep"), num(1).alias("aexp"),
        *[num(13 + i).alias(a) for i, a in enumerate("xyz")],
    ).where(F.col("aexp").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    # the cut only lowers the count, so two samples after it imply two before it
    kept = rows.where(F.col("aexp") <= until)
    enough = kept.groupBy("sink_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("sink_id")
    kept = kept.join(enough, "sink_id", "left_semi")
    return kept.select("sink_id", "nstep", "aexp", *[(F.col(a) * pc_in_code).alias(a) for a in "xyz"])
