"""Streaming maps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motefield.queries.base import CAM, ctes, query, raw, sql_accum, sql_hits, sql_map
from motefield.session import shared_folder
from motefield.sources.tables import PARTICLE
from motefield.streaming.live import live_map, run_updates, run_windows, windowed_map


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("i01_streaming_map", ctes("particle", more=sql_map(CAM, qty="temperature")) + """
SELECT px, py, round(num/1e5, 2) AS num, round(den, 2) AS den, round(sq/1e10, 2) AS sq FROM accum""")
def i01(spark, folder):
    """The particles come in four deliveries, two a batch; each batch writes the tiles it touches.

    A delivery is one file, or as many as a quarter of the table has splits: no task holds more than about a split."""
    path = fresh(spark, "live")
    table = raw(spark, folder, "lineitem")
    files = -(-table.rdd.getNumPartitions() // 4)
    table.repartition(4 * files, "l_orderkey", "l_linenumber").write.parquet(f"{path}/in")
    base = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2 * files).parquet(f"{path}/in")
    stream = spark.sql(PARTICLE.replace("FROM lineitem", "FROM {base}"), base=base)
    a = run_updates(live_map(stream, CAM, qty="temperature"), path, CAM.height, tiles=8)
    return a.select("px", "py", F.round(F.col("num") / 1e5, 2).alias("num"), F.round("den", 2).alias("den"), F.round(F.col("sq") / 1e10, 2).alias("sq"))


EVENT = """SELECT ts, ((event_id*7919 + user_id*104729) % 1009)/1009e0 AS x, ((event_id*15485863 + user_id*17) % 1009)/1009e0 AS y,
  ((event_id*49979687 + user_id*31) % 1009)/1009e0 AS z, value AS mass, 3e-2 AS hsml FROM events"""
SMALL = type(CAM)((0.5, 0.5, 1.5), width=32, height=32)


#: three deliveries of ten days each; every 50th row comes with the last one
SLICE = "CASE WHEN event_id % 50 = 0 THEN 2 ELSE least(greatest(datediff('day', TIMESTAMP '2024-01-01', ts) // 10, 0), 2) END"


@query("i02_windowed_map", f"""WITH t AS (SELECT *, {SLICE} AS part FROM events),
mark AS (SELECT max(ts) FILTER (part < 2) - INTERVAL 1 DAY AS before_last, max(ts) - INTERVAL 1 DAY AS last FROM t),
e AS (SELECT *, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS start FROM (SELECT part, {EVENT.removeprefix("SELECT ").replace("FROM events", "FROM t")})),
w AS (SELECT e.* FROM e, mark WHERE (part < 2 OR start + INTERVAL 5 DAY > before_last) AND start + INTERVAL 5 DAY <= last),
{sql_hits(SMALL, "w", keep="start")}, {sql_accum(keep="start")} SELECT start, px, py, round(den, 3) AS den FROM accum""")
def i02(spark, folder):
    """Three deliveries to one stream. Rows that come after their window closed are dropped, and windows that
    the last watermark has not passed are not given out."""
    table, path = raw(spark, folder, "events"), fresh(spark, "windows")
    part = F.when(F.col("event_id") % 50 == 0, 2).otherwise(
        F.least(F.greatest(F.floor(F.datediff("ts", F.lit("2024-01-01").cast("timestamp_ntz")) / 10), F.lit(0)), F.lit(2)))
    for k in range(3):
        table.where(part == k).write.mode("append").parquet(f"{path}/in")
        base = spark.readStream.schema(table.schema).parquet(f"{path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        stream = spark.sql(EVENT.replace("FROM events", "FROM {base}"), base=base)
        out = run_windows(windowed_map(stream, SMALL, "ts", "5 days", "1 day"), path)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "px", "py", F.round("den", 3).alias("den"))
