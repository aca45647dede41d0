"""Particles, stars, tracks, mesh blocks and cameras derived from the driver's tables.

The same expressions are given as SQL in :data:`SQL`, so both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motefield.session import spread

PARTICLE = """
SELECT l_orderkey*1000003 + l_partkey*10007 + l_suppkey*101 + l_linenumber AS pid,
       l_linenumber % 6 AS ptype,
       ((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 100003)/100003e0 AS x,
       ((l_partkey*15485863 + l_linenumber*32452843 + l_orderkey*17) % 100003)/100003e0 AS y,
       ((l_suppkey*49979687 + l_orderkey*86028121 + l_partkey) % 100003)/100003e0 AS z,
       l_quantity AS mass, 1e-2 + 5e-2*abs(l_discount) AS hsml, l_extendedprice AS temperature,
       (l_partkey % 201 - 100)/1e1 AS vx, (l_suppkey % 101 - 50)/1e1 AS vy,
       (l_orderkey % 401 - 200)/1e1 AS vz
FROM lineitem"""

# smoothing lengths over seven octaves
OCTAVES = f"""
SELECT pid, ptype, x, y, z, mass, temperature, vx, vy, vz,
       hsml * CASE WHEN pid % 7 = 0 THEN 1e0 WHEN pid % 7 = 1 THEN 2e0 WHEN pid % 7 = 2 THEN 4e0
                   WHEN pid % 7 = 3 THEN 8e0 WHEN pid % 7 = 4 THEN 16e0 WHEN pid % 7 = 5 THEN 32e0
                   ELSE 64e0 END AS hsml
FROM ({PARTICLE}) AS p"""

STAR = """
SELECT s_suppkey AS sid, (s_suppkey*7919 % 1009)/1009e0 AS x, (s_suppkey*104729 % 1009)/1009e0 AS y,
       (s_suppkey*49979687 % 1009)/1009e0 AS z, abs(s_acctbal)/1e2 AS mass,
       (s_suppkey % 21 - 10)/1e0 AS vx, (s_suppkey % 13 - 6)/1e0 AS vy, (s_suppkey % 7 - 3)/1e0 AS vz
FROM supplier"""

TRACK = """
SELECT user_id AS sink_id, event_id AS nstep, (event_id+1)/100000e0 AS aexp,
       ((event_id*7919 + user_id*104729) % 1009)/1009e0 AS x,
       ((event_id*15485863 + user_id*17) % 1009)/1009e0 AS y,
       ((event_id*49979687 + user_id*31) % 1009)/1009e0 AS z
FROM events"""

BLOCK = """
SELECT p_partkey AS block_id, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END AS node_type,
       (p_partkey*7919 % 1009)/1009e0 AS cx, (p_partkey*104729 % 1009)/1009e0 AS cy,
       (p_partkey*49979687 % 1009)/1009e0 AS cz, (1 + p_size % 3)/32e0 AS size
FROM part"""

# camera poses: the view direction always has a component along -z, so it is never parallel to up
POSE = """
SELECT event_id AS cam_id, ((event_id*7919) % 1009)/1009e0 AS px, ((event_id*31 + user_id) % 1009)/1009e0 AS py,
       1.5e0 AS pz, ((event_id*37 + user_id*11) % 19 - 9)/1e1 AS forwardx,
       ((event_id*13 + user_id*7) % 19 - 9)/1e1 AS forwardy, -1e0 AS forwardz,
       0e0 AS upx, 1e0 AS upy, 0e0 AS upz, value/1e3 AS angle
FROM events"""

FRAMELOG = "SELECT event_type AS run, event_id AS frame, value AS ms FROM events"

SQL = {"particle": PARTICLE, "octaves": OCTAVES, "star": STAR, "track": TRACK, "block": BLOCK, "pose": POSE,
       "framelog": FRAMELOG}


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named derived table; the scan is spread over the cores when it has too few splits."""
    sql = SQL[name]
    base = sql.split("FROM ")[-1].split(")")[0].split()[0]
    scan = spread(raw(spark, folder, base))
    return spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=scan)
