"""Whole jobs: the plans a user calls, from the particle table to the result."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from motefield.functions.fields import FieldSpec
from motefield.plans.reader import load_stars, read_snapshot
from motefield.plans.snapshot import composite_image, field_image, field_map, fly_through
from motefield.queries.aggregates import PIXELS, sql_bisection, sql_entropy
from motefield.queries.base import CAM, TILTED, block, ctes, lit, particle, query, sql_map, star
from motefield.queries.fields import snapshot_rows, sql_composite
from motefield.queries.scans import AMR_CELLS, AMR_VARS, FACE_CELLS, FACE_VARS, GRID_SQL, SHAPE, amr, faces, rounded, sql_lookup
from motefield.session import shared_folder
from motefield.sources import derived, snapshot


def drawable(spark, folder):
    """The particles with the field names and columns the plans use."""
    p = snapshot_rows(spark, folder)
    at = {a: F.col("Coordinates")[i] for i, a in enumerate("xyz") if a not in p.columns}
    return p.withColumns(at).withColumn("hsml", F.col("KernelMaxRadius"))


@query("p01_field_image", ctes("particle", more=PIXELS + ", lv AS (SELECT log10(value) AS value, weight FROM px WHERE value > 0)," + sql_entropy("lv") + """,
ends AS (SELECT log10(greatest(pow(1e1, lo), 1e-30)) AS lo, log10(greatest(pow(1e1, hi), 1e-30)) AS hi FROM best),
rng AS (SELECT CASE WHEN hi-lo < 0.1e0 THEN (lo+hi)/2-1 ELSE lo END AS low, CASE WHEN hi-lo < 0.1e0 THEN (lo+hi)/2+1 ELSE hi END AS high FROM ends),
""" + GRID_SQL + """,
shown AS (SELECT px, py, CASE WHEN den >= 1e-30 THEN greatest(0e0, least(1e0, (log10(greatest(den, 1e-30)) - low)/(high - low))) END AS t
  FROM grid LEFT JOIN accum USING (px, py), rng),""" + sql_lookup("hot", "shown", "px, py")) + """
SELECT px, py, round(coalesce(r, 0), 4) AS r, round(coalesce(g, 0), 4) AS g, round(coalesce(b, 0), 4) AS b, 1e0 AS a FROM colored""")
def p01(spark, folder):
    """Surface density over its automatic range, as an image."""
    return rounded(field_image(drawable(spark, folder), CAM, FieldSpec()), 4, "r", "g", "b")


def _ranged(src):
    return f"(WITH {sql_entropy(src)} SELECT lo, hi FROM best)"


@query("p02_composite_image", ctes("particle", more=sql_map(CAM, qty="temperature") + f""",
one AS (SELECT log10(den) AS value, den AS weight FROM accum WHERE den > 1e-30), two AS (SELECT num/den AS value, 1e0 AS weight FROM accum WHERE den > 1e-30),
ends AS (SELECT log10(greatest(pow(1e1, lo), 1e-30)) AS lo, log10(greatest(pow(1e1, hi), 1e-30)) AS hi FROM {_ranged("one")}),
light AS (SELECT CASE WHEN hi-lo < 0.1e0 THEN (lo+hi)/2-1 ELSE lo END AS low1, CASE WHEN hi-lo < 0.1e0 THEN (lo+hi)/2+1 ELSE hi END AS high1 FROM ends),
tint AS (SELECT lo AS low2, hi AS high2 FROM {_ranged("two")}),
six AS (SELECT px, py, num AS num1, den AS den1, sq AS sq1, num AS num2, den AS den2, sq AS sq2, low1, high1, low2, high2 FROM accum, light, tint),
""" + sql_composite("six").replace("- 3e0)/4e0", "- low1)/(high1 - low1)").replace("- 1e4)/5e4", "- low2)/(high2 - low2)").replace("END, 6)", "END, 4)")))
def p02(spark, folder):
    """Lightness from the surface density, colour from the mean temperature, each over its automatic range."""
    image = composite_image(drawable(spark, folder), CAM, FieldSpec(log=True), FieldSpec(mode="WeightedAverage", data="Temperature", log=False))
    return rounded(image, 4, "r", "g", "b").drop("a")


FRAMES = [CAM, TILTED, replace(CAM, position=(0.2, 0.3, 1.2), width=48, height=32)]


def sql_los(cam):
    d = [f"({a}-({lit(e)}))" for a, e in zip("xyz", cam.position)]
    return "(" + "+".join(f"v{a}*{x}" for a, x in zip("xyz", d)) + ")/greatest(sqrt(" + "+".join(f"{x}*{x}" for x in d) + "), 1e-30)"


@query("p03_fly_through", ctes("particle", more=",\n".join(sql_map(c, qty=sql_los(c), tag=str(i)) for i, c in enumerate(FRAMES))) + " UNION ALL ".join(
    f"SELECT {i} AS cam_id, px, py, round(num/den, 5) AS v, round(den, 2) AS weight FROM accum{i} WHERE den > 1e-30" for i in range(len(FRAMES))))
def p03(spark, folder):
    """Line-of-sight velocity along a path: each frame has its own size and its own lines of sight."""
    frames = fly_through(drawable(spark, folder), FRAMES, FieldSpec(data="Velocities", mode="WeightedAverage"))
    return frames.where("den > 1e-30").select("cam_id", "px", "py", F.round(F.col("num") / F.col("den"), 5).alias("v"), F.round("den", 2).alias("weight"))


@query("p04_pool_computed_lengths", ctes("block", "star", more=sql_bisection(40)) + """
SELECT 0 AS ptype, cx AS x, cy AS y, cz AS z, size AS mass, round((lo+hi)/2e0, 8) AS hsml FROM block JOIN step40 s ON cx = s.x AND cy = s.y AND cz = s.z
UNION ALL SELECT 4, x, y, z, mass, round(1e-2 + mass*1e-4, 8) FROM star""")
def p04(spark, folder):
    """A pool of two types: one without lengths, which come from its neighbours, one that stores them."""
    gas = block(spark, folder).select(F.array("cx", "cy", "cz").alias("Coordinates"), F.col("size").alias("Masses"))
    stars = star(spark, folder).select(F.array("x", "y", "z").alias("Coordinates"), F.col("mass").alias("Masses"), (F.col("mass") * 1e-4 + 1e-2).alias("SmoothingLength"))
    return rounded(snapshot.pool({0: gas, 4: stars}, [0, 4]), 8, "hsml")


def written(spark, folder):
    """The driver tables as snapshots of every layout, in the shared folder."""
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    faces(spark, folder).write.parquet(f"{path}/faces/blocks")
    amr(spark, folder).write.parquet(f"{path}/amr/blocks")
    p = snapshot_rows(spark, folder).withColumnRenamed("KernelMaxRadius", "SmoothingLength")
    for t in (0, 4):
        for k in range(2):
            p.where((p.ptype == t) & (p.pid % 2 == k)).drop("ptype").write.parquet(f"{path}/particles/PartType{t}/snap.{k}.parquet")
    star(spark, folder).selectExpr(*[f"{a} AS particle_position_{a}" for a in "xyz"], *[f"v{a} AS particle_velocity_{a}" for a in "xyz"],
                                   "mass AS particle_mass", "2e-2 AS smoothing_length").write.parquet(f"{path}/catalog/PartType4")
    return path


def _part(layout, sql):
    return f"SELECT '{layout}' AS layout, * FROM ({sql})"


_SUMS = "count(*) AS n, round(sum({m}), 3) AS mass, round(sum({h}), 6) AS hsml"


@query("a03_read_layouts", " UNION ALL ".join([
    _part("faces", FACE_CELLS + "SELECT " + _SUMS.format(m="rho*volume", h="cbrt(volume)") + " FROM pos"),
    _part("amr", AMR_CELLS + "SELECT " + _SUMS.format(m="dens*volume", h="cbrt(volume)") + " FROM cells"),
    _part("particles", ctes("particle") + "SELECT " + _SUMS.format(m="mass", h="hsml") + " FROM particle WHERE ptype IN (0, 4)"),
    _part("catalog", ctes("star") + "SELECT " + _SUMS.format(m="mass", h="2e-2") + " FROM star")]))
def a03_read(spark, folder):
    """Each layout read from its folder to the pooled particle table."""
    path = written(spark, folder)
    pools = {"faces": read_snapshot(spark, f"{path}/faces", shape=SHAPE, variables=FACE_VARS), "amr": read_snapshot(spark, f"{path}/amr", shape=SHAPE, variables=AMR_VARS),
             "particles": read_snapshot(spark, f"{path}/particles", [0, 4]), "catalog": read_snapshot(spark, f"{path}/catalog")}
    sums = [t.agg(F.lit(n).alias("layout"), F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 3).alias("mass"), F.round(F.sum("hsml"), 6).alias("hsml"))
            for n, t in pools.items()]
    return reduce(lambda a, b: a.unionByName(b), sums)


@query("p05_load_stars", ctes("star") + """SELECT x, y, z, mass, round(sqrt(vx*vx + vy*vy + vz*vz), 9) AS speed, 2e-2 AS "SmoothingLength" FROM star""")
def p05(spark, folder):
    """The star table of a catalog snapshot."""
    return rounded(load_stars(spark, f"{written(spark, folder)}/catalog").drop("luminosity"), 9, "speed")


@query("p07_star_luminosities", ctes("star") + """, m AS (SELECT *, mass/0.7e0 AS msun FROM star)
SELECT round(x*(0.5e0/0.7e0), 9) AS x, round(y*(0.5e0/0.7e0), 9) AS y, round(z*(0.5e0/0.7e0), 9) AS z, round(msun, 9) AS mass,
round(CASE WHEN msun < 0.43e0 THEN 0.23e0*pow(msun, 2.3e0) WHEN msun < 2e0 THEN msun*msun*msun*msun WHEN msun < 55e0 THEN 1.4e0*msun*msun*msun*sqrt(msun)
  ELSE 32e3*msun END, 5) AS luminosity, round(sqrt(vx*vx + vy*vy + vz*vz), 9) AS speed FROM m""")
def p07(spark, folder):
    """Stars of a snapshot in comoving units without stored luminosities: physical masses, and the main sequence for them."""
    path = f"{shared_folder(spark)}/stars-{uuid.uuid4().hex}"
    star(spark, folder).select(F.array("x", "y", "z").alias("Coordinates"), F.array("vx", "vy", "vz").alias("Velocities"), F.col("mass").alias("Masses")).write.parquet(
        f"{path}/PartType4/snap.0.parquet")
    spark.range(1).selectExpr("1e0 AS ComovingIntegrationOn", "5e-1 AS Time", "7e-1 AS HubbleParam").write.parquet(f"{path}/Header/snap.0.parquet")
    return rounded(rounded(load_stars(spark, path), 9, "x", "y", "z", "mass", "speed"), 5, "luminosity")


@query("p06_structured_mesh_map", AMR_CELLS + "," + sql_map(CAM, "cells", tag="6", mass="dens*volume*1e6", hsml="2e0*cbrt(volume)") + " SELECT px, py, round(den, 2) AS density FROM accum6 WHERE den > 1e-30")
def p06(spark, folder):
    """Surface density of a block mesh read from its folder, drawn with twice the cell length."""
    path = f"{shared_folder(spark)}/mesh-{uuid.uuid4().hex}"
    amr(spark, folder).write.parquet(f"{path}/blocks")
    pool = read_snapshot(spark, path, shape=SHAPE, variables=AMR_VARS).withColumn("Masses", F.col("mass") * 1e6)
    accum = field_map(pool, CAM, FieldSpec(), structured=True)
    return accum.where("den > 1e-30").select("px", "py", F.round("den", 2).alias("density"))


@query("a23_cached_lengths", ctes("block", more=sql_bisection(40)) + """
SELECT block_id, floor(cx*4e0)::INTEGER AS part, round((lo+hi)/2e0, 8) AS hsml FROM block JOIN step40 s ON cx = s.x AND cy = s.y AND cz = s.z""")
def a23(spark, folder):
    """Lengths kept by part: computed for a state in which a quarter of space was different, then again for what changed."""
    where = f"{shared_folder(spark)}/lengths-{uuid.uuid4().hex}"
    b = block(spark, folder).select("block_id", *[F.col(f"c{a}").alias(a) for a in "xyz"]).withColumn("part", F.floor(F.col("x") * 4).cast("int"))
    derived.kept_lengths(b.where("part <> 3 or block_id % 7 <> 0"), where, ["block_id"])
    return rounded(derived.kept_lengths(b, where, ["block_id"]).select("block_id", "part", "hsml"), 8, "hsml")
