"""Filters and predicates."""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from motefield.functions import fields
from motefield.operators.camera import in_depth_range, in_frustum, literal, view
from motefield.operators.compare import flat_plane_density
from motefield.operators.overlay import cut_tracks, screen_segments, segments
from motefield.operators.ranges import marker_range
from motefield.operators.sightline import columns
from motefield.operators.splat import contributions, splat
from motefield.queries.base import (
    CAM, TILTED, ctes, lit, particle, query, raw, sql_discs, sql_hits, sql_map, sql_view, star, track,
)
from motefield.session import shared_folder
from motefield.sources import snapshot, spatial


@query("c01_type_selection", ctes("particle") + "SELECT ptype, count(*) AS n, round(sum(mass), 2) AS mass FROM particle WHERE ptype IN (0, 4) GROUP BY ptype")
def c01(spark, folder):
    p = snapshot.select_types(particle(spark, folder), [0, 4, 9])
    return p.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 2).alias("mass"))


@query("c02_skip_fields", 'SELECT l_quantity AS "Masses", l_extendedprice AS "Temperature", l_tax + 0e0 AS "Metallicity" FROM lineitem')
def c02(spark, folder):
    t = raw(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS ParticleIDs", "l_linenumber AS ParticleIDGenerationNumber", "l_quantity AS Masses", "l_extendedprice AS Temperature",
        "l_tax + 0e0 AS Metallicity", "array(l_tax, l_tax, l_tax) AS Coordinates", "l_discount AS PhotonFluxDensity", "l_returnflag AS Flag")
    return t.select(*sorted(fields.scalar_fields(t)))


@query("c02_wide_vector", """SELECT unnest(['Masses', 'vec_id', 'label']) AS name UNION ALL
SELECT 'embedding[' || i || ']' AS name FROM range((SELECT max(len(embedding)) FROM embeddings)) r(i)""")
def c02_wide(spark, folder):
    """Field list of a table with a 64-wide vector: every component is listed, none is a 3-vector."""
    t = raw(spark, folder, "embeddings")
    names = fields.scalar_fields(t) | {f"vector {n}" for n in fields.vector_fields(t)}
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


_TAN = math.tan(math.radians(TILTED.fov) / 2)


@query("c03_frustum_cull", ctes("particle") + f"""SELECT pid FROM (SELECT pid, hsml, {sql_view(TILTED)} FROM particle)
WHERE depth > -hsml AND abs(right_d) < greatest(depth+hsml, 0e0)*{lit(_TAN)}*{lit(TILTED.aspect)} + hsml AND abs(up_d) < greatest(depth+hsml, 0e0)*{lit(_TAN)} + hsml""")
def c03(spark, folder):
    p = particle(spark, folder).select("pid", "hsml", *[c.alias(n) for n, c in view(literal(TILTED), F.col("x"), F.col("y"), F.col("z")).items()])
    return p.where(in_frustum(_TAN, TILTED.aspect, F.col("depth"), F.col("right_d"), F.col("up_d"), F.col("hsml"))).select("pid")


#: a narrow view from inside the box, and what it shows of types 0 and 4
NARROW = replace(TILTED, position=(0.9, 0.8, 0.9), forward=(-0.4, -0.6, -0.9), fov=25.0, far=0.6)


@query("c03_view_scan", ctes("particle", more="seen AS (SELECT * FROM particle WHERE ptype IN (0, 4))," + sql_map(NARROW, "seen", qty="temperature")) +
       "SELECT px, py, round(num/1e5, 3) AS num, round(den/1e2, 3) AS den FROM accum")
def c03_view(spark, folder):
    """All particles are written in spatial order; the map reads the files and row groups that the camera may see."""
    path = f"{shared_folder(spark)}/spatial-{uuid.uuid4().hex}"
    spatial.write_spatial(particle(spark, folder), path, rows=4000)
    seen = spatial.read_view(spark, path, NARROW, [0, 4])
    return splat(seen, NARROW, qty="temperature").select("px", "py", F.round(F.col("num") / 1e5, 3).alias("num"), F.round(F.col("den") / 1e2, 3).alias("den"))


@query("c04_depth_clip", ctes("particle") + f"""SELECT pid, round(depth, 9) AS depth FROM (SELECT pid, {sql_view(CAM)} FROM particle)
WHERE depth >= {lit(CAM.clip_near)} AND depth <= {lit(CAM.far)}""")
def c04(spark, folder):
    p = particle(spark, folder).select("pid", view(literal(CAM), F.col("x"), F.col("y"), F.col("z"))["depth"].alias("depth"))
    return p.where(in_depth_range(literal(CAM), F.col("depth"))).select("pid", F.round("depth", 9).alias("depth"))


@query("c05_kernel_support", ctes("particle", more=sql_hits(CAM, keep="pid")) + "SELECT pid, count(*) AS pixels FROM hits GROUP BY pid")
def c05(spark, folder):
    c = contributions(particle(spark, folder), literal(CAM), F.col("mass"), F.col("hsml"), keep=["pid"])
    return c.where("sigma is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("pixels"))


@query("c06_non_empty_pixels", ctes("particle", more=sql_map(CAM, mass="mass-25e0")) + "SELECT px, py, round(den, 2) AS den FROM accum WHERE den > 1e-30")
def c06(spark, folder):
    a = splat(particle(spark, folder), CAM, mass=F.col("mass") - 25.0)
    return a.where("den > 1e-30").select("px", "py", F.round("den", 2).alias("den"))


def sql_sightline(gas, stars, eye, tag=""):
    """CTE ``sight<tag>(sid, total, n_gas)`` by testing every pair."""
    e = [lit(c) for c in eye]
    return f"""ray{tag} AS (SELECT *, sqrt(rx*rx+ry*ry+rz*rz) AS d FROM (SELECT sid, x AS sx, y AS sy, z AS sz, {e[0]}-x AS rx, {e[1]}-y AS ry, {e[2]}-z AS rz FROM {stars})),
pair{tag} AS (SELECT sid, mass, hsml, d, ((x-sx)*rx+(y-sy)*ry+(z-sz)*rz)/d AS t, (x-sx)*(x-sx)+(y-sy)*(y-sy)+(z-sz)*(z-sz) AS r2 FROM ray{tag}, {gas}),
near{tag} AS (SELECT *, greatest(r2-t*t, 0e0) AS b2 FROM pair{tag} WHERE t > 0 AND t < d),
sum{tag} AS (SELECT sid, sum(mass*{lit(3 / math.pi)}/(hsml*hsml)*(1e0-b2/(hsml*hsml))*(1e0-b2/(hsml*hsml))) AS total, count(*) AS n FROM near{tag} WHERE b2 < hsml*hsml GROUP BY sid),
sight{tag} AS (SELECT sid, coalesce(total, 0e0) AS total, coalesce(n, 0) AS n_gas FROM (SELECT sid FROM {stars}) LEFT JOIN sum{tag} USING (sid))"""


@query("c07_sightline_predicate", ctes("particle", "star", more=sql_sightline("particle", "star", TILTED.position)) + "SELECT sid, n_gas FROM sight")
def c07(spark, folder):
    return columns(particle(spark, folder), star(spark, folder), TILTED.position, key=["pid", "mass", "temperature"]).select("sid", "n_gas")


@query("c08_finite_positive", """
WITH v AS (SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE WHEN event_id % 83 = 0 THEN -value ELSE value END AS value FROM events)
SELECT min(value) FILTER (WHERE NOT isnan(value) AND abs(value) < 'inf'::DOUBLE) AS lo, max(value) FILTER (WHERE NOT isnan(value) AND abs(value) < 'inf'::DOUBLE) AS hi,
round(log10(min(value) FILTER (WHERE NOT isnan(value) AND abs(value) < 'inf'::DOUBLE AND value > 0)), 9) AS log_lo FROM v""")
def c08(spark, folder):
    v = raw(spark, folder, "events").selectExpr("""CASE WHEN event_id % 97 = 0 THEN double('NaN') WHEN event_id % 89 = 0 THEN double('Infinity')
        WHEN event_id % 83 = 0 THEN -value ELSE value END AS value""")
    log = marker_range(v, "value", True).select(F.round("lo", 9).alias("log_lo"))
    return marker_range(v, "value", False).withColumn("log_lo", log.scalar())


@query("c09_track_start", ctes("track") + """, kept AS (SELECT * FROM track WHERE aexp >= 9.5e-2)
SELECT sink_id, nstep, aexp FROM kept WHERE sink_id IN (SELECT sink_id FROM kept GROUP BY sink_id HAVING count(*) >= 2)""")
def c09(spark, folder):
    return cut_tracks(track(spark, folder), 9.5e-2).select("sink_id", "nstep", "aexp")


def sql_segments(tag=""):
    return f"""seg{tag} AS (SELECT sink_id, nstep, x, y, z, x1, y1, z1 FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1
  FROM track WINDOW w AS (PARTITION BY sink_id ORDER BY nstep)) WHERE x1 IS NOT NULL)"""


def sql_screen(cam, keep):
    """CTEs ``ends`` and ``line``: segments in pixels."""
    v0 = sql_view(cam).replace(" AS depth", " AS depth0").replace(" AS right_d", " AS right0").replace(" AS up_d", " AS up0")
    v1 = sql_view(cam).replace("(x-", "(x1-").replace("(y-", "(y1-").replace("(z-", "(z1-").replace(" AS depth", " AS depth1").replace(" AS right_d", " AS right1").replace(" AS up_d", " AS up1")
    f, fx = lit(cam.focal), lit(cam.focal / cam.aspect)
    n = ", ".join(f"{fx}*right{i}/depth{i} AS nx{i}, {f}*up{i}/depth{i} AS ny{i}" for i in "01")
    s = ", ".join(f"(nx{i}+1e0)*{cam.width}/2e0-0.5e0 AS sx{i}, (1e0-ny{i})*{cam.height}/2e0-0.5e0 AS sy{i}" for i in "01")
    return f"""ends AS (SELECT {keep}, {v0}, {v1} FROM seg), line AS (SELECT {keep}, {s} FROM (SELECT {keep}, {n} FROM ends WHERE depth0 > 0 AND depth1 > 0)
  WHERE sqrt((nx1-nx0)*(nx1-nx0)+(ny1-ny0)*(ny1-ny0)) >= 1e-8)"""


INSIDE = type(CAM)((0.5, 0.5, 0.6), fov=75.0, width=64, height=64)


@query("c10_visible_segments", ctes("track", more=sql_segments() + "," + sql_screen(INSIDE, "sink_id, nstep")) + """
SELECT sink_id, nstep, round(sx0, 5) AS sx0, round(sy0, 5) AS sy0, round(sx1, 5) AS sx1, round(sy1, 5) AS sy1 FROM line""")
def c10(spark, folder):
    s = screen_segments(segments(track(spark, folder)), INSIDE, keep=["sink_id", "nstep"])
    return s.select("sink_id", "nstep", *[F.round(c, 5).alias(c) for c in ("sx0", "sy0", "sx1", "sy1")])


def sql_flat(center, distance, res, tag="F", src="particle", rmax=1.0):
    size = 2 * rmax / res
    c = [lit(v) for v in center]
    return f"""flat{tag} AS (SELECT (x-{c[0]})/d AS u, (y-{c[1]})/d AS v, greatest(hsml/d, {lit(size)}) AS h, mass/(d*d) AS m
  FROM (SELECT *, -((z-{c[2]})-{lit(distance)}) AS d FROM {src}) WHERE d > 0),
shape{tag} AS (SELECT (u+{lit(rmax)})/{lit(size)}-0.5e0 AS cx, ({lit(rmax)}-v)/{lit(size)}-0.5e0 AS cy, h/{lit(size)} AS rx, h/{lit(size)} AS ry, m/(h*h) AS a, 0e0 AS q FROM flat{tag}),
{sql_discs(res, res, tag=tag)}, accum{tag} AS (SELECT px, py, sum(sigma) AS den FROM hits{tag} GROUP BY px, py)"""


@query("c11_behind_plane", ctes("particle", more=sql_flat((0.5, 0.5, 0.5), 0.2, 64)) + "SELECT px, py, round(den/1e3, 3) AS den FROM accumF")
def c11(spark, folder):
    m = flat_plane_density(particle(spark, folder), (0.5, 0.5, 0.5), 0.2, 64)
    return m.select("px", "py", F.round(F.col("den") / 1e3, 3).alias("den"))


