"""Star photometry and overlays (B34-B38, E14, E21-E23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.functions.color import lookup
from motefield.functions.photometry import BANDS, kappa, marker_coordinate, marker_radius, marker_shade, psf_shade, zams_luminosity
from motefield.operators.camera import literal, view
from motefield.operators.overlay import (
    cut_tracks, extinction, extinction_rgb, marker_overlay, psf_overlay, segments, track_overlay,
)
from motefield.operators.ranges import marker_range
from motefield.queries.base import CAM, ctes, lit, query, sql_hits, sql_kernel, sql_view, star, track
from motefield.queries.fields import ZAMS
from motefield.queries.filters import INSIDE, sql_screen, sql_segments
from motefield.queries.scans import rounded, sql_clamp, sql_lookup

SIZE = 1e-3

# luminosity and a stand-in dust column
LUM = f"lum AS (SELECT *, {ZAMS} AS luminosity, mass*2e-1 AS dust FROM star)"


def lum(spark, folder):
    s = star(spark, folder)
    return s.withColumns({"luminosity": zams_luminosity(F.col("mass")), "dust": F.col("mass") * 0.2})


@query("b34_extinction", ctes("star", more=LUM) + "SELECT sid, band, round(luminosity*exp(-(k*dust))/1e3, 7) AS dimmed FROM lum, (VALUES " +
       ", ".join(f"('{b}', {lit(kappa(b))})" for b in BANDS) + ") b(band, k)")
def b34(spark, folder):
    return extinction(lum(spark, folder), column="dust").select("sid", "band", F.round(F.col("dimmed") / 1e3, 7).alias("dimmed"))


@query("b34_extinction_rgb", ctes("star", more=LUM) + "SELECT sid, " + ", ".join(
    f"round(luminosity*exp(-({lit(kappa(b))}*dust))/1e3, 7) AS l_{c}" for c, b in zip("rgb", ("I", "V", "B"))) + " FROM lum")
def b34_rgb(spark, folder):
    e = extinction_rgb(lum(spark, folder), column="dust")
    return e.select("sid", *[F.round(F.col(f"l_{c}") / 1e3, 7).alias(f"l_{c}") for c in "rgb"])


RADIUS = f"greatest({lit(SIZE)}*sqrt(greatest(luminosity, 1e-6)), 2e0*(2e0*greatest(abs(depth), 1e-6)/{lit(CAM.focal * CAM.height)}))"
DISC = LUM + f", placed AS (SELECT *, {RADIUS} AS radius FROM (SELECT *, {sql_view(CAM)} FROM lum))"


@query("b35_marker_radius", ctes("star", more=DISC) + "SELECT sid, round(radius, 9) AS radius FROM placed")
def b35(spark, folder):
    s = lum(spark, folder)
    depth = view(literal(CAM), F.col("x"), F.col("y"), F.col("z"))["depth"]
    return s.select("sid", F.round(marker_radius(F.col("luminosity"), SIZE, 0.5, depth, CAM.focal, CAM.height), 9).alias("radius"))


MARK_T = sql_clamp("(log10(greatest(mass, 1e-30)) - (-0.5e0))/greatest(2e0 - (-0.5e0), 1e-12)")


@query("b36_marker_coordinate", ctes("star") + f"SELECT sid, round({MARK_T}, 9) AS t_log, round({sql_clamp('(mass-1e1)/8e1')}, 9) AS t_lin FROM star")
def b36(spark, folder):
    m = F.col("mass")
    return star(spark, folder).select("sid", F.round(marker_coordinate(m, -0.5, 2.0, True), 9).alias("t_log"),
                                      F.round(marker_coordinate(m, 10.0, 90.0, False), 9).alias("t_lin"))


@query("b37_marker_shade", ctes("star") + """SELECT sid, CASE WHEN x <= 0.75e0 THEN y ELSE 1e0 END AS r, CASE WHEN x <= 0.75e0 THEN z ELSE 0.5e0 END AS g,
CASE WHEN x <= 0.75e0 THEN x ELSE 0.25e0 END AS b FROM star""")
def b37(spark, folder):
    rgb = marker_shade(F.col("x"), [F.col("y"), F.col("z"), F.col("x")], (1.0, 0.5, 0.25), 0.25)
    return star(spark, folder).select("sid", *[c.alias(n) for c, n in zip(rgb, "rgb")])


@query("b38_psf_shade", ctes("star") + f"SELECT sid, round(sqrt(exp(-8e0*(x*x)))*1.5e0*{sql_clamp('y*1.2e0')}, 9) AS amp FROM star")
def b38(spark, folder):
    return star(spark, folder).select("sid", F.round(psf_shade(F.col("x") * F.col("x"), F.col("y") * 1.2, 1.5), 9).alias("amp"))


@query("e14_marker_range", ctes("star") + """SELECT min(mass) AS lo, max(mass) AS hi, round(log10(min(mass) FILTER (WHERE mass > 0)), 9) AS log_lo,
round(log10(max(mass) FILTER (WHERE mass > 0)), 9) AS log_hi, 3e0 AS flat_lo, 4e0 AS flat_hi FROM star""")
def e14(spark, folder):
    s = star(spark, folder)
    logs, flat = marker_range(s, "mass", True), marker_range(s.select(F.lit(3.0).alias("v")), "v", False)
    return marker_range(s, "mass", False).withColumns({
        "log_lo": F.round(logs.select("lo").scalar(), 9), "log_hi": F.round(logs.select("hi").scalar(), 9),
        "flat_lo": flat.select("lo").scalar(), "flat_hi": flat.select("hi").scalar()})


DISC_HITS = DISC + "," + sql_hits(CAM, "placed", mass="1e0", hsml="radius", keep="sid, luminosity, dust, mass").replace(
    sql_kernel("cubic_spline"), "1e0")


@query("e21_psf_overlay", ctes("star", more=DISC_HITS) + "SELECT px, py, " + ", ".join(
    f"round(least(1e0, sum(sqrt(exp(-8e0*r2))*0.7e0*{sql_clamp(f'luminosity*exp(-({lit(kappa(b))}*dust))/greatest(luminosity, 1e-6)')})), 8) AS {c}"
    for c, b in zip("rgb", ("I", "V", "B"))) + " FROM hits GROUP BY px, py")
def e21(spark, folder):
    return rounded(psf_overlay(lum(spark, folder), CAM, SIZE, 0.7, column="dust"), 8, "r", "g", "b")


@query("e21_psf_single_band", ctes("star", more=DISC_HITS) +
       f"SELECT px, py, round(least(1e0, sum(sqrt(exp(-8e0*r2))*0.7e0*{sql_clamp(f'luminosity*exp(-({lit(kappa(chr(85)))}*dust))/greatest(luminosity, 1e-6)')})), 8) AS u FROM hits GROUP BY px, py")
def e21_u(spark, folder):
    return psf_overlay(lum(spark, folder), CAM, SIZE, 0.7, band="U", column="dust").select("px", "py", F.round("r", 8).alias("u"))


SHADED = "shown AS (SELECT px, py, sid, r2, " + MARK_T + " AS t FROM hits)," + sql_lookup("hot", "shown", "px, py, sid, r2") + """,
ring AS (SELECT px, py, sid, CASE WHEN sqrt(r2) <= 0.8e0 THEN r ELSE 1e0 END AS r, CASE WHEN sqrt(r2) <= 0.8e0 THEN g ELSE 1e0 END AS g,
  CASE WHEN sqrt(r2) <= 0.8e0 THEN b ELSE 1e0 END AS b FROM colored)"""


def markers(spark, folder):
    s = lum(spark, folder).withColumn("t", marker_coordinate(F.col("mass"), -0.5, 2.0, True))
    s = lookup(s, "t", "hot")
    return s.withColumnsRenamed({c: f"fill_{c}" for c in "rgb"})


@query("e22_marker_overlay", ctes("star", more=DISC_HITS + "," + SHADED) + """
SELECT px, py, round(sum(r*0.6e0*pow(0.4e0, n)), 7) AS r, round(sum(g*0.6e0*pow(0.4e0, n)), 7) AS g, round(sum(b*0.6e0*pow(0.4e0, n)), 7) AS b,
  round(1e0-pow(0.4e0, count(*)), 7) AS cover FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY sid DESC) - 1 AS n FROM ring) GROUP BY px, py""")
def e22(spark, folder):
    m = marker_overlay(markers(spark, folder), CAM, SIZE, "sid", opacity=0.6)
    return rounded(m, 7, "r", "g", "b", "cover")


@query("e22_marker_opaque", ctes("star", more=DISC_HITS + "," + SHADED) + """
SELECT px, py, round(max_by(r, sid), 7) AS r, round(max_by(g, sid), 7) AS g, round(max_by(b, sid), 7) AS b FROM ring GROUP BY px, py""")
def e22_opaque(spark, folder):
    m = marker_overlay(markers(spark, folder), CAM, SIZE, "sid")
    return rounded(m.drop("cover"), 7, "r", "g", "b")


@query("e23_track_overlay", ctes("track", more=sql_segments() + "," + sql_screen(INSIDE, "sink_id, nstep")) + f""",
rows AS (SELECT *, sx1-sx0 AS dx, sy1-sy0 AS dy, unnest(range(greatest(ceil(least(sy0, sy1)-1.5e0), 0)::BIGINT, least(floor(greatest(sy0, sy1)+1.5e0), {INSIDE.height - 1})::BIGINT+1)) AS py FROM line),
cells AS (SELECT *, sqrt(dx*dx+dy*dy) AS len, unnest(range(greatest(ceil(least(sx0, sx1)-1.5e0), 0)::BIGINT, least(floor(greatest(sx0, sx1)+1.5e0), {INSIDE.width - 1})::BIGINT+1)) AS px FROM rows),
hit AS (SELECT *, ((px-sx0)*dx+(py-sy0)*dy)/len AS along, abs((px-sx0)*dy-(py-sy0)*dx)/len AS off FROM cells)
SELECT px::INTEGER AS px, py::INTEGER AS py, max(struct_pack(s := sink_id, n := nstep)).s % 10 / 1e1 AS r FROM hit WHERE off <= 1.5e0 AND along >= 0 AND along <= len GROUP BY px, py""")
def e23(spark, folder):
    t = segments(cut_tracks(track(spark, folder), 0.0))
    t = t.withColumns({"r": F.expr("sink_id % 10 / 1e1"), "g": F.lit(1.0), "b": F.lit(1.0)})
    return track_overlay(t, INSIDE, ["sink_id", "nstep"], width=3.0).select("px", "py", "r")


