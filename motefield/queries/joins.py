"""Joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motefield.operators.camera import fields_of, orbit_path, zoom_path
from motefield.operators.column_store import columns_kept
from motefield.operators.flight import fan_out_seen
from motefield.operators.multigrid import upsample
from motefield.operators.neighbours import nearest
from motefield.operators.overlay import slots
from motefield.operators.resolve import composite
from motefield.operators.sightline import columns, columns_for_path
from motefield.operators.splat import accumulate, contributions, splat
from motefield.queries.base import CAM, TILTED, block, ctes, lit, octaves, particle, query, sql_map, star, track
from motefield.queries.fields import SPEC1, SPEC2, sql_composite
from motefield.queries.filters import sql_sightline
from motefield.queries.scans import rounded
from motefield.session import shared_folder
from motefield.sources.snapshot import LABELS

GAS_KEY = ["pid", "mass", "temperature"]


@query("d01_sightline_columns", ctes("particle", "star", more=sql_sightline("particle", "star", TILTED.position)) + 'SELECT sid, round(total, 2) AS "column", n_gas FROM sight')
def d01(spark, folder):
    c = columns(particle(spark, folder), star(spark, folder), TILTED.position, key=GAS_KEY)
    return c.select("sid", F.round("column", 2).alias("column"), "n_gas")


@query("d02_sightline_octaves", ctes("octaves", "star", more=sql_sightline("octaves", "star", (0.5, 0.45, 0.55))) + 'SELECT sid, round(total, 2) AS "column", n_gas FROM sight')
def d02(spark, folder):
    """Seven octaves of smoothing length, and a camera inside the gas."""
    c = columns(octaves(spark, folder), star(spark, folder), (0.5, 0.45, 0.55), key=GAS_KEY)
    return c.select("sid", F.round("column", 2).alias("column"), "n_gas")


PATH = [(0.5, 0.5, 1.5), (0.5, 0.5, 1.5), (1.4, 1.2, 1.6)]


@query("d03_columns_per_position", ctes("particle", "star", more=sql_sightline("particle", "star", PATH[0], "0") + "," + sql_sightline("particle", "star", PATH[2], "2")) + """
SELECT c.i AS cam_id, sid, round(total, 2) AS "column" FROM (VALUES (0), (1)) c(i), sight0 UNION ALL SELECT 2, sid, round(total, 2) FROM sight2""")
def d03(spark, folder):
    c = columns_for_path(particle(spark, folder), star(spark, folder), PATH, key=GAS_KEY)
    return c.select("cam_id", "sid", F.round("column", 2).alias("column"))


TURNS = [*PATH, (0.3, 0.4, 1.2), PATH[2]]


@query("d03_kept_columns", ctes("particle", "star", more=",".join(sql_sightline("particle", "star", TURNS[i], str(i)) for i in (0, 2, 3))) + " UNION ALL ".join(
    f'SELECT {i} AS cam_id, sid, round(total, 2) AS "column", n_gas FROM sight{j}' for i, j in enumerate((0, 0, 2, 3, 2))))
def d03_kept(spark, folder):
    """A path in two calls: the second computes the one position that the first did not have."""
    store, now = f"{shared_folder(spark)}/columns-{uuid.uuid4().hex}", (particle(spark, folder), star(spark, folder))
    columns_kept(store, "sf", *now, PATH, key=GAS_KEY)
    c = columns_kept(store, "sf", *now, TURNS, key=GAS_KEY)
    return c.select("cam_id", "sid", F.round("column", 2).alias("column"), "n_gas")


def _knn_sql(k, period):
    gap = "abs(a.{0}-b.{0})" if period is None else f"least(abs(a.{{0}}-b.{{0}}), {lit(period)}-abs(a.{{0}}-b.{{0}}))"
    d2 = "+".join(f"{gap.format(a)}*{gap.format(a)}" for a in "xyz")
    return f"""spot AS (SELECT DISTINCT cx AS x, cy AS y, cz AS z FROM block), every AS (SELECT cx AS x, cy AS y, cz AS z FROM block),
near AS (SELECT a.x, a.y, a.z, sqrt({d2}) AS d, row_number() OVER (PARTITION BY a.x, a.y, a.z ORDER BY {d2}) AS rn FROM spot a, every b)
SELECT x, y, z, rn::INTEGER AS rank, round(d, 9) AS d FROM near WHERE rn <= {k}"""


def _knn(df, k, period):
    n = nearest(df.select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), k, period)
    return n.select("x", "y", "z", F.posexplode("distances").alias("rank", "d")).select(
        "x", "y", "z", (F.col("rank") + 1).alias("rank"), F.round("d", 9).alias("d"))


@query("d04_knn", ctes("block", more=_knn_sql(50, None)))
def d04(spark, folder):
    return _knn(block(spark, folder), 50, None)


@query("d04_knn_periodic", ctes("block", more=_knn_sql(20, 1.0)))
def d04_periodic(spark, folder):
    return _knn(block(spark, folder), 20, 1.0)


@query("d06_composite_join", ctes("particle", more="gas AS (SELECT * FROM particle WHERE ptype IN (0, 2, 4)), rest AS (SELECT * FROM particle WHERE ptype NOT IN (0, 2, 4))," +
       sql_map(CAM, "gas", "1", qty="temperature") + "," + sql_map(CAM, "rest", "2", qty="temperature") + """,
six AS (SELECT px, py, a.num AS num1, a.den AS den1, a.sq AS sq1, b.num AS num2, b.den AS den2, b.sq AS sq2 FROM accum1 a FULL JOIN accum2 b USING (px, py)),""" +
       sql_composite("six")))
def d06(spark, folder):
    p = particle(spark, folder)
    light = F.col("ptype").isin(0, 2, 4)
    a, b = (splat(p.where(part), CAM, qty="temperature") for part in (light, ~light))
    return rounded(composite(a, b, CAM, SPEC1, SPEC2), 6, "r", "g", "b").drop("a")


@query("d07_label_join", ctes("particle") + """SELECT label, count(*) AS n, round(sum(mass), 2) AS mass FROM particle
JOIN (VALUES (0, 'gas'), (1, 'halo'), (2, 'disk'), (3, 'bulge'), (4, 'stars'), (5, 'sinks')) l(ptype, label) USING (ptype) GROUP BY label""")
def d07(spark, folder):
    names = spark.createDataFrame(list(LABELS.items()), "ptype int, label string")  # six rows
    return particle(spark, folder).join(F.broadcast(names), "ptype").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 2).alias("mass"))


@query("d08_track_slots", ctes("track") + """, ids AS (SELECT sink_id, row_number() OVER (ORDER BY sink_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sink_id FROM track)),
slot AS (SELECT s AS slot, CASE WHEN s = 1 THEN 17 WHEN s = 3 THEN -5 ELSE sink_id END AS sink_id FROM range(200) r(s) JOIN ids ON i = s % n)
SELECT slot::INTEGER AS slot, sink_id, count(*) AS points FROM slot JOIN track USING (sink_id) GROUP BY slot, sink_id""")
def d08(spark, folder):
    s = slots(track(spark, folder), 200, {1: 17, 3: -5})
    return s.groupBy("slot", "sink_id").agg(F.count(F.lit(1)).alias("points"))


@query("d09_star_field_choice", ctes("star") + "SELECT sid, mass AS size, sqrt(vx*vx+vy*vy+vz*vz) AS color FROM star")
def d09(spark, folder):
    from motefield.operators.overlay import star_field

    s = star(spark, folder).withColumn("Speed", F.sqrt(F.expr("vx*vx + vy*vy + vz*vz")))
    return s.select("sid", star_field(s, "StellarAge", F.col("mass")).alias("size"), star_field(s, "Speed", F.col("mass")).alias("color"))


def _path_query(name, path):
    parts = [sql_map(c, tag=str(i)) for i, c in enumerate(path)]
    select = " UNION ALL ".join(f"SELECT {i} AS cam_id, px, py, round(den/1e2, 2) AS den FROM accum{i}" for i in range(len(path)))

    @query(name, ctes("particle", more=",".join(parts)) + select)
    def run(spark, folder):
        frames = fan_out_seen(particle(spark, folder), path)
        cam = fields_of()
        frames = frames.withColumn("cam_id", F.col("cam.cam_id"))
        hits = contributions(frames, cam, F.col("mass"), F.col("hsml"), keep=["cam_id"], width=F.lit(path[0].width), height=F.lit(path[0].height), carry=["cam"])
        a = accumulate(hits, ["cam_id", "px", "py"], with_qty=False)
        return a.select("cam_id", "px", "py", F.round(F.col("den") / 1e2, 2).alias("den"))

    return run


_SMALL = type(CAM)((0.5, 0.5, 1.5), fov=60.0, width=64, height=48)
_path_query("d10_zoom_path", zoom_path(_SMALL, (0.5, 0.5, 0.5), 5, 0.5, 1.0, 0.2))
_NARROW = [type(CAM)((0.5, 0.5, 0.5), forward=f, fov=20.0, far=0.4, width=48, height=32) for f in ((1.0, 0.2, 0.1), (-1.0, 0.3, 0.0), (0.1, 0.2, 1.0), (0.3, -0.9, 0.2))]
_path_query("d10_narrow_path", _NARROW)
_path_query("d10_orbit_path", orbit_path(_SMALL, (0.5, 0.5, 0.5), 5, 4.0, 6.0, 0.8, 2.0, 1))


def sql_upsample(src, cw, ch, fw, fh, tag):
    """CTE ``up<tag>``: bilinear samples of ``src`` on a finer grid, missing pixels 0, edges clamped."""
    axis = lambda a, c, f: f"(({a}+0.5e0)*{lit(c / f)}-0.5e0)"
    cl = lambda e, c: f"greatest(0, least({c - 1}, {e}))::INTEGER"
    x, y = axis("px", cw, fw), axis("py", ch, fh)
    cases = " UNION ALL ".join(
        f"SELECT px, py, {cl(f'floor({x})+{i}', cw)} AS sx, {cl(f'floor({y})+{j}', ch)} AS sy, "
        f"{'(' + x + '-floor(' + x + '))' if i else '(1e0-(' + x + '-floor(' + x + ')))'}*{'(' + y + '-floor(' + y + '))' if j else '(1e0-(' + y + '-floor(' + y + ')))'} AS w FROM fine{tag}"
        for i in (0, 1) for j in (0, 1))
    return f"""fine{tag} AS (SELECT (i % {fw})::INTEGER AS px, (i // {fw})::INTEGER AS py FROM range({fw * fh}) t(i)), read{tag} AS ({cases}),
up{tag} AS (SELECT r.px, r.py, sum(w*num) AS num, sum(w*den) AS den, sum(w*sq) AS sq FROM read{tag} r JOIN {src} s ON s.px = r.sx AND s.py = r.sy WHERE w > 0 GROUP BY r.px, r.py)"""


_COARSE = type(CAM)((0.5, 0.5, 1.5), width=50, height=37)


@query("d11_upsample", ctes("particle", more=sql_map(_COARSE, qty="temperature") + "," + sql_upsample("accum", 50, 37, 100, 75, "")) +
       "SELECT px, py, round(num/1e6, 3) AS num, round(den/1e2, 3) AS den, round(sq/1e10, 3) AS sq FROM up")
def d11(spark, folder):
    u = upsample(splat(particle(spark, folder), _COARSE, qty="temperature"), (50, 37), (100, 75))
    return u.select("px", "py", F.round(F.col("num") / 1e6, 3).alias("num"), F.round(F.col("den") / 1e2, 3).alias("den"),
                    F.round(F.col("sq") / 1e10, 3).alias("sq"))
