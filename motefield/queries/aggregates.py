"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.functions.kernels import KERNELS
from motefield.operators import compare, framing, multigrid, ranges
from motefield.operators.camera import literal
from motefield.operators.neighbours import smoothing_lengths
from motefield.operators.ordering import numbered
from motefield.operators.raster import splat_raster
from motefield.operators.resolve import composite_joined, resolved
from motefield.operators.sightline import octave_histogram
from motefield.operators.splat import contributions, splat
from motefield.queries.base import (
    CAM, TILTED, block, ctes, framelog, lit, octaves, particle, query, sql_accum, sql_hits, sql_map,
)
from motefield.plans.snapshot import six_sums
from motefield.queries.fields import SIX, SPEC1, SPEC2, sql_composite, sql_levels
from motefield.queries.filters import sql_flat
from motefield.queries.joins import sql_upsample
from motefield.queries.scans import rounded
from motefield.sources.snapshot import union_parts

KEY = ["pid", "mass", "temperature"]


@query("e01_splat_accumulate", ctes("particle", more=sql_map(CAM, qty="temperature")) + """
SELECT px, py, round(num/1e5, 2) AS num, round(den, 2) AS den, round(sq/1e10, 2) AS sq FROM accum""")
def e01(spark, folder):
    a = splat(particle(spark, folder), CAM, qty="temperature")
    return a.select("px", "py", F.round(F.col("num") / 1e5, 2).alias("num"), F.round("den", 2).alias("den"), F.round(F.col("sq") / 1e10, 2).alias("sq"))


@query("e01_splat_raster", ctes("octaves", more=sql_map(TILTED, "octaves", qty="temperature")) + """
SELECT px, py, round(num/1e7, 2) AS num, round(den/1e2, 2) AS den, round(sq/1e12, 2) AS sq FROM accum""")
def e01_raster(spark, folder):
    """Lengths over seven octaves, discs from less than a pixel to the whole screen: sums on the grid inside the tasks."""
    a = splat_raster(octaves(spark, folder), TILTED, qty="temperature")
    return a.select("px", "py", F.round(F.col("num") / 1e7, 2).alias("num"), F.round(F.col("den") / 1e2, 2).alias("den"), F.round(F.col("sq") / 1e12, 2).alias("sq"))


def _kernel_query(kernel):
    @query(f"e01_splat_{kernel}", ctes("particle", more=sql_hits(TILTED, kernel=kernel) + "," + sql_accum()) + "SELECT px, py, round(den, 2) AS den FROM accum")
    def run(spark, folder):
        return splat(particle(spark, folder), TILTED, kernel=kernel).select("px", "py", F.round("den", 2).alias("den"))

    return run


for _k in KERNELS[1:]:
    _kernel_query(_k)


@query("e02_surface_density", ctes("particle", more=sql_map(CAM)) + "SELECT px, py, round(den, 2) AS density FROM accum WHERE den > 1e-30")
def e02(spark, folder):
    return resolved(splat(particle(spark, folder), CAM), 0).select("px", "py", F.round("value", 2).alias("density"))


@query("e03_weighted_average", ctes("particle", more=sql_map(CAM, qty="temperature")) + "SELECT px, py, round(num/den, 4) AS mean, round(den, 2) AS weight FROM accum WHERE den > 1e-30")
def e03(spark, folder):
    r = resolved(splat(particle(spark, folder), CAM, qty="temperature"), 1)
    return r.select("px", "py", F.round("value", 4).alias("mean"), F.round("weight", 2).alias("weight"))


@query("e04_weighted_deviation", ctes("particle", more=sql_map(CAM, qty="vx")) + """
SELECT px, py, round(sqrt(greatest(sq/den - num/den*(num/den), 0e0)), 3) AS deviation FROM accum WHERE den > 1e-30""")
def e04(spark, folder):
    r = resolved(splat(particle(spark, folder), CAM, qty="vx"), 2)
    return r.select("px", "py", F.round("value", 3).alias("deviation"))


@query("e03_average_missing_field", ctes("particle", more=sql_map(CAM, qty="(CASE WHEN ptype <> 1 THEN temperature END)")) + """
SELECT px, py, round(num/den, 4) AS mean, round(den, 2) AS weight FROM accum WHERE den > 1e-30""")
def e03_missing(spark, folder):
    """A union of parts of which one lacks the field: means are those of the rows that have it."""
    p = particle(spark, folder)
    pool = union_parts([p.where("ptype <> 1"), p.where("ptype = 1").drop("temperature")])
    r = resolved(splat(pool, CAM, qty="temperature"), 1)
    return r.select("px", "py", F.round("value", 4).alias("mean"), F.round("weight", 2).alias("weight"))


@query("e05_composite_map", ctes("particle", more=sql_hits(CAM, qty="temperature", keep="ptype") + "," + SIX.replace("ptype = 0", "ptype >= 0") + "," + sql_composite("six")))
def e05(spark, folder):
    """Two slots over one geometry: every splat is cut to pixels once and feeds six sums."""
    six = six_sums(particle(spark, folder), CAM, *[(F.col("mass"), F.col("temperature"))] * 2)
    return rounded(composite_joined(six, SPEC1, SPEC2), 6, "r", "g", "b").drop("a")


@query("e05_composite_missing_weight", ctes("particle", more=sql_hits(CAM, qty="temperature", keep="ptype") + "," + SIX.replace(
    "sum(sigma) AS den1", "sum(CASE WHEN ptype = 1 THEN sigma END) AS den1").replace("ptype = 0", "ptype >= 0") + "," + sql_composite("six")))
def e05_missing(spark, folder):
    """Only one part has the first slot's weight: pixels that only the others touch keep their colour."""
    p = particle(spark, folder).withColumn("weight", F.col("mass"))
    pool = union_parts([p.where("ptype = 1"), p.where("ptype <> 1").drop("weight")])
    six = six_sums(pool, CAM, (F.col("weight"), F.col("temperature")), (F.col("mass"), F.col("temperature")))
    return rounded(composite_joined(six, SPEC1, SPEC2), 6, "r", "g", "b").drop("a")


BOX = """box AS (SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM particle),
frame AS (SELECT *, sqrt((max_x-min_x)*(max_x-min_x)+(max_y-min_y)*(max_y-min_y)+(max_z-min_z)*(max_z-min_z)) AS extent FROM box)"""


@query("e06_bounding_box", ctes("particle", more=BOX) + """SELECT min_x, min_y, min_z, max_x, max_y, max_z, (min_x+max_x)/2 AS mid_x, (min_y+max_y)/2 AS mid_y,
(min_z+max_z)/2 AS mid_z, round(extent, 12) AS extent FROM frame""")
def e06(spark, folder):
    return rounded(framing.bounding_box(particle(spark, folder)), 12, "extent")


EVERY = """placed AS (SELECT *, row_number() OVER (ORDER BY pid, mass, temperature) - 1 AS pos, count(*) OVER () AS n FROM particle),
every AS (SELECT * FROM placed WHERE pos % (CASE WHEN n > 100 THEN greatest(n // 100, 1) ELSE 1 END) = 0)"""


def sql_median(axis, src, w="mass"):
    return f"""(SELECT min({axis}) FROM (SELECT {axis}, sum({w}) OVER (ORDER BY {axis} RANGE UNBOUNDED PRECEDING) AS upto FROM {src}) WHERE upto >= (SELECT sum({w})*0.5e0 FROM {src}))"""


@query("e07_weighted_median_sampled", ctes("particle", more=EVERY) + f"SELECT {sql_median('x', 'every')} AS x, {sql_median('y', 'every')} AS y, {sql_median('z', 'every')} AS z")
def e07(spark, folder):
    return framing.medians(framing.every_nth(particle(spark, folder), KEY))


@query("e07_weighted_median", ctes("particle") + f"SELECT {sql_median('x', 'particle')} AS x, {sql_median('y', 'particle')} AS y, {sql_median('z', 'particle')} AS z")
def e07_full(spark, folder):
    return framing.medians(particle(spark, folder))


@query("e08_camera_framing", ctes("particle", more=BOX) + f"""SELECT {sql_median('x', 'particle')} AS px, {sql_median('y', 'particle')} AS py, max_z AS pz,
round(extent/20, 12) AS speed, round(extent*1e-6, 15) AS near, round(extent*10, 10) AS far FROM frame""")
def e08(spark, folder):
    f = framing.frame(particle(spark, folder))
    return f.select("px", "py", "pz", F.round("speed", 12).alias("speed"), F.round("near", 15).alias("near"), F.round("far", 10).alias("far"))


@query("e09_level_ranges", ctes("octaves", more=sql_levels()) + """SELECT l::INTEGER AS level, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
FROM range(6) r(l) LEFT JOIN (SELECT level, count(*) AS n FROM levelled GROUP BY level) c ON c.level = l""")
def e09(spark, folder):
    return multigrid.level_ranges(multigrid.with_level(octaves(spark, folder), CAM))


@query("e09_level_scatter", ctes("octaves", more=sql_levels()) + "SELECT pid, level, row_number() OVER (ORDER BY level, pid, mass, temperature) - 1 AS pos FROM levelled")
def e09_scatter(spark, folder):
    """Contiguous index ranges per level: one global position, not one window per level."""
    rows = multigrid.with_level(octaves(spark, folder), CAM).withColumn(
        "slot", F.col("level").cast("decimal(17,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") + F.col("pid"))
    return numbered(rows.select("slot", "pid", "level", "mass", "temperature"), ["slot", "mass", "temperature"]).select("pid", "level", "pos")


# ---- ranges ----------------------------------------------------------------------------------


def sql_entropy(src, value="value", weight="weight"):
    """CTE ``best(lo, hi, entropy)`` for rows of ``src``."""
    return f"""wt AS (SELECT sum({weight}) AS total FROM {src}),
vals AS (SELECT {value} AS x, sum({weight}) AS w, min({weight}) AS wf FROM {src} GROUP BY {value}),
knot AS (SELECT x, (upto-w+wf)/total AS yl, upto/total AS yr FROM (SELECT *, sum(w) OVER (ORDER BY x) AS upto FROM vals), wt),
turn AS (SELECT c, min(v) AS vl, max(v) AS vr FROM (SELECT yl AS c, x AS v FROM knot UNION ALL SELECT yr, x FROM knot) GROUP BY c),
turned AS (SELECT c AS c0, vr AS v0, lead(c) OVER (ORDER BY c) AS c1, lead(vl) OVER (ORDER BY c) AS v1 FROM turn),
frac AS (SELECT k, CASE WHEN k < 32 THEN k*0.45e0/31 ELSE least(0.55e0 + (k-32)*0.45e0/31, 1e0) END AS f FROM range(64) r(k)),
lim AS (SELECT k, CASE WHEN t.c0 IS NULL THEN (SELECT min(x) FROM knot) WHEN t.c1 IS NULL THEN t.v0 ELSE t.v0 + (f-t.c0)*((t.v1-t.v0)/(t.c1-t.c0)) END AS v
  FROM frac ASOF LEFT JOIN turned t ON f >= t.c0),
edge AS (SELECT i.k AS i, j.k-32 AS j, i.v AS lo, j.v AS hi, t, i.v + t/128e0*(j.v-i.v) AS x FROM lim i, lim j, range(129) r(t) WHERE i.k < 32 AND j.k >= 32),
seg AS (SELECT x AS x0, yr AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(yl) OVER (ORDER BY x) AS y1 FROM knot),
cdf AS (SELECT i, j, lo, hi, t, CASE WHEN s.x0 IS NULL THEN (SELECT yl FROM knot ORDER BY x LIMIT 1) WHEN s.x1 IS NULL THEN s.y0 ELSE s.y0 + (e.x-s.x0)*((s.y1-s.y0)/(s.x1-s.x0)) END AS y
  FROM edge e ASOF LEFT JOIN seg s ON e.x >= s.x0),
prob AS (SELECT i, j, lo, hi, lead(y) OVER (PARTITION BY i, j ORDER BY t) - y + CASE WHEN t = 0 THEN y ELSE 0 END
  + CASE WHEN t = 127 THEN 1e0 - lead(y) OVER (PARTITION BY i, j ORDER BY t) ELSE 0 END AS p, t FROM cdf),
ent AS (SELECT i, j, any_value(lo) AS lo, any_value(hi) AS hi, sum(CASE WHEN p > 0 THEN -p*log2(p) ELSE 0 END) AS entropy FROM prob WHERE t < 128 GROUP BY i, j),
best AS (SELECT * FROM ent ORDER BY hi > lo DESC, round(entropy, 9) DESC, i, j LIMIT 1)"""


PIXELS = sql_map(CAM, qty="temperature") + ", px AS (SELECT px, py, den AS value, den AS weight FROM accum WHERE den > 1e-30)"


@query("e10_max_entropy_limits", ctes("particle", more=sql_entropy("particle", "temperature", "mass")) + "SELECT round(lo, 4) AS lo, round(hi, 4) AS hi FROM best")
def e10(spark, folder):
    return rounded(ranges.max_entropy_limits(particle(spark, folder), "temperature", "mass"), 4, "lo", "hi")


@query("e10_max_entropy_log", ctes("particle", more=PIXELS + ", lv AS (SELECT log10(value) AS value, weight FROM px WHERE value > 0)," + sql_entropy("lv")) +
       "SELECT round(pow(1e1, lo)/1e2, 3) AS lo, round(pow(1e1, hi)/1e2, 3) AS hi FROM best")
def e10_log(spark, folder):
    r = resolved(splat(particle(spark, folder), CAM), 0)
    lim = ranges.max_entropy_limits(r, "value", "weight", log=True)
    return lim.select(F.round(F.col("lo") / 1e2, 3).alias("lo"), F.round(F.col("hi") / 1e2, 3).alias("hi"))


@query("e11_order_statistics", ctes("particle") + """, r AS (SELECT vx, row_number() OVER (ORDER BY vx) - 1 AS k, count(*) OVER () AS n FROM particle)
SELECT max(CASE WHEN k = n // 100 THEN vx END) AS lo, max(CASE WHEN k = least(99*n // 100, n-1) THEN vx END) AS hi FROM r""")
def e11(spark, folder):
    return ranges.order_statistic_limits(particle(spark, folder), "vx")


@query("e12_auto_range", ctes("particle", more=PIXELS + ", lv AS (SELECT log10(value) AS value, weight FROM px WHERE value > 0)," + sql_entropy("lv")) + """,
shown AS (SELECT log10(greatest(pow(1e1, lo), 1e-30)) AS lo, log10(greatest(pow(1e1, hi), 1e-30)) AS hi FROM best)
SELECT round(CASE WHEN hi-lo < 0.1e0 THEN (lo+hi)/2-1 ELSE lo END, 7) AS lo, round(CASE WHEN hi-lo < 0.1e0 THEN (lo+hi)/2+1 ELSE hi END, 7) AS hi, true AS log FROM shown""")
def e12(spark, folder):
    return rounded(ranges.auto_range(splat(particle(spark, folder), CAM), 0, log=True), 7, "lo", "hi")


@query("e12_auto_range_signed", ctes("particle", more=sql_map(CAM, qty="vx")) + """, v AS (SELECT num/den AS value FROM accum WHERE den > 1e-30),
r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM v)
SELECT round(max(CASE WHEN k = n // 100 THEN value END), 6) AS lo, round(max(CASE WHEN k = least(99*n // 100, n-1) THEN value END), 6) AS hi, false AS log FROM r""")
def e12_signed(spark, folder):
    return rounded(ranges.auto_range(splat(particle(spark, folder), CAM, qty="vx"), 1, log=True), 6, "lo", "hi")


@query("e12_auto_range_color", ctes("particle", more=sql_map(CAM, qty="temperature") + ", px AS (SELECT num/den AS value, 1e0 AS weight FROM accum WHERE den > 1e-30)," + sql_entropy("px")) +
       "SELECT round(lo, 3) AS lo, round(hi, 3) AS hi, false AS log FROM best")
def e12_color(spark, folder):
    """Colour slot: every pixel counts the same, on a linear axis."""
    a = splat(particle(spark, folder), CAM, qty="temperature")
    return rounded(ranges.auto_range(a, 1, log=False, mass_weighted=False), 3, "lo", "hi")


SPOT = """spot AS (SELECT cx AS x, cy AS y, cz AS z, count(*) AS c FROM block GROUP BY 1, 2, 3),
pair AS (SELECT a.x, a.y, a.z, b.c, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM spot a, spot b),
step0 AS MATERIALIZED (SELECT x, y, z, 0e0 AS lo, 2e0 AS hi FROM spot)"""
_N = """32e0/3e0*sum(CASE WHEN d <= 0.5e0*m THEN c*(1e0 - 6e0*(d/m)*(d/m)*(1e0 - d/m)) WHEN d < m THEN c*2e0*(1e0-d/m)*(1e0-d/m)*(1e0-d/m) ELSE 0e0 END)"""


def sql_bisection(steps):
    """CTEs ``step0``..``step<n>``: halving over all pairs, by brute force."""
    return SPOT + "".join(f""", step{i} AS MATERIALIZED (SELECT x, y, z, CASE WHEN n >= 32 THEN lo ELSE m END AS lo, CASE WHEN n >= 32 THEN m ELSE hi END AS hi
FROM (SELECT p.x, p.y, p.z, any_value(lo) AS lo, any_value(hi) AS hi, any_value(m) AS m, {_N} AS n
FROM (SELECT *, (lo+hi)/2e0 AS m FROM step{i - 1}) s JOIN pair p USING (x, y, z) GROUP BY 1, 2, 3))""" for i in range(1, steps + 1))


@query("e13_smoothing_lengths", ctes("block", more=sql_bisection(40)) + "SELECT x, y, z, round((lo+hi)/2e0, 8) AS hsml FROM step40")
def e13(spark, folder):
    """The smoothing length of every block position, over all positions."""
    b = block(spark, folder).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return smoothing_lengths(b).withColumn("hsml", F.round("hsml", 8))


@query("e15_counts", ctes("particle") + "SELECT ptype, count(*) AS n, (SELECT count(*) FROM particle) AS total FROM particle GROUP BY ptype")
def e15(spark, folder):
    p = particle(spark, folder)
    return p.groupBy("ptype").agg(F.count(F.lit(1)).alias("n")).withColumn("total", p.agg(F.count(F.lit(1))).scalar())


@query("e16_octave_histogram", ctes("octaves") + """, low AS (SELECT min(hsml) AS h0 FROM octaves WHERE hsml > 0),
o AS (SELECT hsml, """ + " + ".join(f"CASE WHEN hsml/h0 >= {lit(2.0**k)} THEN 1 ELSE 0 END" for k in range(1, 12)) + """ AS octave FROM octaves, low WHERE hsml > 0)
SELECT octave, count(*) AS n, max(hsml) AS h_max FROM o GROUP BY octave""")
def e16(spark, folder):
    return octave_histogram(octaves(spark, folder))




@query("e17_compare_maps", ctes("particle", more=sql_map(CAM) + "," + sql_flat((0.5, 0.5, 0.5), 1.0, 128)) + """,
pair AS (SELECT a.den AS va, b.den AS vb FROM accum a FULL JOIN accumF b USING (px, py)),
logs AS (SELECT va, vb, CASE WHEN va > 0 AND vb > 0 THEN log10(va) END AS la, CASE WHEN va > 0 AND vb > 0 THEN log10(vb) END AS lb FROM pair)
SELECT round(sum(vb)/sum(va), 8) AS mass_ratio, count(la) AS overlap, round(corr(la, lb), 7) AS log_corr, round(quantile_cont(abs(la-lb), 0.5), 8) AS median_dlog FROM logs""")
def e17(spark, folder):
    p = particle(spark, folder)
    c = compare.compare_maps(splat(p, CAM), compare.flat_plane_density(p, (0.5, 0.5, 0.5), 1.0, 128))
    return c.select(F.round("mass_ratio", 8).alias("mass_ratio"), "overlap", F.round("log_corr", 7).alias("log_corr"), F.round("median_dlog", 8).alias("median_dlog"))


@query("e18_flat_plane_density", ctes("particle", more=sql_flat((0.5, 0.5, 0.5), 1.0, 128)) + "SELECT px, py, round(den, 2) AS den FROM accumF")
def e18(spark, folder):
    m = compare.flat_plane_density(particle(spark, folder), (0.5, 0.5, 0.5), 1.0, 128)
    return m.select("px", "py", F.round("den", 2).alias("den"))


STEP = "step AS (SELECT *, log2(greatest(ms/greatest(lag(ms) OVER (PARTITION BY run ORDER BY frame), 1e0), 1e-9)) AS step FROM framelog)"
# lag is null on each run's first frame; greatest must not turn that into a value
STEP = STEP.replace("log2(greatest(ms/greatest(lag(ms) OVER (PARTITION BY run ORDER BY frame), 1e0), 1e-9))",
                    "CASE WHEN lag(ms) OVER w IS NOT NULL THEN log2(greatest(ms/greatest(lag(ms) OVER w, 1e0), 1e-9)) END").replace("FROM framelog)", "FROM framelog WINDOW w AS (PARTITION BY run ORDER BY frame))")


@query("e19_frame_summary", ctes("framelog", more=STEP) + """SELECT run, count(*) AS frames, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, round(stddev_pop(ms), 6) AS std,
round(quantile_cont(ms, 0.05), 6) AS p5, round(quantile_cont(ms, 0.95), 6) AS p95, round(stddev_pop(step), 6) AS step_std FROM step GROUP BY run""")
def e19(spark, folder):
    return rounded(compare.summarize(framelog(spark, folder)), 6, "mean", "median", "std", "p5", "p95", "step_std")


@query("e20_sweep_summary", ctes("framelog") + """, per AS (SELECT run, avg(ms) AS mean, median(ms) AS median, sum(ms) AS total, count(*) AS frames FROM framelog GROUP BY run)
SELECT run, round(mean, 6) AS mean, round(median, 6) AS median, round(total, 4) AS total, frames, round(first_value(mean) OVER (ORDER BY run)/mean, 8) AS speedup FROM per""")
def e20(spark, folder):
    return rounded(rounded(rounded(compare.sweep(framelog(spark, folder)), 6, "mean", "median"), 4, "total"), 8, "speedup")


def _pyramid():
    """SQL twin of the multigrid map: one splat per level, folded from the coarsest."""
    n, text = multigrid.LEVELS, [sql_levels()]
    dims = [(multigrid.grid_size(CAM.width, k), multigrid.grid_size(CAM.height, k)) for k in range(n)]
    for k, (w, h) in enumerate(dims):
        text.append(f"src{k} AS (SELECT * EXCLUDE (depth, right_d, up_d) FROM levelled WHERE level = {k})")
        text.append(sql_map(CAM, f"src{k}", f"L{k}", width=str(w), height=str(h)))
    text.append(f"fold{n - 1} AS (SELECT * FROM accumL{n - 1})")
    for k in range(n - 1, 0, -1):
        text.append(sql_upsample(f"fold{k}", *dims[k], *dims[k - 1], f"U{k}"))
        text.append(f"fold{k - 1} AS (SELECT px, py, sum(num) AS num, sum(den) AS den, sum(sq) AS sq FROM (SELECT * FROM accumL{k - 1} UNION ALL SELECT * FROM upU{k}) GROUP BY px, py)")
    return ",\n".join(text)


@query("e01_splat_multigrid", ctes("octaves", more=_pyramid()) + "SELECT px, py, round(den, 2) AS den FROM fold0")
def e01_multigrid(spark, folder):
    return multigrid.splat_multigrid(octaves(spark, folder), CAM).select("px", "py", F.round("den", 2).alias("den"))
