"""Window functions, sorts, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.functions import fields
from motefield.functions.fields import FieldSpec
from motefield.operators import ordering, ranges, sampling
from motefield.operators.compare import step_ratios
from motefield.operators.neighbours import nearest
from motefield.operators.overlay import segments
from motefield.operators.camera import literal
from motefield.operators.splat import accumulate, contributions
from motefield.queries.aggregates import EVERY, KEY, STEP, sql_entropy
from motefield.queries.base import CAM, ctes, framelog, particle, query, raw, sql_accum, sql_hits, star, track
from motefield.queries.fields import snapshot_rows
from motefield.queries.filters import sql_segments
from motefield.queries.scans import rounded
from motefield.sources import snapshot
from motefield.operators.framing import every_nth

# ---- windows ---------------------------------------------------------------------------------


@query("f01_running_weight", ctes("particle") + """SELECT temperature AS v, round(sum(mass), 3) AS w, min(mass) AS w_first, count(*) AS n,
round(sum(sum(mass)) OVER (ORDER BY temperature) - sum(mass), 3) AS before FROM particle GROUP BY temperature""")
def f01(spark, folder):
    return rounded(ordering.value_cdf(particle(spark, folder), "temperature", "mass"), 3, "w", "before")


@query("f02_exclusive_prefix", """WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type)
SELECT p_brand, p_type, n, coalesce(sum(n) OVER (PARTITION BY p_brand ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM t""")
def f02(spark, folder):
    from pyspark.sql import Window

    t = raw(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("p_brand").orderBy("p_type").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))


@query("f03_track_segments", ctes("track", more=sql_segments()) + "SELECT * FROM seg")
def f03(spark, folder):
    return segments(track(spark, folder))


@query("f04_interpolation", ctes("particle") + """, knot AS (SELECT ms AS x, min(frame)/1e0 AS y FROM (SELECT value AS ms, event_id AS frame FROM events) GROUP BY ms),
seg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM knot)
SELECT pid, round(CASE WHEN x0 IS NULL THEN (SELECT y FROM knot ORDER BY x LIMIT 1) WHEN x1 IS NULL THEN y0 ELSE y0 + (p.t-x0)*((y1-y0)/(x1-x0)) END, 5) AS y
FROM (SELECT pid, temperature/2e2 AS t FROM particle) p ASOF LEFT JOIN seg ON p.t >= x0""")
def f04(spark, folder):
    knots = framelog(spark, folder).groupBy(F.col("ms").alias("x")).agg((F.min("frame") / 1.0).alias("yl")).withColumn("yr", F.col("yl"))
    probes = particle(spark, folder).select("pid", (F.col("temperature") / 2e2).alias("x"))
    return ordering.interpolate(knots, probes).select("pid", F.round("y", 5).alias("y"))


@query("f05_step_ratio", ctes("framelog", more=STEP) + "SELECT run, frame, round(step, 8) AS step FROM step")
def f05(spark, folder):
    return step_ratios(framelog(spark, folder)).select("run", "frame", F.round("step", 8).alias("step"))


@query("f06_every_nth", ctes("particle", more=EVERY) + "SELECT pid, x, y, z FROM every")
def f06(spark, folder):
    return every_nth(particle(spark, folder), KEY).select("pid", "x", "y", "z")


# ---- sorts and sampling ----------------------------------------------------------------------


def sql_u(seed=0):
    return f"(('0x' || substr(md5(pid::VARCHAR || ':{seed}'), 1, 12))::BIGINT / 281474976710656e0)"


@query("g01_exact_subset", ctes("particle") + f"SELECT pid, mass FROM particle ORDER BY {sql_u(3)}, pid LIMIT 7777")
def g01(spark, folder):
    return sampling.subset(particle(spark, folder).select("pid", "mass"), "pid", 7777, seed=3)


@query("g01_fraction", ctes("particle") + f"SELECT pid, round(mass*4e0, 6) AS mass, round(hsml*cbrt(4e0), 9) AS hsml FROM particle WHERE {sql_u()} < 0.25e0")
def g01_fraction(spark, folder):
    p = sampling.fraction(particle(spark, folder), "pid", 0.25)
    m, h = sampling.rescale(F.col("mass"), F.col("hsml"), 4.0)
    return p.select("pid", F.round(m, 6).alias("mass"), F.round(h, 9).alias("hsml"))


SMALL = type(CAM)((0.5, 0.5, 1.5), width=48, height=48)


@query("g02_refinement", ctes("particle").replace("WITH ", "WITH RECURSIVE ") + f""", sizes AS (SELECT 0 AS level, least(1000, count(*)) AS k, count(*) AS n FROM particle
  UNION ALL SELECT level + 1, least(floor(k*1.4e0)::BIGINT + 1, n), n FROM sizes WHERE k < n),
leveled AS (SELECT p.*, level, n/(k*1e0) AS stride FROM (SELECT *, {sql_u()} AS u FROM particle) p JOIN sizes s ON p.u < s.k/(s.n*1e0)),
{sql_hits(SMALL, "leveled", mass="mass*stride", hsml="hsml*cbrt(stride)", keep="level")},
{sql_accum(keep="level")} SELECT level::INTEGER AS level, px, py, round(den/1e2, 2) AS den FROM accum""")
def g02(spark, folder):
    """One map per refinement level, all from one pass."""
    p = particle(spark, folder)
    rows = sampling.refinement_levels(p, "pid", sampling.refinement_sizes(p.count()))
    m, h = sampling.rescale(F.col("mass"), F.col("hsml"), F.col("stride"))
    a = accumulate(contributions(rows, literal(SMALL), m, h, keep=["level"]), ["level", "px", "py"], with_qty=False)
    return a.select("level", "px", "py", F.round(F.col("den") / 1e2, 2).alias("den"))


@query("g03_range_on_sample", ctes("particle", more=f"pick AS (SELECT temperature, mass FROM particle ORDER BY {sql_u()}, pid LIMIT 20000)," + sql_entropy("pick", "temperature", "mass")) +
       "SELECT round(lo, 4) AS lo, round(hi, 4) AS hi FROM best")
def g03(spark, folder):
    """The range search on a seeded subset; the full search (e10) is the default."""
    return rounded(ranges.max_entropy_limits(sampling.subset(particle(spark, folder), "pid", 20000), "temperature", "mass"), 4, "lo", "hi")


@query("g04_sorted_fields", ctes("particle") + """SELECT name, row_number() OVER (ORDER BY name <> 'Masses', name) AS pos, n FROM (
  VALUES ('Masses'), ('Coordinates'), ('KernelMaxRadius'), ('Temperature'), ('Velocities'), ('pid'), ('ptype')) f(name), (SELECT count(*) AS n FROM particle)""")
def g04(spark, folder):
    from pyspark.sql import Window

    p = snapshot_rows(spark, folder)
    names = snapshot.field_names(p).withColumn("n", p.agg(F.count(F.lit(1))).scalar())
    pos = F.row_number().over(Window.orderBy(F.col("name") != "Masses", "name"))  # one row per column
    return names.withColumn("pos", pos.cast("long"))


@query("g05_entropy_argmax", ctes("particle", more=sql_entropy("particle", "vz", "mass")) + "SELECT i::INTEGER AS i, j::INTEGER AS j, round(lo, 6) AS lo, round(hi, 6) AS hi, round(entropy, 8) AS entropy FROM best")
def g05(spark, folder):
    table = ranges.entropy_table(ranges.checkpoint(ranges.cdf_knots(particle(spark, folder), "vz", "mass")))
    best = table.agg(F.max_by(F.struct("i", "j", "lo", "hi", "entropy"), F.struct(F.col("hi") > F.col("lo"), F.round("entropy", 9), -F.col("i"), -F.col("j"))).alias("b"))
    return rounded(rounded(best.select("b.*"), 6, "lo", "hi"), 8, "entropy")


@query("g06_nearest_five", ctes("star") + """, near AS (SELECT a.sid, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM star a, star b),
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY d) AS rank FROM near) SELECT sid, rank::INTEGER AS rank, round(d, 9) AS d FROM r WHERE rank <= 5""")
def g06(spark, folder):
    s = star(spark, folder)
    n = nearest(s.select("x", "y", "z"), 5).join(s.select("sid", "x", "y", "z"), ["x", "y", "z"])
    return n.select("sid", F.posexplode("distances").alias("rank", "d")).select("sid", (F.col("rank") + 1).alias("rank"), F.round("d", 9).alias("d"))


@query("g06_part_order", """SELECT row_number() OVER (ORDER BY part) AS pos, part, n FROM (SELECT user_id AS part, count(*) AS n FROM events GROUP BY user_id)""")
def g06_order(spark, folder):
    """Numeric order of part numbers taken from file names (text order would put 10 before 2)."""
    name = F.concat(F.lit("snap."), F.col("user_id"), F.lit(".parquet"))
    part = F.regexp_extract(name, snapshot.PART, 1).cast("long")
    parts = track(spark, folder).withColumnRenamed("sink_id", "user_id").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return ordering.numbered(parts, ["part"]).withColumn("pos", F.col("pos") + 1)


# ---- set operations --------------------------------------------------------------------------


@query("h01_pool", ctes("particle") + """SELECT ptype, count(*) AS n, round(sum(mass), 2) AS mass, round(sum(hsml), 6) AS hsml, round(sum(x), 6) AS x FROM (
  SELECT ptype, x, mass, CASE WHEN ptype = 0 THEN hsml ELSE 0.04e0 END AS hsml FROM particle WHERE ptype IN (0, 4)) GROUP BY ptype""")
def h01(spark, folder):
    p = snapshot_rows(spark, folder)
    groups = {t: p.where(F.col("ptype") == t).drop(*(["KernelMaxRadius"] if t else [])) for t in range(6)}
    pool = snapshot.pool(groups, [0, 4, 7], {"SofteningType4": 0.04})
    return pool.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 2).alias("mass"),
                                     F.round(F.sum("hsml"), 6).alias("hsml"), F.round(F.sum("x"), 6).alias("x"))


def present(spark, folder):
    """Field names present per user: a name counts for a user if any event carries it."""
    return raw(spark, folder, "events").select(F.col("user_id").alias("ptype"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("name"))


NAMES = "names AS (SELECT user_id AS ptype, event_type || (event_id % 7)::VARCHAR AS name FROM events)"


@query("h02_common_fields", f"WITH {NAMES} SELECT name FROM names GROUP BY name HAVING count(DISTINCT ptype) = (SELECT count(DISTINCT ptype) FROM names) UNION SELECT 'Masses'")
def h02(spark, folder):
    """Names every type has: the intersection over all types, without folding a list per type."""
    n = present(spark, folder).distinct()
    every = n.agg(F.count_distinct("ptype")).scalar()
    common = n.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == every).select("name")
    return common.union(spark.createDataFrame([("Masses",)], "name string")).distinct()


@query("h03_union_names", f"WITH {NAMES} SELECT name FROM names UNION SELECT p_type FROM part")
def h03(spark, folder):
    return present(spark, folder).select("name").union(raw(spark, folder, "part").select(F.col("p_type").alias("name"))).distinct()


@query("h04_except_consumed", f"WITH {NAMES} SELECT DISTINCT name FROM names WHERE name NOT LIKE 'click%' AND name NOT IN (SELECT event_type || '3' FROM events)")
def h04(spark, folder):
    used = raw(spark, folder, "events").select(F.concat("event_type", F.lit("3")).alias("name"))
    return present(spark, folder).where("name NOT LIKE 'click%'").select("name").subtract(used)


@query("h05_toggle_type", ctes("particle") + "SELECT ptype, round(sum(mass), 2) AS weight, count(*) AS n FROM particle WHERE ptype IN (0, 3) GROUP BY ptype")
def h05(spark, folder):
    """Toggling types 4 and 3 in the selection 0, 4; a weight that is gone falls back to the mass."""
    p = snapshot_rows(spark, folder)
    chosen = fields.toggle_type(fields.toggle_type([0, 4], 4), 3)
    have = fields.common_fields([fields.scalar_fields(p)])
    spec = fields.reset_missing(FieldSpec(weight="Metallicity", weight2="Pressure"), have)
    w, _ = fields.single_field(p, spec)
    return snapshot.select_types(p.withColumn("w", w), chosen).groupBy("ptype").agg(F.round(F.sum("w"), 2).alias("weight"), F.count(F.lit(1)).alias("n"))


