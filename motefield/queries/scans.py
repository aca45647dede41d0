"""Scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motefield.functions.color import RAMPS, lookup
from motefield.functions.photometry import cluster_size_luminosity
from motefield.operators.resolve import colored, dense
from motefield.operators.splat import splat
from motefield.queries.base import CAM, block, ctes, events_as_lines, lit, particle, query, raw, sql_map, star
from motefield.session import shared_folder, spread
from motefield.sources import catalog, mesh, snapshot, tracks

# ---- parts and layout ------------------------------------------------------------------------


@query("a01_multi_part_scan", ctes("particle") + """
SELECT (CASE ptype % 3 WHEN 2 THEN 10 ELSE ptype % 3 END)::INTEGER AS part_no, ptype, count(*) AS n, round(sum(mass), 3) AS mass,
  count(CASE WHEN ptype % 3 <> 1 THEN temperature END) AS n_temperature FROM particle GROUP BY ptype""")
def a01(spark, folder):
    """Parts 0, 1 and 10 written by the query; part 1 lacks a column. Any one part stands for all."""
    p, path = particle(spark, folder), f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    for k, no in enumerate((0, 1, 10)):
        part = p.where(p.ptype % 3 == k)
        (part.drop("temperature") if no == 1 else part).write.parquet(f"{path}/snap.{no}.parquet")
    parts = snapshot.read_parts(spark, f"{path}/snap.1.parquet")
    return parts.groupBy("part_no", "ptype").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("mass"), 3).alias("mass"), F.count("temperature").alias("n_temperature"))


@query("a02_union_parts", ctes("particle") + """
SELECT part_no, count(*) AS n, count(temperature) AS n_temperature, count(hsml) AS n_hsml, round(sum(mass), 3) AS mass FROM (
  SELECT 0 AS part_no, pid, mass, hsml, NULL AS temperature FROM particle WHERE ptype < 3
  UNION ALL SELECT 1, pid, mass, NULL, temperature FROM particle WHERE ptype >= 3) GROUP BY part_no""")
def a02(spark, folder):
    p = particle(spark, folder)
    parts = [p.where("ptype < 3").select("pid", "mass", "hsml"), p.where("ptype >= 3").select("pid", "mass", "temperature")]
    return snapshot.union_parts(parts).groupBy("part_no").agg(
        F.count(F.lit(1)).alias("n"), F.count("temperature").alias("n_temperature"), F.count("hsml").alias("n_hsml"),
        F.round(F.sum("mass"), 3).alias("mass"),
    )


@query("a03_layout", """
SELECT 'faces' AS layout, count(*) AS n FROM part UNION ALL SELECT 'amr', count(*) FROM part
UNION ALL SELECT 'particles', count(*) FROM lineitem UNION ALL SELECT 'catalog', count(*) FROM supplier""")
def a03(spark, folder):
    found = [faces(spark, folder), amr(spark, folder), particle(spark, folder).select(F.array("x", "y", "z").alias("Coordinates")),
             star(spark, folder)]
    out = None
    for df in found:
        row = df.agg(F.lit(snapshot.layout(df.columns)).alias("layout"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("a20_types", ctes("particle") + """
SELECT ptype, count(*) AS n, CASE ptype WHEN 0 THEN 'gas' WHEN 1 THEN 'halo' WHEN 2 THEN 'disk' WHEN 3 THEN 'bulge'
  WHEN 4 THEN 'stars' ELSE 'sinks' END AS label, ptype = 0 AS selected FROM particle GROUP BY ptype""")
def a20(spark, folder):
    return snapshot.types(particle(spark, folder))


# ---- blocks with face arrays -----------------------------------------------------------------

SHAPE = (4, 4, 2)
FACE_VARS = {v: ("prim", i) for i, v in enumerate(["rho", "press", "vel1", "vel2", "vel3"])}


def faces(spark, folder):
    return spread(raw(spark, folder, "part")).selectExpr(
        "p_partkey AS block_id",
        "CASE p_size % 3 WHEN 0 THEN 'cartesian' WHEN 1 THEN 'cylindrical' ELSE 'spherical_polar' END AS system",
        "transform(sequence(0, 4), i -> 1e0 + (p_partkey % 7)/8e0 + i/16e0) AS x1f",
        "transform(sequence(0, 4), i -> 3e-1 + (p_partkey % 5)/1e1 + i/8e0) AS x2f",
        "transform(sequence(0, 2), i -> (p_partkey % 3)/4e0 + i/4e0) AS x3f",
        "transform(sequence(0, 4), v -> transform(sequence(0, 31), c -> ((p_partkey*31 + (v*32 + c)*17) % 101 + 1)/1e1)) AS prim",
    )


def _var(v):
    return f"((p_partkey*31 + ({v}*32 + c)*17) % 101 + 1)/1e1"


FACE_CELLS = f"""WITH cell AS (SELECT p_partkey AS block_id, p_partkey, p_size, unnest(range(32)) AS c FROM part),
face AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'cartesian' WHEN 1 THEN 'cylindrical' ELSE 'spherical_polar' END AS system,
  1e0 + (p_partkey % 7)/8e0 + (c % 4)/16e0 AS lo1, 1e0 + (p_partkey % 7)/8e0 + (c % 4 + 1)/16e0 AS hi1,
  3e-1 + (p_partkey % 5)/1e1 + (c // 4 % 4)/8e0 AS lo2, 3e-1 + (p_partkey % 5)/1e1 + (c // 4 % 4 + 1)/8e0 AS hi2,
  (p_partkey % 3)/4e0 + (c // 16)/4e0 AS lo3, (p_partkey % 3)/4e0 + (c // 16 + 1)/4e0 AS hi3 FROM cell),
mid AS (SELECT block_id, system, c::INTEGER AS cell, 0.5e0*(lo1+hi1) AS c1, 0.5e0*(lo2+hi2) AS c2, 0.5e0*(lo3+hi3) AS c3,
  hi1-lo1 AS d1, hi2-lo2 AS d2, hi3-lo3 AS d3, {_var(0)} AS rho, {_var(1)} AS press, {_var(2)} AS vel1, {_var(3)} AS vel2,
  {_var(4)} AS vel3 FROM face),
pos AS (SELECT *, CASE system WHEN 'cylindrical' THEN c1*cos(c2) WHEN 'cartesian' THEN c1 ELSE c1*sin(c2)*cos(c3) END AS x,
  CASE system WHEN 'cylindrical' THEN c1*sin(c2) WHEN 'cartesian' THEN c2 ELSE c1*sin(c2)*sin(c3) END AS y,
  CASE system WHEN 'cylindrical' THEN c3 WHEN 'cartesian' THEN c3 ELSE c1*cos(c2) END AS z,
  CASE system WHEN 'cylindrical' THEN 0.5e0*((c1+0.5e0*d1)*(c1+0.5e0*d1)-(c1-0.5e0*d1)*(c1-0.5e0*d1))*d2*d3
    WHEN 'cartesian' THEN d1*d2*d3
    ELSE ((c1+0.5e0*d1)*(c1+0.5e0*d1)*(c1+0.5e0*d1)-(c1-0.5e0*d1)*(c1-0.5e0*d1)*(c1-0.5e0*d1))/3e0
      *(cos(c2-0.5e0*d2)-cos(c2+0.5e0*d2))*d3 END AS volume FROM mid),
vel AS (SELECT *, CASE system WHEN 'cylindrical' THEN vel1*cos(c2)-vel2*sin(c2) WHEN 'cartesian' THEN vel1
    ELSE vel1*sin(c2)*cos(c3)+vel2*cos(c2)*cos(c3)-vel3*sin(c3) END AS vx,
  CASE system WHEN 'cylindrical' THEN vel1*sin(c2)+vel2*cos(c2) WHEN 'cartesian' THEN vel2
    ELSE vel1*sin(c2)*sin(c3)+vel2*cos(c2)*sin(c3)+vel3*cos(c3) END AS vy,
  CASE system WHEN 'cylindrical' THEN vel3 WHEN 'cartesian' THEN vel3 ELSE vel1*cos(c2)-vel2*sin(c2) END AS vz FROM pos)
"""


def face_cells(spark, folder):
    return mesh.face_cells(faces(spark, folder), SHAPE, FACE_VARS, keep=["block_id", "system"])


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("a04_face_cells", FACE_CELLS + """SELECT block_id, cell, round(c1, 9) AS c1, round(c2, 9) AS c2, round(c3, 9) AS c3,
round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3, rho FROM mid""")
def a04(spark, folder):
    cells = face_cells(spark, folder).select("block_id", "cell", "c1", "c2", "c3", "d1", "d2", "d3", "rho")
    return rounded(cells, 9, "c1", "c2", "c3", "d1", "d2", "d3")


VARIABLE_SETS = """
SELECT p_brand AS file, p_type AS dataset, count(*) % 4 + 1 AS num_vars,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS ord FROM part GROUP BY p_brand, p_type"""


@query("a05_variable_map", f"""
WITH ds AS ({VARIABLE_SETS}),
run AS (SELECT *, coalesce(sum(num_vars) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ds)
SELECT file, 'v' || (base + idx)::INTEGER AS variable, dataset, idx::INTEGER AS idx
FROM (SELECT *, unnest(range(num_vars)) AS idx FROM run)""")
def a05(spark, folder):
    ds = spark.sql(VARIABLE_SETS.replace("FROM part", "FROM {part}"), part=raw(spark, folder, "part"))
    total = ds.groupBy("file").agg(F.sum("num_vars").cast("int").alias("n"))
    names = total.select("file", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    names = names.withColumn("variable", F.concat(F.lit("v"), F.col("pos")))
    return mesh.variable_map(ds, names, by=["file"])


@query("a06_coordinates", FACE_CELLS + """SELECT block_id, system, cell, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z,
round(volume, 9) AS volume FROM pos""")
def a06(spark, folder):
    cells = face_cells(spark, folder).withColumns(mesh.coordinates(F.col("system")))
    return rounded(cells.select("block_id", "system", "cell", "x", "y", "z", "volume"), 9, "x", "y", "z", "volume")


@query("a07_rotated_velocity", FACE_CELLS + "SELECT block_id, cell, round(vx, 8) AS vx, round(vy, 8) AS vy, round(vz, 8) AS vz FROM vel")
def a07(spark, folder):
    v = mesh.rotated_velocity(F.col("system"), [F.col("vel1"), F.col("vel2"), F.col("vel3")])
    return face_cells(spark, folder).select("block_id", "cell", *[F.round(c, 8).alias(n) for c, n in zip(v, ("vx", "vy", "vz"))])


@query("a08_mesh_particles", FACE_CELLS + """SELECT block_id, cell, round(cbrt(volume), 9) AS SmoothingLength,
floor(rho*volume*1e9 + 0.5e0)/1e9 AS Masses, rho AS Density, press AS Pressure, round(x, 9) AS x, round(vx, 8) AS vx FROM vel""")
def a08(spark, folder):
    p = mesh.mesh_particles(face_cells(spark, folder), F.col("system"), list(FACE_VARS), keep=["block_id", "cell"])
    return p.select("block_id", "cell", F.round("SmoothingLength", 9).alias("SmoothingLength"), (F.floor(F.col("Masses") * 1e9 + 0.5) / 1e9).alias("Masses"),
                    "Density", "Pressure", F.round(F.get("Coordinates", F.lit(0)), 9).alias("x"),
                    F.round(F.get("Velocities", F.lit(0)), 8).alias("vx"))


@query("a09_face_header", """
SELECT p_brand AS file, min(p_partkey)/1e2 AS "Time",
  greatest(max(p_size)/1e0 - min(p_size), max(p_partkey % 97)/1e0 - min(p_partkey % 97), max(p_partkey % 53)/1e0 - min(p_partkey % 53)) AS "BoxSize"
FROM part GROUP BY p_brand""")
def a09(spark, folder):
    ends = [("RootGridX1", "p_size"), ("RootGridX2", "p_partkey % 97"), ("RootGridX3", "p_partkey % 53")]
    head = raw(spark, folder, "part").groupBy(F.col("p_brand").alias("file")).agg(
        F.expr("min(p_partkey)/1e2").alias("Time"),
        *[F.expr(f"array(min({e})/1e0, max({e})/1e0)").alias(n) for n, e in ends],
    )
    return mesh.face_header(head, keep=["file"])


# ---- AMR blocks ------------------------------------------------------------------------------

AMR_VARS = ["dens", "pres", "temp", "velx", "vely", "velz", "magx"]


def amr(spark, folder):
    data = [f"transform(sequence(0, 31), i -> ((block_id*31 + i*17 + {v}*7) % 101 + 1)/1e1) AS {n}" for v, n in enumerate(AMR_VARS)]
    return block(spark, folder).selectExpr("block_id", "node_type", "array(cx, cy, cz) AS center", "array(size, size, size) AS size", *data)


def _amr_var(v):
    return f"((block_id*31 + i*17 + {v}*7) % 101 + 1)/1e1"


AMR_CELLS = ctes("block") + f""",
leaf AS (SELECT *, unnest(range(32)) AS i FROM block WHERE node_type = 1),
cells AS (SELECT block_id, i::INTEGER AS cell, cx + size*((i % 4 + 0.5e0)/4 - 0.5e0) AS x, cy + size*((i // 4 % 4 + 0.5e0)/4 - 0.5e0) AS y,
  cz + size*((i // 16 + 0.5e0)/2 - 0.5e0) AS z, size/4*(size/4)*(size/2) AS volume,
  {", ".join(f"{_amr_var(v)} AS {n}" for v, n in enumerate(AMR_VARS))} FROM leaf)
"""


def amr_cells(spark, folder):
    return mesh.amr_cells(amr(spark, folder), SHAPE, mesh.amr_variables(AMR_VARS, None, []), keep=["block_id"])


@query("a10_leaf_cells", AMR_CELLS + """SELECT block_id, cell, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z,
round(volume*1e6, 6) AS volume, dens FROM cells""")
def a10(spark, folder):
    c = amr_cells(spark, folder).select("block_id", "cell", "x", "y", "z", (F.col("volume") * 1e6).alias("volume"), "dens")
    return rounded(rounded(c, 9, "x", "y", "z"), 6, "volume")


@query("a11_amr_particles", AMR_CELLS + """SELECT block_id, dens AS Density, round(dens*volume*1e6, 5) AS Masses, round(cbrt(volume), 9) AS SmoothingLength,
pres AS Pressure, temp AS Temperature, magx AS bx, velx AS vx, velz AS vz FROM cells""")
def a11(spark, folder):
    p = mesh.amr_particles(amr_cells(spark, folder), AMR_VARS, keep=["block_id"])
    return p.select("block_id", "Density", F.round(F.col("Masses") * 1e6, 5).alias("Masses"), F.round("SmoothingLength", 9).alias("SmoothingLength"),
                    "Pressure", "Temperature", F.col("`MagneticField[0]`").alias("bx"),
                    F.get("Velocities", F.lit(0)).alias("vx"), F.get("Velocities", F.lit(2)).alias("vz"))


@query("a12_amr_header", ctes("block") + """
SELECT round(max(greatest(cx, cy, cz) + size/2) - min(least(cx, cy, cz) - size/2), 9) AS "BoxSize",
  (SELECT coalesce(min_by(value, event_id), 0e0) FROM events WHERE event_type = 'view') AS "Time" FROM block""")
def a12(spark, folder):
    b = block(spark, folder).selectExpr("array(cx - size/2, cy - size/2, cz - size/2) AS lo", "array(cx + size/2, cy + size/2, cz + size/2) AS hi")
    scalars = raw(spark, folder, "events").selectExpr(
        "event_id AS pos", "CASE event_type WHEN 'view' THEN 'time  ' ELSE event_type END AS name", "value")
    return mesh.amr_header(b, scalars).select("Time", F.round("BoxSize", 9).alias("BoxSize"))


# ---- catalogs --------------------------------------------------------------------------------

GRID = """SELECT p_partkey AS cell, (p_partkey*7919 % 1009)/1009e0 AS x, (p_partkey*104729 % 1009)/1009e0 AS y,
  (p_partkey*49979687 % 1009)/1009e0 AS z, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size + 1)/64e0 END AS cell_volume,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS density, p_retailprice/1e1 AS temperature,
  p_size/1e0 AS velocity_x, -p_size/2e0 AS velocity_y, 1e0 AS velocity_z FROM part"""


@query("a13_catalog_mesh", f"""WITH grid AS ({GRID})
SELECT cell, round(coalesce(density*cell_volume, cell_volume, 1e0), 6) AS Masses, round(cbrt(cell_volume), 9) AS SmoothingLength,
density AS Density, temperature AS Temperature, velocity_y AS vy FROM grid""")
def a13(spark, folder):
    gas = catalog.catalog_mesh(spark.sql(GRID.replace("FROM part", "FROM {part}"), part=raw(spark, folder, "part")), keep=["cell"])
    return gas.select("cell", F.round("Masses", 6).alias("Masses"), F.round("SmoothingLength", 9).alias("SmoothingLength"),
                      "Density", "Temperature", F.get("Velocities", F.lit(1)).alias("vy"))


RAW_NAMES = ["all", "io", "STAR", "N-BODY_0", "dm_tracer", "nbody", "gas", "halo"]
DERIVED_NAMES = ["all", "sink_csv", "star", "BH", "DM", "cloud", "gas_tracer", "sink", "io", "dark_halo", "young", "old"]


def _named(names, index):
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {index} {whens} END"


# a type catalog per user: the distinct names their events map to
TYPES = f"""
SELECT cat, kind, name, min(event_id) AS pos FROM (
  SELECT user_id AS cat, event_id, 'raw' AS kind, {_named(RAW_NAMES, '(event_id + user_id) % 8')} AS name FROM events
  UNION ALL SELECT user_id, event_id, 'derived', {_named(DERIVED_NAMES, '(event_id*7 + user_id % 5) % 12')}
  FROM events WHERE event_id % (user_id % 20 + 1) = 0) AS t GROUP BY cat, kind, name"""
USEFUL = f"""types AS ({TYPES}),
useful AS (SELECT * FROM types WHERE NOT (lower(name) IN ('all', 'io', 'nbody', 'sink_csv') OR lower(name) LIKE '%\\_tracer' ESCAPE '\\')),
n AS (SELECT cat, count(*) FILTER (WHERE kind = 'raw') AS n_raw, count(*) FILTER (WHERE kind = 'derived') AS n_derived FROM useful GROUP BY cat),
chosen AS (SELECT cat, name, row_number() OVER (PARTITION BY cat ORDER BY CASE WHEN kind = 'derived' THEN name END, pos) - 1 AS pos
  FROM useful JOIN n USING (cat) WHERE (kind = 'derived') = (n_derived > n_raw))"""
CLASS = """CASE WHEN lower(name) LIKE '%sink%' OR lower(name) LIKE '%bh%' THEN 'sink' WHEN lower(name) LIKE '%star%' THEN 'star'
  WHEN regexp_matches(lower(name), 'dm|dark|halo|nbody|n-body') THEN 'dm' ELSE 'other' END"""


def chosen_types(spark, folder):
    types = spark.sql(TYPES.replace("FROM events", "FROM {events}"), events=raw(spark, folder, "events"))
    return catalog.useful_types(types, by=["cat"])


@query("a14_useful_types", f"WITH {USEFUL} SELECT cat, name, pos::INTEGER AS pos FROM chosen")
def a14(spark, folder):
    return chosen_types(spark, folder)


@query("a15_classify_types", f"WITH {USEFUL} SELECT cat, name, {CLASS} AS class FROM chosen")
def a15(spark, folder):
    return chosen_types(spark, folder).select("cat", "name", catalog.classify(F.col("name")).alias("class"))


@query("a16_assign_slots", f"""WITH RECURSIVE {USEFUL},
typed AS (SELECT cat, name, pos, {CLASS} AS class, length(name) % 7 <> 0 AS loaded,
  max(CASE WHEN {CLASS} = 'sink' THEN 1 ELSE 0 END) OVER (PARTITION BY cat) AS sinks FROM chosen),
fold AS (SELECT DISTINCT cat, -1::BIGINT AS pos, [0] AS used, 1 AS next, 0 AS slot, ''::VARCHAR AS name, false AS loaded FROM typed
  UNION ALL SELECT cat, pos, CASE WHEN loaded THEN list_append(used, s) ELSE used END,
    CASE WHEN fixed IS NULL THEN s + 1 ELSE next END, s, name, loaded FROM (
      SELECT *, coalesce(fixed, list_min(list_filter(range(next, next + 40), lambda v: v <> 5 AND NOT list_contains(used, v::INTEGER)))::INTEGER) AS s FROM (
        SELECT t.cat, t.pos, t.name, t.loaded, f.used, f.next,
          CASE WHEN t.class = 'sink' AND NOT list_contains(f.used, 5) THEN 5 WHEN t.class = 'star' AND t.sinks = 1 AND NOT list_contains(f.used, 4) THEN 4
            WHEN t.class = 'star' AND t.sinks = 0 AND NOT list_contains(f.used, 5) THEN 5 WHEN t.class = 'dm' AND NOT list_contains(f.used, 1) THEN 1 END AS fixed
        FROM fold f JOIN typed t ON t.cat = f.cat AND t.pos = f.pos + 1)))
SELECT cat, name, slot FROM fold WHERE loaded""")
def a16(spark, folder):
    types = chosen_types(spark, folder).withColumn("loaded", F.length("name") % 7 != 0)
    return catalog.assign_slots(types, by=["cat"])


@query("a17_extra_fields", """
SELECT l_orderkey AS "ParticleIDs", l_extendedprice AS metallicity, l_discount + 0e0 AS "AGE", l_tax + 0e0 AS birth_time FROM lineitem""")
def a17(spark, folder):
    t = raw(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS ParticleIDs", "l_extendedprice AS particle_metallicity", "l_discount + 0e0 AS AGE", "l_tax + 0e0 AS particle_birth_time",
        "l_quantity AS MASS", "l_quantity AS particle_mass", "l_tax AS birth_time", "l_tax AS POSITION_X")
    names = catalog.extra_fields(t.columns, taken=["Coordinates", "Masses"])
    return t.select(*[F.col(c).alias(n) for c, n in names.items()])


@query("a18_cluster_luminosity", ctes("star") + """
SELECT sid, round(10e0*5e-1*sqrt(mass*1e3/1e4)*(10e0*5e-1*sqrt(mass*1e3/1e4)), 7) AS luminosity FROM star""")
def a18(spark, folder):
    return star(spark, folder).select("sid", F.round(cluster_size_luminosity(F.col("mass") * 1e3, 0.5), 7).alias("luminosity"))


# ---- tracks ----------------------------------------------------------------------------------


@query("a19_parse_tracks", ctes("track") + """,
kept AS (SELECT * FROM track WHERE aexp <= 5e-2 AND nstep % 11 <> 0 AND nstep % 13 <> 0),
enough AS (SELECT sink_id FROM kept GROUP BY sink_id HAVING count(*) >= 2)
SELECT sink_id, nstep, round(aexp, 9) AS aexp, round(x*2e0, 9) AS x, round(y*2e0, 9) AS y, round(z*2e0, 9) AS z
FROM kept WHERE sink_id IN (SELECT sink_id FROM enough)""")
def a19(spark, folder):
    out = tracks.parse_tracks(events_as_lines(spark, folder), until=5e-2, pc_in_code=2.0)
    return rounded(out, 9, "aexp", "x", "y", "z")


# ---- sinks, cache, colormaps -----------------------------------------------------------------

GRID_SQL = f"grid AS (SELECT (i % {CAM.width})::INTEGER AS px, (i // {CAM.width})::INTEGER AS py FROM range({CAM.width * CAM.height}) t(i))"


@query("a21_dense_map", ctes("particle", more=sql_map(CAM, qty="temperature") + "," + GRID_SQL) + """
SELECT px, py, round(coalesce(num, 0)/1e3, 2) AS num, round(coalesce(den, 0), 2) AS den, round(coalesce(sq, 0)/1e8, 2) AS sq
FROM grid LEFT JOIN accum USING (px, py)""")
def a21(spark, folder):
    d = dense(splat(particle(spark, folder), CAM, qty="temperature"), CAM)
    return d.select("px", "py", F.round(F.col("num") / 1e3, 2).alias("num"), F.round("den", 2).alias("den"), F.round(F.col("sq") / 1e8, 2).alias("sq"))


def sql_ramp(name, channel, i):
    """8-bit level of table entry i as an expression."""
    points, out = RAMPS[name][channel], ""
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f" WHEN {i}/255e0 <= {lit(x1)} THEN {lit(y0)}+({lit(y1)}-{lit(y0)})*({i}/255e0-{lit(x0)})/({lit(x1)}-{lit(x0)})"
    return f"floor((CASE {out} ELSE {lit(points[-1][1])} END)*255e0)"


def sql_lookup(name, src, keep, tag=""):
    """CTE ``colored<tag>`` with r, g, b for column t of ``src``."""
    ch = ", ".join(f"CASE WHEN t IS NOT NULL THEN ({sql_ramp(name, c, 'k')} + ({sql_ramp(name, c, 'least(k+1, 255)')} - {sql_ramp(name, c, 'k')})*(u-k))/255e0 END AS {c}" for c in "rgb")
    return f"""colored{tag} AS (SELECT {keep}, t, {ch} FROM (
  SELECT *, floor(u) AS k FROM (SELECT *, CASE WHEN t IS NULL THEN NULL ELSE greatest(0e0, least(255e0, t*256e0-0.5e0)) END AS u FROM {src})))"""


def sql_clamp(v):
    return f"greatest(0e0, least(1e0, {v}))"


@query("a22_image", ctes("particle", more=sql_map(CAM) + "," + GRID_SQL + """,
shown AS (SELECT px, py, CASE WHEN den >= 1e-30 THEN greatest(0e0, least(1e0, (log10(greatest(den, 1e-30)) - 3e0)/(7e0 - 3e0))) END AS t
  FROM grid LEFT JOIN accum USING (px, py)),""" + sql_lookup("hot", "shown", "px, py")) + """
SELECT px, py, round(coalesce(r, 0)*255e0, 4) AS r, round(coalesce(g, 0)*255e0, 4) AS g, round(coalesce(b, 0)*255e0, 4) AS b, 255e0 AS a FROM colored""")
def a22(spark, folder):
    image = colored(splat(particle(spark, folder), CAM), CAM, 0, 3.0, 7.0, True, "hot")
    return image.select("px", "py", *[F.round(F.col(c) * 255.0, 4).alias(c) for c in "rgba"])


@query("a24_colormap", ctes("particle", more="shown AS (SELECT pid, x AS t FROM particle)," + sql_lookup("bone", "shown", "pid")) + """
SELECT pid, round(r, 7) AS r, round(g, 7) AS g, round(b, 7) AS b FROM colored""")
def a24(spark, folder):
    rgb = lookup(particle(spark, folder).select("pid", F.col("x").alias("t")), "t", "bone")
    return rounded(rgb.select("pid", "r", "g", "b"), 7, "r", "g", "b")




@query("a24_user_colormap", ctes("particle") + """
SELECT pid, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM (SELECT pid, (k + (least(k+1, 255) - k)*(u-k))/255e0 AS r,
  (255 - k + ((255 - least(k+1, 255)) - (255 - k))*(u-k))/255e0 AS g,
  ((k*k) // 255 + ((least(k+1, 255)*least(k+1, 255)) // 255 - (k*k) // 255)*(u-k))/255e0 AS b
FROM (SELECT *, floor(u)::BIGINT AS k FROM (SELECT pid, greatest(0e0, least(255e0, x*256e0-0.5e0)) AS u FROM particle)))""")
def a24_user(spark, folder):
    """A user's colormap, given as a table of 256 rows."""
    table = spark.range(256).selectExpr("cast(id as int) idx", "cast(id as int) r", "cast(255 - id as int) g", "cast(id * id div 255 as int) b")
    return rounded(lookup(particle(spark, folder).select("pid", "x"), "x", table).drop("x"), 6, "r", "g", "b")
