"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.functions import fields, photometry
from motefield.functions.color import hsv_to_rgb, rgb_to_hsv
from motefield.functions.fields import FieldSpec
from motefield.functions.kernels import KERNELS, supported_kernel
from motefield.operators import camera as cams
from motefield.operators.camera import literal, ndc, view
from motefield.operators.multigrid import with_level
from motefield.operators.ranges import scaled_range
from motefield.operators.resolve import composite_joined, normalised, value
from motefield.operators.sampling import rescale
from motefield.operators.splat import contributions, projected, splat
from motefield.queries.base import (
    CAM, TILTED, ctes, lit, octaves, particle, pose, query, raw, sql_hits, sql_kernel, sql_map, sql_view, star, track,
)
from motefield.queries.scans import rounded, sql_clamp, sql_lookup
from motefield.sources import snapshot

HEADER = {"ComovingIntegrationOn": 1, "Time": 0.5, "HubbleParam": 0.7}
FLAT = {"ComovingIntegrationOn": 0, "Time": 0.5, "HubbleParam": 0.7}
EYE = (0.3, 0.2, 1.7)
FORWARD = TILTED.basis()[0]


def snapshot_rows(spark, folder):
    """Particles under stored names: vectors as arrays, a long counter, no ``SmoothingLength``."""
    return particle(spark, folder).select(
        "pid", "ptype", F.array("x", "y", "z").alias("Coordinates"), F.col("mass").alias("Masses"),
        F.col("hsml").alias("KernelMaxRadius"), F.col("temperature").alias("Temperature"),
        F.array("vx", "vy", "vz").alias("Velocities"),
    )


@query("b01_field_alias", ctes("particle") + "SELECT pid, hsml AS hsml, hsml AS short FROM particle")
def b01(spark, folder):
    p = snapshot_rows(spark, folder)
    return p.select("pid", fields.read_field(p, "SmoothingLength").alias("hsml"), fields.read_field(p, "Hsml").alias("short"))


@query("b02_center_of_mass", ctes("particle") + "SELECT pid, x + 1e0 AS x, y AS y, z AS z FROM particle")
def b02(spark, folder):
    p = snapshot_rows(spark, folder)
    at = F.col("Coordinates")
    p = p.withColumn("CenterOfMass", F.array(at[0] + 1.0, at[1], at[2]))
    return p.select("pid", *[c.alias(a) for c, a in zip(fields.xyz(fields.read_field(p, "Coordinates")), "xyz")])


@query("b03_unit_correction", ctes("particle") + f"""SELECT pid, round(x*{lit(0.5 / 0.7)}, 9) AS x, round(hsml*{lit(0.5 / 0.7)}, 9) AS hsml,
round(mass*{lit(1 / 0.7)}, 7) AS mass, temperature, mass AS flat_mass FROM particle""")
def b03(spark, folder):
    p = snapshot_rows(spark, folder)
    x = fields.xyz(fields.read_field(p, "Coordinates", HEADER))[0]
    return p.select("pid", F.round(x, 9).alias("x"), F.round(fields.read_field(p, "SmoothingLength", HEADER), 9).alias("hsml"),
                    F.round(fields.read_field(p, "Masses", HEADER), 7).alias("mass"),
                    fields.read_field(p, "Temperature", HEADER).alias("temperature"), fields.read_field(p, "Masses", FLAT).alias("flat_mass"))


@query("b04_upcast", "SELECT l_orderkey AS id, l_linenumber::DOUBLE AS n, l_suppkey::DOUBLE AS s FROM lineitem")
def b04(spark, folder):
    t = raw(spark, folder, "lineitem")
    return t.select(F.col("l_orderkey").alias("id"), fields.read_field(t, "l_linenumber").alias("n"), fields.read_field(t, "l_suppkey").alias("s"))


@query("b05_component", "SELECT vec_id, embedding[1]::DOUBLE AS c0, embedding[64]::DOUBLE AS c63 FROM embeddings")
def b05(spark, folder):
    t = raw(spark, folder, "embeddings")
    return t.select("vec_id", fields.read_field(t, "embedding[0]").alias("c0"), fields.read_field(t, "embedding[63]").alias("c63"))


def _vector_query(name, sql, projection, **args):
    @query(name, ctes("particle") + f"SELECT pid, round({sql}, 8) AS v FROM particle")
    def run(spark, folder):
        p = snapshot_rows(spark, folder)
        return p.select("pid", F.round(fields.resolve_field(p, "Velocities", projection, **args), 8).alias("v"))

    return run


_EX, _EY, _EZ = (f"({a}-{lit(e)})" for a, e in zip("xyz", EYE))
_SQ = "vx*vx + vy*vy + vz*vz"
_LOS = "+".join(f"v{a}*({lit(f)})" for a, f in zip("xyz", FORWARD))
_LOSP = f"(vx*{_EX}+vy*{_EY}+vz*{_EZ})/greatest(sqrt({_EX}*{_EX}+{_EY}*{_EY}+{_EZ}*{_EZ}), 1e-30)"
_vector_query("b06_norm", f"sqrt({_SQ})", "|v|")
_vector_query("b07_squared_norm", _SQ, "|v|^2")


def _wide_query(name, sql, projection):
    """Norms over all components of the 64-wide vectors."""
    @query(name, f"SELECT vec_id, round({sql.format('list_sum(list_transform(embedding, lambda c: c::DOUBLE * c::DOUBLE))')}, 8) AS v FROM embeddings")
    def run(spark, folder):
        t = raw(spark, folder, "embeddings")
        return t.select("vec_id", F.round(fields.resolve_field(t, "embedding", projection), 8).alias("v"))

    return run


_wide_query("b06_norm_wide", "sqrt({})", "|v|")
_wide_query("b07_squared_norm_wide", "{}", "|v|^2")
_vector_query("b08_los_global", _LOS, "LOS", forward=FORWARD)
_vector_query("b09_los_per_particle", _LOSP, "LOS", eye=EYE)


@query("b10_combine_fields", ctes("particle") + """SELECT pid, round(mass*vx, 6) AS mul, round(mass+vx, 6) AS add, round(mass-vx, 6) AS sub,
round(mass/greatest(abs(vx), 1e-30)*sign(vx), 6) AS div, least(mass, vx) AS low, greatest(mass, vx) AS high, round(mass*vx, 6) AS other,
CASE WHEN ptype <> 1 THEN greatest(mass, vx) END AS missing FROM particle""")
def b10(spark, folder):
    m, v = F.col("mass"), F.col("vx")
    ops = {"mul": "*", "add": "+", "sub": "-", "div": "/", "low": "min", "high": "max", "other": "?"}
    out = {n: fields.combine(m, v, op) for n, op in ops.items()}
    lacking = fields.combine(m, F.when(F.col("ptype") != 1, v), "max").alias("missing")
    return particle(spark, folder).select("pid", *[(c if n in ("low", "high") else F.round(c, 6)).alias(n) for n, c in out.items()], lacking)


@query("b11_resolve_field", ctes("particle") + f"""SELECT pid, temperature AS scalar, round({_LOSP}, 8) AS los, vy AS part, round(sqrt({_SQ}), 8) AS speed FROM particle""")
def b11(spark, folder):
    p = snapshot_rows(spark, folder)
    pick = lambda f, proj="LOS": fields.resolve_field(p, f, proj, eye=EYE)
    return p.select("pid", pick("Temperature").alias("scalar"), F.round(pick("Velocities"), 8).alias("los"),
                    pick("Velocities[1]").alias("part"), F.round(pick("Velocities", "|v|"), 8).alias("speed"))


@query("b12_single_weight", ctes("particle") + f"SELECT pid, round(mass*sqrt({_SQ}), 6) AS w, mass AS w_avg, temperature AS q_avg FROM particle")
def b12(spark, folder):
    p = snapshot_rows(spark, folder)
    w, _ = fields.single_field(p, FieldSpec(weight2="Velocities", op="*", projection="|v|"))
    wa, qa = fields.single_field(p, FieldSpec(weight2="Velocities", data="Temperature", projection="|v|", mode="WeightedAverage"))
    return p.select("pid", F.round(w, 6).alias("w"), wa.alias("w_avg"), qa.alias("q_avg"))


@query("b13_slot_fields", ctes("particle") + f"""SELECT pid, round(mass/greatest(abs(temperature), 1e-30)*sign(temperature), 12) AS w, round({_LOSP}, 8) AS q,
1 AS code_avg, 2 AS code_var, 0 AS code_sum FROM particle""")
def b13(spark, folder):
    p = snapshot_rows(spark, folder)
    spec = FieldSpec(weight2="Temperature", op="/", data="Velocities", mode="WeightedAverage")
    w, q = fields.slot_field(p, spec, eye=EYE)
    codes = [F.lit(FieldSpec(mode=m).resolve_code).alias(n) for m, n in
             (("WeightedAverage", "code_avg"), ("WeightedVariance", "code_var"), ("SurfaceDensity", "code_sum"))]
    return p.select("pid", F.round(w, 12).alias("w"), F.round(q, 8).alias("q"), *codes)


ZAMS = """CASE WHEN mass < 0.43e0 THEN 0.23e0*pow(mass, 2.3e0) WHEN mass < 2e0 THEN mass*mass*mass*mass
WHEN mass < 55e0 THEN 1.4e0*mass*mass*mass*sqrt(mass) ELSE 32000e0*mass END"""


@query("b14_zams_luminosity", ctes("star") + f"SELECT sid, round({ZAMS}, 5) AS luminosity FROM star")
def b14(spark, folder):
    return star(spark, folder).select("sid", F.round(photometry.zams_luminosity(F.col("mass")), 5).alias("luminosity"))


@query("b15_star_mass", ctes("star") + f"SELECT sid, mass*2e0 AS with_sink, round(mass*{lit(1 / 0.7)}, 8) AS without FROM star")
def b15(spark, folder):
    s = star(spark, folder).withColumnRenamed("mass", "Masses")
    both = s.withColumn("Sink_Mass", F.col("Masses") * 2.0)
    masses = fields.read_field(s, "Masses", HEADER)
    return both.select("sid", photometry.star_mass(both.columns, masses).alias("with_sink"),
                       F.round(photometry.star_mass(s.columns, masses), 8).alias("without"))


@query("b16_star_luminosity", ctes("star") + f"""SELECT sid, mass*3e0 AS solar, mass*4e0 AS plain, mass AS cluster, round({ZAMS}, 5) AS zams FROM star""")
def b16(spark, folder):
    s = star(spark, folder).withColumns({"StarLuminosity_Solar": F.col("mass") * 3.0, "StarLuminosity": F.col("mass") * 4.0})
    pick = lambda *gone, **a: photometry.star_luminosity([c for c in s.columns if c not in gone], F.col("mass"), **a)
    both = ("StarLuminosity_Solar", "StarLuminosity")
    return s.select("sid", pick().alias("solar"), pick(both[0]).alias("plain"), pick(*both, catalog=True).alias("cluster"),
                    F.round(pick(*both), 5).alias("zams"))


@query("b17_star_speed", ctes("star") + "SELECT sid, sqrt(vx*vx + vy*vy + vz*vz) AS speed FROM star")
def b17(spark, folder):
    return star(spark, folder).select("sid", fields.norm([F.col(f"v{a}") for a in "xyz"]).alias("speed"))


@query("b18_hsml_chain", ctes("particle") + """SELECT pid, hsml AS stored, round(2e0*cbrt(mass), 8) AS from_volume,
round(2e0*cbrt(CASE WHEN vx > 0 THEN mass/vx ELSE 0e0 END), 8) AS from_density, 0.25e0 AS softened, 0.125e0 AS tabled FROM particle""")
def b18(spark, folder):
    p = snapshot_rows(spark, folder).withColumns({"Volume": F.col("Masses"), "Density": F.col("Velocities")[0]})
    pick = lambda *gone, **a: snapshot.smoothing_length(p.drop(*gone), 3, a.get("header"))
    h, hv, hd = "KernelMaxRadius", "Volume", "Density"
    table = {"SofteningType3": 0.0, "SofteningTable": [1.0, 1.0, 1.0, 0.125]}
    return p.select("pid", pick().alias("stored"), F.round(pick(h), 8).alias("from_volume"), F.round(pick(h, hv), 8).alias("from_density"),
                    pick(h, hv, hd, header={"Softening_Type_3": 0.25}).alias("softened"), pick(h, hv, hd, header=table).alias("tabled"))


@query("b19_kernels", ctes("particle") + "SELECT pid, " + ", ".join(
    f"round(CASE WHEN x*x*1.5e0 > 1e0 THEN 0e0 ELSE {sql_kernel(k, 'least(x*x*1.5e0, 1e0)')} END, 9) AS {k}" for k in KERNELS) + " FROM particle")
def b19(spark, folder):
    r2 = F.col("x") * F.col("x") * 1.5
    return particle(spark, folder).select("pid", *[F.round(supported_kernel(k, r2), 9).alias(k) for k in KERNELS])


@query("b20_contributions", ctes("particle", more=sql_hits(TILTED, qty="temperature", keep="pid", kernel="wendland_c2")) + """
SELECT pid, px, py, round(sigma, 4) AS den, round(sigma*q/1e4, 4) AS num, round(sigma*q*q/1e8, 4) AS sq FROM hits""")
def b20(spark, folder):
    c = contributions(particle(spark, folder), literal(TILTED), F.col("mass"), F.col("hsml"), F.col("temperature"), "wendland_c2", keep=["pid"])
    s, q = F.col("sigma"), F.col("q")
    return c.where(s.isNotNull()).select("pid", "px", "py", F.round(s, 4).alias("den"), F.round(s * q / 1e4, 4).alias("num"),
                                         F.round(s * q * q / 1e8, 4).alias("sq"))


# ---- cameras ---------------------------------------------------------------------------------


def sql_basis(src, tag):
    """CTE ``basis<tag>`` with f, r, u from forward and up columns."""
    return f"""n1{tag} AS (SELECT *, sqrt(forwardx*forwardx+forwardy*forwardy+forwardz*forwardz) AS nf FROM {src}),
n2{tag} AS (SELECT * EXCLUDE (nf), forwardx/nf AS fx, forwardy/nf AS fy, forwardz/nf AS fz FROM n1{tag}),
n3{tag} AS (SELECT *, fy*upz-fz*upy AS sx, fz*upx-fx*upz AS sy, fx*upy-fy*upx AS sz FROM n2{tag}),
n4{tag} AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS ns FROM n3{tag}),
n5{tag} AS (SELECT * EXCLUDE (ns, sx, sy, sz), sx/ns AS rx, sy/ns AS ry, sz/ns AS rz FROM n4{tag}),
basis{tag} AS (SELECT *, ry*fz-rz*fy AS ux, rz*fx-rx*fz AS uy, rx*fy-ry*fx AS uz FROM n5{tag})"""


def sql_rotate(v, k):
    out = []
    for i, a in enumerate("xyz"):
        b, c = "xyz"[(i + 1) % 3], "xyz"[(i + 2) % 3]
        dot = "+".join(f"{k}{d}*{v}{d}" for d in "xyz")
        out.append(f"{v}{a}*cos(angle)+({k}{b}*{v}{c}-{k}{c}*{v}{b})*sin(angle)+{k}{a}*({dot})*(1e0-cos(angle)) AS {v}{a}")
    return ", ".join(out)


BASIS = [p + a for p in "fru" for a in "xyz"]
_BASIS_OUT = ", ".join(f"round({c}, 9) + 0e0 AS {c}" for c in BASIS)


def _basis_out(df):
    return df.select("cam_id", *[(F.round(c, 9) + 0.0).alias(c) for c in BASIS])


@query("b21_camera_basis", ctes("pose", more=sql_basis("pose", "")) + f"SELECT cam_id, {_BASIS_OUT} FROM basis")
def b21(spark, folder):
    return _basis_out(cams.with_basis(pose(spark, folder)))


@query("b22_view_coordinates", ctes("particle") + f"""SELECT pid, round(depth, 9) AS depth, round(right_d, 9) AS right_d, round(up_d, 9) AS up_d
FROM (SELECT pid, {sql_view(TILTED)} FROM particle)""")
def b22(spark, folder):
    v = view(literal(TILTED), F.col("x"), F.col("y"), F.col("z"))
    return particle(spark, folder).select("pid", *[F.round(c, 9).alias(n) for n, c in v.items()])


@query("b23_perspective", ctes("particle") + f"""SELECT pid, round({lit(TILTED.focal / TILTED.aspect)}*right_d/depth, 7) AS nx,
round({lit(TILTED.focal)}*up_d/depth, 7) AS ny FROM (SELECT pid, {sql_view(TILTED)} FROM particle) WHERE depth >= {lit(TILTED.clip_near)}""")
def b23(spark, folder):
    c = literal(TILTED)
    p = particle(spark, folder).select("pid", *[v.alias(n) for n, v in view(c, F.col("x"), F.col("y"), F.col("z")).items()])
    at = ndc(c, F.col("depth"), F.col("right_d"), F.col("up_d"))
    return p.where(F.col("depth") >= TILTED.clip_near).select("pid", *[F.round(v, 7).alias(n) for n, v in at.items()])


def _turn_query(name, turn, sql):
    @query(name, ctes("pose", more=sql_basis("pose", "0") + ",\n" + sql + ",\n" + sql_basis("turned", "")) + f"SELECT cam_id, {_BASIS_OUT} FROM basis")
    def run(spark, folder):
        return _basis_out(turn(pose(spark, folder), F.col("angle")))


_DROP = "EXCLUDE (fx, fy, fz, rx, ry, rz, ux, uy, uz"
_turn_query("b24_yaw", cams.yaw, f"turned AS (SELECT * {_DROP}, forwardx, forwardy, forwardz), {sql_rotate('forward', 'u')} FROM basis0)")
_turn_query("b24_pitch", cams.pitch, f"turned AS (SELECT * {_DROP}, forwardx, forwardy, forwardz, upx, upy, upz), {sql_rotate('forward', 'r')}, {sql_rotate('up', 'r')} FROM basis0)")
_turn_query("b24_roll", cams.roll, f"turned AS (SELECT * {_DROP}, upx, upy, upz), {sql_rotate('up', 'f')} FROM basis0)")


@query("b25_screen_geometry", ctes("particle", more=sql_hits(TILTED, keep="pid")) + """
SELECT pid, round(cx, 6) AS cx, round(cy, 6) AS cy, round(rx, 6) AS rx, round(ry, 6) AS ry FROM shape""")
def b25(spark, folder):
    s = projected(particle(spark, folder), literal(TILTED), F.col("mass"), F.col("hsml"), keep=["pid"])
    return rounded(s.where("cx is not null").select("pid", "cx", "cy", "rx", "ry"), 6, "cx", "cy", "rx", "ry")


@query("b26_rescale", ctes("particle") + "SELECT pid, round(mass*3.5e0, 6) AS mass, round(hsml*cbrt(3.5e0)*1.25e0, 9) AS hsml FROM particle")
def b26(spark, folder):
    m, h = rescale(F.col("mass"), F.col("hsml"), 3.5, 1.25)
    return particle(spark, folder).select("pid", F.round(m, 6).alias("mass"), F.round(h, 9).alias("hsml"))


LEVEL_SQL = "(" + " + ".join(f"CASE WHEN rpx >= {lit(4.0 * 2.0**k)} THEN 1 ELSE 0 END" for k in range(1, 6)) + ")"


def sql_levels(src="octaves"):
    v = f"SELECT *, {sql_view(CAM)} FROM {src}"
    return f"""levelled AS (SELECT *, {LEVEL_SQL} AS level FROM (
  SELECT *, hsml*{lit(CAM.focal)}/greatest(depth, 1e-20)*0.5e0*{CAM.width} AS rpx FROM ({v})))"""


@query("b27_multigrid_level", ctes("octaves", more=sql_levels()) + "SELECT pid, level FROM levelled")
def b27(spark, folder):
    return with_level(octaves(spark, folder), CAM).select("pid", "level")


@query("b28_resolve", ctes("particle", more=sql_map(TILTED, qty="temperature")) + """
SELECT px, py, round(den, 2) AS density, round(num/den, 5) AS mean, round(sqrt(greatest(sq/den - num/den*(num/den), 0e0)), 0) AS deviation FROM accum WHERE den > 1e-30""")
def b28(spark, folder):
    a = splat(particle(spark, folder), TILTED, qty="temperature").where("den > 1e-30")
    num, den, sq = F.col("num"), F.col("den"), F.col("sq")
    return a.select("px", "py", F.round(value(0, num, den, sq), 2).alias("density"), F.round(value(1, num, den, sq), 5).alias("mean"),
                    F.round(value(2, num, den, sq), 0).alias("deviation"))


@query("b29_normalise", ctes("particle") + f"""SELECT pid, round({sql_clamp('(log10(greatest(temperature, 1e-30)) - 3.5e0)/(4.8e0 - 3.5e0)')}, 8) AS log_t,
round({sql_clamp('(temperature - 2e4)/(6e4 - 2e4)')}, 8) AS lin_t FROM particle""")
def b29(spark, folder):
    t = F.col("temperature")
    return particle(spark, folder).select("pid", F.round(normalised(t, 3.5, 4.8, True), 8).alias("log_t"),
                                          F.round(normalised(t, 2e4, 6e4, False), 8).alias("lin_t"))


@query("b30_colormap_lookup", ctes("particle", more="shown AS (SELECT pid, temperature/1e5 AS t FROM particle)," + sql_lookup("hot", "shown", "pid")) + """
SELECT pid, round(r, 7) AS r, round(g, 7) AS g, round(b, 7) AS b FROM colored""")
def b30(spark, folder):
    from motefield.functions.color import lookup

    c = lookup(particle(spark, folder).select("pid", (F.col("temperature") / 1e5).alias("t")), "t", "hot")
    return rounded(c.select("pid", "r", "g", "b"), 7, "r", "g", "b")


def sql_hsv(src, keep, tag=""):
    """CTE ``hsv<tag>``: h, s, v of r, g, b."""
    return f"""hsv{tag} AS (SELECT {keep}, CASE WHEN top > low THEN CASE WHEN sec < 0 THEN sec + 1e0 ELSE sec END ELSE 0e0 END AS h,
  CASE WHEN top > 0 THEN (top-low)/top ELSE 0e0 END AS s, top AS v FROM (
  SELECT *, CASE WHEN top <= low THEN 0e0 WHEN top = r THEN (g-b)/(top-low) WHEN top = g THEN (b-r)/(top-low)+2e0 ELSE (r-g)/(top-low)+4e0 END/6e0 AS sec
  FROM (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM {src})))"""


def sql_rgb(src, keep, tag=""):
    """CTE ``rgb<tag>``: r, g, b of h, s, v."""
    pick = lambda *names: "CASE k " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names)) + " END"
    return f"""rgb{tag} AS (SELECT {keep}, {pick('v', 'q', 'p', 'p', 't', 'v')} AS r, {pick('t', 'v', 'v', 'q', 'p', 'p')} AS g,
  {pick('p', 'p', 't', 'v', 'v', 'q')} AS b FROM (SELECT * EXCLUDE (t), v*(1e0-s) AS p, v*(1e0-s*f) AS q, v*(1e0-s*(1e0-f)) AS t FROM (
  SELECT *, 0 AS t, h*6e0 - floor(h*6e0) AS f, floor(h*6e0)::BIGINT % 6 AS k FROM {src})))"""


@query("b31_hsv_round_trip", ctes("particle", more="rgb0 AS (SELECT pid, x AS r, y AS g, z AS b FROM particle)," + sql_hsv("rgb0", "pid") +
       ", dim AS (SELECT pid, h, s, v*0.5e0 AS v, h AS hue FROM hsv)," + sql_rgb("dim", "pid, hue, s")) + """
SELECT pid, round(hue, 7) AS h, round(s, 7) AS s, round(r, 7) AS r, round(g, 7) AS g, round(b, 7) AS b FROM rgb""")
def b31(spark, folder):
    p = particle(spark, folder)
    h, s, v = rgb_to_hsv(F.col("x"), F.col("y"), F.col("z"))
    p = p.select("pid", h.alias("h"), s.alias("s"), v.alias("v"))
    r, g, b = hsv_to_rgb(F.col("h"), F.col("s"), F.col("v") * 0.5)
    return rounded(p.select("pid", "h", "s", r.alias("r"), g.alias("g"), b.alias("b")), 7, "h", "s", "r", "g", "b")


SPEC1 = FieldSpec(low=3.0, high=7.0, log=True)
SPEC2 = FieldSpec(mode="WeightedAverage", data="Temperature", low=1e4, high=6e4, log=False)


def sql_composite(src, keep="px, py"):
    """From num1..sq2 columns to the composite colour."""
    t1 = sql_clamp("(log10(greatest(den1, 1e-30)) - 3e0)/4e0")
    t2 = sql_clamp("(num2/den2 - 1e4)/5e4")
    return f"""lit AS (SELECT {keep}, CASE WHEN coalesce(den1, 0) >= 1e-30 THEN {t1} ELSE 0e0 END AS light,
  CASE WHEN coalesce(den2, 0) >= 1e-30 THEN {t2} ELSE 0.5e0 END AS t,
  coalesce(den1, 0) >= 1e-30 OR coalesce(den2, 0) >= 1e-30 AS shown FROM {src}),
{sql_lookup("hot", "lit", "px, py, light, shown")},
{sql_hsv("colored", "px, py, light, shown")}, dim AS (SELECT px, py, shown, h, s, v*light AS v FROM hsv), {sql_rgb("dim", "px, py, shown")}
SELECT px, py, round(CASE WHEN shown THEN r ELSE 0 END, 6) AS r, round(CASE WHEN shown THEN g ELSE 0 END, 6) AS g,
  round(CASE WHEN shown THEN b ELSE 0 END, 6) AS b FROM rgb"""


SIX = """six AS (SELECT px, py, sum(sigma) AS den1, sum(CASE WHEN ptype = 0 THEN sigma END) AS den2,
  sum(CASE WHEN ptype = 0 THEN sigma*q END) AS num2, sum(CASE WHEN ptype = 0 THEN sigma*q*q END) AS sq2 FROM hits GROUP BY px, py)"""


@query("b32_composite_color", ctes("particle", more=sql_hits(CAM, qty="temperature", keep="ptype") + "," + SIX + "," + sql_composite("six")))
def b32(spark, folder):
    c = contributions(particle(spark, folder), literal(CAM), F.col("mass"), F.col("hsml"), F.col("temperature"), keep=["ptype"])
    s, q, gas = F.col("sigma"), F.col("q"), F.col("ptype") == 0
    six = c.where(s.isNotNull()).groupBy("px", "py").agg(
        F.sum(s).alias("den1"), F.sum(s * q).alias("num1"), F.sum(s * q * q).alias("sq1"),
        F.sum(F.when(gas, s)).alias("den2"), F.sum(F.when(gas, s * q)).alias("num2"), F.sum(F.when(gas, s * q * q)).alias("sq2"))
    return rounded(composite_joined(six, SPEC1, SPEC2), 6, "r", "g", "b").drop("a")


@query("b33_scaled_range", """SELECT run, round((lo+hi)/2 - (hi-lo)/2*0.8e0, 6) AS lo, round((lo+hi)/2 + (hi-lo)/2*0.8e0, 6) AS hi,
round((lo+hi)/2 - (hi-lo)/2*1.25e0, 6) AS wide_lo, round((lo+hi)/2 + (hi-lo)/2*1.25e0, 6) AS wide_hi
FROM (SELECT event_type AS run, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)""")
def b33(spark, folder):
    ends = raw(spark, folder, "events").groupBy(F.col("event_type").alias("run")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    wide = scaled_range(ends, 1.25).select("run", F.round("lo", 6).alias("wide_lo"), F.round("hi", 6).alias("wide_hi"))
    return rounded(scaled_range(ends, 0.8), 6, "lo", "hi").join(wide, "run")


@query("b39_redshift", ctes("track") + "SELECT sink_id, nstep, round(1e0/greatest(aexp, 1e-6) - 1e0, 6) AS z FROM track")
def b39(spark, folder):
    return track(spark, folder).select("sink_id", "nstep", F.round(photometry.redshift(F.col("aexp")), 6).alias("z"))


