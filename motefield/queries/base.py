"""Registry of queries with their SQL twins, and the SQL pieces the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motefield.functions.kernels import NORMS
from motefield.operators.camera import Camera
from motefield.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CAM = Camera((0.5, 0.5, 1.5))
# the same view turned: no basis vector lies on an axis
TILTED = Camera((1.4, 1.2, 1.6), forward=(-0.9, -0.7, -1.1), up=(0.1, 1.0, 0.0), fov=60.0, width=96, height=64)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def ctes(*names: str, more: str = "") -> str:
    parts = [f"{n} AS ({tables.SQL[n]})" for n in names]
    return "WITH " + ",\n".join(parts + ([more] if more else []))


def lit(v: float) -> str:
    """A DOUBLE literal in both engines."""
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def sql_kernel(name: str, r2: str = "r2") -> str:
    n = lit(NORMS[name])
    r = f"sqrt({r2})"
    return {
        "cubic_spline": f"(CASE WHEN {r} <= 0.5e0 THEN 1e0 - 6e0*{r2}*(1e0-{r}) ELSE 2e0*(1e0-{r})*(1e0-{r})*(1e0-{r}) END * {n})",
        "wendland_c2": f"((1e0-{r})*(1e0-{r})*(1e0-{r})*(1e0-{r})*(4e0*{r}+1e0)*{n})",
        "gaussian": f"(exp(-4e0*{r2})*{n})",
        "quartic": f"((1e0-{r2})*(1e0-{r2})*{n})",
        "sphere": f"(sqrt(greatest(1e0-{r2}, 0e0))*{n})",
    }[name]


def sql_view(cam: Camera) -> str:
    v = cam.values()
    dot = lambda p: "+".join(f"({a}-({lit(v['p' + a])}))*({lit(v[p + a])})" for a in "xyz")
    return f"{dot('f')} AS depth, {dot('r')} AS right_d, {dot('u')} AS up_d"


def sql_hits(cam: Camera, src: str = "particle", mass: str = "mass", hsml: str = "hsml", qty: str = "0e0",
             kernel: str = "cubic_spline", keep: str = "", tag: str = "", width: str | None = None,
             height: str | None = None) -> str:
    """CTEs ending in ``hits<tag>(keep, px, py, r2, sigma, q)``."""
    v = cam.values()
    w, h = width or str(cam.width), height or str(cam.height)
    k = keep + "," if keep else ""
    fx, fy = lit(cam.focal / cam.aspect), lit(cam.focal)
    return f"""
geom{tag} AS (SELECT {k} {sql_view(cam)}, {mass} AS m, {hsml} AS h, {qty} AS q FROM {src}),
shape{tag} AS (SELECT {k} ({fx}*right_d/depth + 1e0)*{w}/2e0 - 0.5e0 AS cx, (1e0 - {fy}*up_d/depth)*{h}/2e0 - 0.5e0 AS cy,
  {fx}*h/depth*{w}/2e0 AS rx, {fy}*h/depth*{h}/2e0 AS ry, m/(h*h) AS a, q
  FROM geom{tag} WHERE depth >= {lit(v['near'])} AND depth <= {lit(v['far'])} AND h > 0)""" + ",\n" + sql_discs(w, h, kernel, keep, tag)


def sql_discs(w, h, kernel: str = "cubic_spline", keep: str = "", tag: str = "") -> str:
    """CTEs from ``shape<tag>`` (cx, cy, rx, ry, a, q) to ``hits<tag>``."""
    k = keep + "," if keep else ""
    return f"""rows{tag} AS (SELECT *, unnest(range(greatest(ceil(cy-ry),0)::BIGINT, least(floor(cy+ry),{h}-1)::BIGINT+1)) AS py
  FROM shape{tag} WHERE cx+rx >= 0 AND cx-rx <= {w}-1 AND cy+ry >= 0 AND cy-ry <= {h}-1),
cells{tag} AS (SELECT *, unnest(range(greatest(ceil(cx-rx),0)::BIGINT, least(floor(cx+rx),{w}-1)::BIGINT+1)) AS px FROM rows{tag}),
disc{tag} AS (SELECT *, ((px-cx)/rx)*((px-cx)/rx) + ((py-cy)/ry)*((py-cy)/ry) AS r2 FROM cells{tag}),
hits{tag} AS (SELECT {k} px::INTEGER AS px, py::INTEGER AS py, r2, a*{sql_kernel(kernel)} AS sigma, q FROM disc{tag} WHERE r2 <= 1e0)"""


def sql_accum(tag: str = "", keep: str = "") -> str:
    """CTE ``accum<tag>``, after :func:`sql_hits`."""
    k = keep + "," if keep else ""
    return f"""accum{tag} AS (SELECT {k} px, py, sum(sigma*q) AS num, sum(CASE WHEN q IS NOT NULL THEN sigma END) AS den, sum(sigma*q*q) AS sq
FROM hits{tag} GROUP BY {k} px, py)"""


def sql_map(cam: Camera, src: str = "particle", tag: str = "", **args) -> str:
    return sql_hits(cam, src, tag=tag, **args) + ",\n" + sql_accum(tag, args.get("keep", ""))


def table(name: str):
    return lambda spark, folder: tables.derived(spark, folder, name)


particle, octaves, star, track, block, pose, framelog = (
    table(n) for n in ("particle", "octaves", "star", "track", "block", "pose", "framelog")
)
raw = tables.raw


def events_as_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The track table as lines of its text files, with comment, short and broken lines among them."""
    t = track(spark, folder)
    return t.selectExpr(
        "concat('sink_', sink_id, '.txt') AS file",
        """CASE WHEN nstep % 11 = 0 THEN concat('  # ', nstep)
                WHEN nstep % 13 = 0 THEN concat_ws(' ', nstep, aexp, sink_id, 'x y z')
                ELSE concat_ws('  ', nstep, aexp, sink_id, '1 2 3 4 5 6 7 8 9 10', x, y, z) END AS value""",
    )
