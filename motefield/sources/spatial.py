"""Snapshots laid out in space, and scans that read only what a camera can see.

`write_spatial` clusters rows by type, octave of their smoothing length and a space-filling curve. Every part is a partition of
the table, and a small table beside it holds the bounds of each part and octave. `read_view` tests these bounds against the
camera: parts outside are not listed, and the camera's box reaches the scan of the others as ranges of x, y and z that
Parquet compares with the bounds of its row groups. What is left out cannot touch a pixel, so maps do not change.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.operators.camera import Camera, meets

ROWS = 1 << 22  # of a part: some 100 to 400 MB
SORTED = 1 << 18  # rows that a task sorts, if parts are smaller
PATHS = 4096  # directories that a view names; of more, the table is listed
BITS = 20


def _spread_bits(v: Column) -> Column:
    """20 bits of ``v`` moved to every third bit. Fixed masks of the usual bit-spreading steps."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F),
                        (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve(low: Sequence[float], side: float) -> Column:
    """Place of ``x, y, z`` on a Morton curve through a cube; -1 for a null coordinate."""
    code = None
    for i, a in enumerate("xyz"):
        cell = F.floor((F.col(a) - low[i]) / side * float((1 << BITS) - 1)).cast("long")
        bits = F.shiftleft(_spread_bits(cell), i)
        code = bits if code is None else code.bitwiseOR(bits)
    return F.coalesce(code, F.lit(-1).cast("long"))


def octave(h: Column) -> Column:
    """Octave of a length; rows without a positive one (they draw nothing) are in the lowest."""
    return F.when(h > 0, F.greatest(F.lit(-1000), F.floor(F.log2(h)))).otherwise(-1001).cast("int")


def write_spatial(df: DataFrame, path: str, rows: int = ROWS) -> None:
    """Writes ``x, y, z, hsml, ptype`` and all other columns to ``path/rows``, bounds to ``path/bounds``.

    Parts hold up to ``rows`` rows. The cut is by range over type, octave, curve and position, so rows that share a cell of the
    curve are still cut. A task sorts one range and cuts it into parts by place, so that small parts do not make as many tasks,
    each with a result and samples for the driver.
    """
    box = df.agg(*[f(F.col(a).cast("double")).alias(n + a) for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).first()
    low = [box["lo" + a] or 0.0 for a in "xyz"]
    side = max((box["hi" + a] or 0.0) - v for a, v in zip("xyz", low)) or 1.0
    order = ["ptype", "octave", "_code", "x", "y", "z"]
    coded = df.withColumns({"octave": octave(F.col("hsml")), "_code": curve(low, side)})
    tasks = max(1, -(-box["n"] // max(rows, SORTED)))
    place = F.monotonically_increasing_id()  # the task's number from bit 33 on, the row's place in it below
    cut = coded.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", place)
    in_task = F.floor(F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) / rows).cast("long")
    part = F.shiftleft(F.shiftleft(F.shiftright("_place", 33), 20) + in_task, 2)
    cut = cut.withColumn("part", part + F.pmod("octave", F.lit(4))).drop("_place")  # neighbouring octaves share no part
    cut = cut.sortWithinPartitions("ptype", "part", *order[1:]).drop("_code")
    cut.write.partitionBy("ptype", "part").parquet(f"{path}/rows")
    found = _rows(df.sparkSession, path, cut.schema).groupBy("ptype", "part", "octave").agg(
        F.count(F.lit(1)).alias("n"), F.max("hsml").alias("h"), *[f(a).alias(n + a) for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    found.coalesce(1).write.parquet(f"{path}/bounds")  # one row per part and octave


def _rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/rows")


def frustum_box(cam: Camera, h: float) -> dict[str, tuple[float, float]]:
    """Ranges of x, y and z that hold the centre of every particle of length up to ``h`` that can touch a pixel."""
    f, r, u = cam.basis()
    corners = []
    for d in (cam.clip_near, cam.far):
        half = d / cam.focal + h
        across = d * cam.aspect / cam.focal + h
        corners += [[p + d * a + s * across * b + t * half * c for p, a, b, c in zip(cam.position, f, r, u)] for s in (-1, 1) for t in (-1, 1)]
    out = {}
    for i, a in enumerate("xyz"):
        lo, hi = min(c[i] for c in corners), max(c[i] for c in corners)
        slack = 1e-9 * (abs(lo) + abs(hi) + hi - lo)
        out[a] = lo - slack, hi + slack
    return out


def read_view(spark: SparkSession, path: str, cam: Camera, types: Sequence[int] | None = None) -> DataFrame:
    """Rows of a spatial snapshot that ``cam`` may see, of the wanted types, without the helper columns.

    The visible entries of the bounds table come to the driver: some bytes per file that is going to be read.
    """
    bounds = spark.read.parquet(f"{path}/bounds")
    if types is not None:
        bounds = bounds.where(F.col("ptype").isin([int(t) for t in types]))
    sees = meets(cam, *({a: F.col(n + a) for a in "xyz"} for n in ("lo", "hi")), F.col("h"))
    seen = bounds.where((F.col("octave") > -1001) & sees).select("ptype", "part", "octave", "h").collect()
    if not seen:
        return _rows(spark, path).where(F.lit(False)).drop("octave", "part")
    folders = sorted({f"{path}/rows/ptype={r['ptype']}/part={r['part']}" for r in seen})
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders) if len(folders) <= PATHS else _rows(spark, path)
    rows = rows.where(F.col("ptype").isin(sorted({r["ptype"] for r in seen})) & F.col("part").isin(sorted({r["part"] for r in seen})))
    lengths: dict[int, float] = {}
    for r in seen:
        lengths[r["octave"]] = max(r["h"], lengths.get(r["octave"], 0.0))
    inside = []
    for k, h in sorted(lengths.items()):
        ranges = [F.col(a).between(*b) for a, b in frustum_box(cam, h).items()]
        inside.append(reduce(lambda p, q: p & q, ranges, F.col("octave") == k))
    return rows.where(reduce(lambda p, q: p | q, inside)).drop("octave", "part")
