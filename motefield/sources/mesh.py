"""Mesh blocks to one row per cell: face-array blocks and AMR leaf blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Variable names and what they become.
FACE_DENSITY = ["rho", "dens", "density"]
FACE_RENAME = {"press": "Pressure"}
AMR_DENSITY = ["dens", "density", "Density", "rho"]
AMR_VELOCITY = [("velx", "vely", "velz"), ("vel_x", "vel_y", "vel_z")]
AMR_RENAME = {
    "pres": "Pressure",
    "temp": "Temperature",
    "magx": "MagneticField[0]",
    "magy": "MagneticField[1]",
    "magz": "MagneticField[2]",
}


def first_of(names: Sequence[str], have: Sequence[str]) -> str | None:
    return next((n for n in names if n in have), None)


# ---- blocks with face arrays -----------------------------------------------------------------


def variable_map(datasets: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Which dataset and index holds each variable: names run through the datasets in order.

    ``datasets``: ``ord, dataset, num_vars``; ``names``: ``pos, variable`` (0-based).
    """
    before = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    base = datasets.withColumn("base", F.coalesce(F.sum("num_vars").over(before), F.lit(0)))
    slots = base.where("num_vars > 0").withColumn("idx", F.explode(F.sequence(F.lit(0), (F.col("num_vars") - 1).cast("int"))))
    slots = slots.withColumn("pos", (F.col("base") + F.col("idx")).cast("int"))
    return slots.join(names, [*by, "pos"]).select(*by, "variable", "dataset", "idx")


def _array_at(arr: str, i: Column) -> Column:
    return F.get(F.col(arr), i.cast("int"))


def face_cells(blocks: DataFrame, shape: tuple[int, int, int], variables: Mapping[str, tuple[str, int]],
               keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: centres ``c1..c3``, widths ``d1..d3`` and every variable.

    ``blocks`` holds face arrays ``x1f, x2f, x3f`` and datasets ``[variable][cell]`` with x1 fastest.
    Cells are built as an array of structs and inlined, so block arrays are not copied per cell.
    """
    n1, n2, n3 = shape

    def cell(c: Column) -> Column:
        idx = {"x1f": c % n1, "x2f": F.floor(c / n1) % n2, "x3f": F.floor(c / (n1 * n2))}
        out = [c.cast("int").alias("cell")]
        for axis, (faces, i) in enumerate(idx.items(), 1):
            lo, hi = _array_at(faces, i), _array_at(faces, i + 1)
            out += [(0.5 * (lo + hi)).alias(f"c{axis}"), (hi - lo).alias(f"d{axis}")]
        out += [F.get(F.get(F.col(ds), F.lit(v)), c.cast("int")).alias(name) for name, (ds, v) in variables.items()]
        return F.struct(*out)

    cells = F.transform(F.sequence(F.lit(0), F.lit(n1 * n2 * n3 - 1)), cell)
    return blocks.select(*keep, F.inline(cells))


def coordinates(system: Column) -> dict[str, Column]:
    """Cartesian ``x, y, z`` and cell ``volume`` by coordinate system; unknown systems count as cartesian."""
    c1, c2, c3, d1, d2, d3 = (F.col(n) for n in ("c1", "c2", "c3", "d1", "d2", "d3"))
    cyl, sph = system == "cylindrical", system.startswith("spherical")
    lo, hi = c1 - 0.5 * d1, c1 + 0.5 * d1
    sin2 = F.sin(c2)
    pick = lambda a, b, c: F.when(cyl, a).when(sph, b).otherwise(c)
    return {
        "x": pick(c1 * F.cos(c2), c1 * sin2 * F.cos(c3), c1),
        "y": pick(c1 * sin2, c1 * sin2 * F.sin(c3), c2),
        "z": pick(c3, c1 * F.cos(c2), c3),
        "volume": pick(
            0.5 * (hi * hi - lo * lo) * d2 * d3,
            (hi * hi * hi - lo * lo * lo) / 3.0 * (F.cos(c2 - 0.5 * d2) - F.cos(c2 + 0.5 * d2)) * d3,
            d1 * d2 * d3,
        ),
    }


def rotated_velocity(system: Column, v: Sequence[Column]) -> list[Column]:
    """Velocity components along the curvilinear axes, turned to Cartesian."""
    c2, c3 = F.col("c2"), F.col("c3")
    v1, v2, v3 = v
    s2, k2, s3, k3 = F.sin(c2), F.cos(c2), F.sin(c3), F.cos(c3)
    cyl, sph = system == "cylindrical", system.startswith("spherical")
    pick = lambda a, b, c: F.when(cyl, a).when(sph, b).otherwise(c)
    return [
        pick(v1 * k2 - v2 * s2, v1 * s2 * k3 + v2 * k2 * k3 - v3 * s3, v1),
        pick(v1 * s2 + v2 * k2, v1 * s2 * s3 + v2 * k2 * s3 + v3 * k3, v2),
        pick(v3, v1 * k2 - v2 * s2, v3),
    ]


def mesh_particles(cells: DataFrame, system: Column, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Cells as particles: hsml = ∛V, mass = ρV (V without a density), velocities, renamed variables."""
    have = cells.withColumns(coordinates(system))
    density = first_of(FACE_DENSITY, variables)
    out = [F.array("x", "y", "z").alias("Coordinates"), F.cbrt("volume").alias("SmoothingLength")]
    volume = F.col("volume")
    out.append((F.col(density) * volume if density else volume).alias("Masses"))
    if density:
        out.append(F.col(density).alias("Density"))
    speed = ["vel1", "vel2", "vel3"]
    if all(s in variables for s in speed):
        out.append(F.array(*rotated_velocity(system, [F.col(s) for s in speed])).alias("Velocities"))
    used = {*FACE_DENSITY, *speed}
    out += [F.col(v).alias(FACE_RENAME.get(v, v)) for v in variables if v not in used]
    return have.select(*keep, *out)


def face_header(headers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``Time`` (0 if absent) and ``BoxSize``, the largest root-grid extent (0 if any is missing)."""
    grids = ["RootGridX1", "RootGridX2", "RootGridX3"]
    if not all(g in headers.columns for g in grids):
        box = F.lit(0.0)
    else:
        size = [F.get(F.col(g), F.lit(1)) - F.get(F.col(g), F.lit(0)) for g in grids]
        known = size[0].isNotNull() & size[1].isNotNull() & size[2].isNotNull()
        box = F.when(known, F.greatest(*size)).otherwise(0.0)
    time = F.coalesce(F.col("Time"), F.lit(0.0)) if "Time" in headers.columns else F.lit(0.0)
    return headers.select(*keep, time.alias("Time"), box.alias("BoxSize"))


# ---- AMR leaf blocks -------------------------------------------------------------------------


def amr_variables(columns: Sequence[str], names: Sequence[str] | None, block_columns: Sequence[str]) -> list[str]:
    """Listed variables that exist, or every column that is not block metadata."""
    listed = [n.strip() for n in names] if names is not None else [c for c in columns if c not in block_columns]
    found = [n for n in listed if n in columns]
    if not found:
        raise ValueError("no field variables in the block table")
    return found


def amr_cells(blocks: DataFrame, shape: tuple[int, int, int], variables: Sequence[str], ndim: int = 3,
              keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of the **leaf** blocks (``node_type = 1``): ``x, y, z, volume`` and variables.

    Blocks hold ``center`` and ``size`` arrays; missing dimensions are 0 wide and count 1 in the volume.
    """
    n = list(shape)

    def cell(c: Column) -> Column:
        idx = [c % n[0], F.floor(c / n[0]) % n[1], F.floor(c / (n[0] * n[1]))]
        out, volume = [c.cast("int").alias("cell")], F.lit(1.0)
        for axis in range(3):
            if axis < ndim:
                size = F.get(F.col("size"), F.lit(axis))
                out.append((F.get(F.col("center"), F.lit(axis)) + size * ((idx[axis] + 0.5) / n[axis] - 0.5)).alias("xyz"[axis]))
                volume = volume * (size / float(n[axis]))
            else:
                out.append(F.lit(0.0).alias("xyz"[axis]))
        out.append(volume.alias("volume"))
        out += [F.get(F.col(v), c.cast("int")).cast("double").alias(v) for v in variables]
        return F.struct(*out)

    cells = F.transform(F.sequence(F.lit(0), F.lit(n[0] * n[1] * n[2] - 1)), cell)
    return blocks.where("node_type = 1").select(*keep, F.inline(cells))


def amr_particles(cells: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Leaf cells as particles; density and velocities are consumed, the rest is renamed."""
    density = first_of(AMR_DENSITY, variables)
    velocity = next((v for v in AMR_VELOCITY if all(c in variables for c in v)), ())
    volume = F.col("volume")
    out = [F.array("x", "y", "z").alias("Coordinates"), F.cbrt("volume").alias("SmoothingLength")]
    out.append((F.col(density) * volume if density else volume).alias("Masses"))
    if density:
        out.append(F.col(density).alias("Density"))
    if velocity:
        out.append(F.array(*velocity).alias("Velocities"))
    used = {density, *velocity}
    out += [F.col(v).alias(AMR_RENAME.get(v, v)) for v in variables if v not in used]
    return cells.select(*keep, *out)


def amr_header(blocks: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """One row: ``Time`` of the first scalar named time (0 if none), ``BoxSize`` over all block bounds.

    ``blocks`` has arrays ``lo`` and ``hi``; ``scalars`` has ``pos, name, value``.
    """
    box = F.max(F.array_max("hi")) - F.min(F.array_min("lo"))
    out = blocks.agg(F.coalesce(box, F.lit(0.0)).alias("BoxSize"))
    time = F.lit(0.0)
    if scalars is not None:
        time = F.coalesce(scalars.where(F.trim("name") == "time").agg(F.min_by("value", "pos")).scalar(), time)
    return out.select(time.alias("Time"), "BoxSize")
