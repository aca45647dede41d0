"""From a snapshot folder to the pooled particle table, whatever its layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.sources import catalog, mesh, snapshot


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The parts in a folder: files, or folders of their own. None if there are none."""
    for at in (path, f"{path}/*.parquet"):
        try:
            return snapshot.read_parts(spark, at)
        except AnalysisException as err:
            if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return None


def read_groups(spark: SparkSession, path: str, shape: tuple[int, int, int] | None = None,
                variables: Mapping[str, tuple[str, int]] | Sequence[str] = ()) -> dict[int, DataFrame]:
    """One table per particle type of the snapshot at ``path``.

    The folder holds ``PartType<n>`` (particles or catalog columns, in one or more parts) or ``blocks`` (a mesh,
    which becomes type 0). Block meshes need their cells per block and their variables: names for the tree
    layout, (dataset, index) by name for the face layout.
    """
    groups = {p: t for p in snapshot.LABELS if (t := _table(spark, f"{path}/PartType{p}")) is not None}
    if groups:
        return {p: catalog.catalog_particles(t, p) if snapshot.layout(t.columns) == "catalog" else t for p, t in groups.items()}
    blocks = _table(spark, f"{path}/blocks")
    if blocks is None:
        raise FileNotFoundError(f"{path} holds neither PartType<n> nor blocks")
    kind = snapshot.layout(blocks.columns)
    if kind == "faces":
        cells = mesh.face_cells(blocks, shape, variables, keep=["system"])
        return {0: mesh.mesh_particles(cells, F.col("system"), list(variables))}
    names = mesh.amr_variables(blocks.columns, list(variables), []) if kind == "amr" else []
    return {0: mesh.amr_particles(mesh.amr_cells(blocks, shape, names), names)}


def read_snapshot(spark: SparkSession, path: str, wanted: Sequence[int] | None = None, keep: Sequence[str] = (), **layout) -> DataFrame:
    """``ptype, x, y, z, mass, hsml`` and ``keep`` fields of the wanted types (default: gas, else the first).

    Units and the box come from the header of part 0, if ``Header`` is there; lengths that are not stored come
    from volumes, densities, the header or the neighbours, in this order.
    """
    groups = read_groups(spark, path, **layout)
    table = _table(spark, f"{path}/Header")
    header = snapshot.header_of(table) if table is not None else {}
    chosen = list(wanted) if wanted is not None else [0 if 0 in groups else min(groups)]
    return snapshot.pool(groups, chosen, header, keep)


def load_stars(spark: SparkSession, path: str, ptype: int = 4, **layout) -> DataFrame:
    """The star table: ``x, y, z, mass, luminosity``, speed and every other stored scalar field of one type.

    Units come from the header of part 0, if ``Header`` is there. The mass is the raw sink mass where one is stored; the luminosity
    a stored one, else the mass for stars of a catalog, else that of the main sequence.
    """
    from motefield.functions.fields import read_field, scalar_fields, xyz
    from motefield.functions.photometry import star_luminosity, star_mass

    t = read_groups(spark, path, **layout)[ptype]
    stored, table = _table(spark, f"{path}/PartType{ptype}"), _table(spark, f"{path}/Header")
    header = snapshot.header_of(table) if table is not None else {}
    of_catalog = stored is not None and snapshot.layout(stored.columns) == "catalog"
    x, y, z = xyz(read_field(t, "Coordinates", header))
    mass = star_mass(t.columns, None if "Sink_Mass" in t.columns else read_field(t, "Masses", header))
    out = {"x": x, "y": y, "z": z, "mass": mass, "luminosity": star_luminosity(t.columns, mass, of_catalog)}
    if "Velocities" in t.columns:
        v = xyz(read_field(t, "Velocities"))
        out["speed"] = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    out |= {n: read_field(t, n, header) for n in sorted(scalar_fields(t)) if n not in ("Masses", "part_no", *out) and "[" not in n}
    return t.select(*[c.alias(n) for n, c in out.items()])
