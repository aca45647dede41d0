"""Catalog snapshots: a mesh table and one table per particle type, mapped to numbered slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that are not particle types, and canonical field names.
META_TYPES = ["all", "io", "nbody", "sink_csv"]
TRACER_SUFFIX = "_tracer"
SINK_TOKENS = ["sink", "bh"]
STAR_TOKENS = ["star"]
DARK_TOKENS = ["dm", "dark", "halo", "nbody", "n-body"]
CANONICAL = [
    "particle_position", "particle_position_x", "particle_position_y", "particle_position_z",
    "particle_velocity", "particle_velocity_x", "particle_velocity_y", "particle_velocity_z",
    "particle_mass", "smoothing_length",
    "position_x", "position_y", "position_z",
    "velocity_x", "velocity_y", "velocity_z",
    "mass",
]
GAS_EXTRAS = {
    "pressure": "Pressure",
    "temperature": "Temperature",
    "specific_thermal_energy": "InternalEnergy",
    "metallicity": "Metallicity",
    "metal_density": "MetalDensity",
}


def catalog_mesh(grid: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Grid cells as gas. Mass is ρV where both exist, else V, else 1."""
    have = grid.columns
    vol = F.col("cell_volume") if "cell_volume" in have else F.lit(None).cast("double")
    rho = F.col("density") if "density" in have else F.lit(None).cast("double")
    out = [F.array("x", "y", "z").alias("Coordinates"), F.coalesce(rho * vol, vol, F.lit(1.0)).alias("Masses")]
    if "cell_volume" in have:
        out.append(F.cbrt("cell_volume").alias("SmoothingLength"))
    if "density" in have:
        out.append(F.col("density").alias("Density"))
    velocity = [f"velocity_{a}" for a in "xyz"]
    if all(v in have for v in velocity):
        out.append(F.array(*velocity).alias("Velocities"))
    out += [F.col(c).alias(n) for c, n in GAS_EXTRAS.items() if c in have]
    return grid.select(*keep, *out)


def is_meta(name: Column) -> Column:
    return F.lower(name).isin(META_TYPES) | F.lower(name).endswith(TRACER_SUFFIX)


def useful_types(types: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The types to load: the derived list if it holds more useful names than the raw one.

    ``types`` has ``kind`` (raw or derived), ``pos`` and ``name``. Derived names are in name order,
    raw ones in their own order; ``pos`` is renumbered from 0.
    """
    useful = types.where(~is_meta(F.col("name")))
    whole = Window.partitionBy(*by)
    n = {k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).over(whole) for k in ("raw", "derived")}
    marked = useful.withColumn("_kind", F.when(n["derived"] > n["raw"], "derived").otherwise("raw")).where("kind = _kind")
    order = [F.when(F.col("kind") == "derived", F.col("name")), F.col("pos")]
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return marked.select(*by, pos.alias("pos"), "name")


def classify(name: Column) -> Column:
    """sink, star, dm or other; earlier classes win."""
    low = F.lower(name)
    has = lambda tokens: low.rlike("|".join(tokens))
    return F.when(has(SINK_TOKENS), "sink").when(has(STAR_TOKENS), "star").when(has(DARK_TOKENS), "dm").otherwise("other")


def assign_slots(types: DataFrame, by: Sequence[str], has_mesh: bool = True) -> DataFrame:
    """Slot number per type: sinks 5; stars 4 beside sinks, else 5; dark matter 1; others the next free.

    ``types`` has ``pos, name, loaded`` (a type whose table is empty or has no positions is not
    loaded and gives its slot back). Types of one catalog are few, so each catalog is folded as one
    array: the state holds the used slots and the next free number.
    """
    entry = F.struct("pos", "name", classify(F.col("name")).alias("cat"), "loaded")
    lists = types.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("types"))
    sink = F.exists("types", lambda t: t["cat"] == "sink")
    start = F.struct(
        F.array(F.lit(0)).alias("used") if has_mesh else F.array().cast("array<int>").alias("used"),
        F.lit(1).alias("next"),
        F.array().cast("array<struct<name:string,slot:int>>").alias("out"),
    )

    def step(state: Column, t: Column) -> Column:
        free = lambda s: ~F.array_contains(state["used"], F.lit(s))
        cat = t["cat"]
        # the next number that is neither used nor 5; the counter moves on past it
        count = F.size(state["used"]) + 2
        numbers = F.sequence(state["next"], state["next"] + count)
        after = F.get(F.filter(numbers, lambda n: (n != 5) & ~F.array_contains(state["used"], n)), F.lit(0))
        fixed = (
            F.when((cat == "sink") & free(5), 5)
            .when((cat == "star") & F.col("_sink") & free(4), 4)
            .when((cat == "star") & ~F.col("_sink") & free(5), 5)
            .when((cat == "dm") & free(1), 1)
        )
        slot = F.coalesce(fixed, after)
        row = F.struct(t["name"].alias("name"), slot.cast("int").alias("slot"))
        return F.struct(
            F.when(t["loaded"], F.array_append(state["used"], slot.cast("int"))).otherwise(state["used"]).alias("used"),
            F.when(fixed.isNull(), after + 1).otherwise(state["next"]).cast("int").alias("next"),
            F.when(t["loaded"], F.array_append(state["out"], row)).otherwise(state["out"]).alias("out"),
        )

    folded = lists.withColumn("_sink", sink).withColumn("s", F.aggregate("types", start, step))
    return folded.select(*by, F.inline("s.out"))


def extra_fields(columns: Sequence[str], taken: Sequence[str]) -> dict[str, str]:
    """Remaining scalar columns and their clean names: ``particle_`` is cut, nothing is overwritten."""
    out: dict[str, str] = {}
    for name in columns:
        if name in CANONICAL or name.lower() in CANONICAL:
            continue
        clean = name.removeprefix("particle_")
        if clean and clean not in taken and clean not in out.values():
            out[name] = clean
    return out


def catalog_particles(table: DataFrame, slot: int, pc_in_code: float | None = None, msun: str | None = None) -> DataFrame:
    """One particle type: positions, mass, velocities, smoothing length and every other scalar."""
    from motefield.functions.photometry import cluster_size_luminosity

    have = table.columns
    if "particle_position" in have:
        out = {"Coordinates": F.col("particle_position")}
    else:
        out = {"Coordinates": F.array(*[f"particle_position_{a}" for a in "xyz"])}
    if "particle_mass" in have:
        out["Masses"] = F.col("particle_mass")
    velocity = [f"particle_velocity_{a}" for a in "xyz"]
    if all(v in have for v in velocity):
        out["Velocities"] = F.array(*velocity)
    if "smoothing_length" in have:
        out["SmoothingLength"] = F.col("smoothing_length")
    if slot == 5 and pc_in_code is not None and (msun or "particle_mass") in have:
        out["StarLuminosity"] = cluster_size_luminosity(F.col(msun or "particle_mass"), pc_in_code)
    out.update({clean: F.col(name) for name, clean in extra_fields(have, list(out)).items()})
    return table.select(*[c.alias(n) for n, c in out.items()])
