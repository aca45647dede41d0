"""Field access, unit correction, vector projections and field arithmetic as Column builders.

Everything here is decided from column names and a header before the job runs; no action, no UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names and their stand-ins, in order of preference.
FALLBACKS = {
    "KernelMaxRadius": ["SmoothingLength", "Hsml"],
    "SmoothingLength": ["KernelMaxRadius", "Hsml"],
    "Hsml": ["KernelMaxRadius", "SmoothingLength"],
    "Sink_Mass": ["BH_Mass"],
    "BH_Mass": ["Sink_Mass"],
    "StarLuminosity_Solar": ["StarLuminosity"],
}
HSML_NAMES = ["SmoothingLength", "KernelMaxRadius", "Hsml"]
SKIP_FIELDS = [
    "Coordinates",
    "ParticleIDs",
    "ParticleChildIDsNumber",
    "ParticleIDGenerationNumber",
    "PhotonFluxDensity",
]
OPERATORS = ["*", "+", "-", "/", "min", "max"]
PROJECTIONS = ["LOS", "|v|", "|v|^2"]
MODES = {"SurfaceDensity": 0, "WeightedAverage": 1, "WeightedVariance": 2}


class FieldNotFound(KeyError):
    """A field and all its stand-ins are absent."""


def stored_name(columns: Sequence[str], field: str) -> str:
    """The column that holds ``field``: itself or the first stand-in present."""
    if field == "Coordinates" and "CenterOfMass" in columns:
        return "CenterOfMass"
    for name in [field, *FALLBACKS.get(field, [])]:
        if name in columns:
            return name
    raise FieldNotFound(f"field {field} and its stand-ins are not among {sorted(columns)}")


def unit_factor(field: str, header: Mapping[str, float]) -> float:
    """Comoving to physical: positions and smoothing lengths times a/h, masses over h, nothing else."""
    if not header.get("ComovingIntegrationOn", 0):
        return 1.0
    a, h = float(header.get("Time", 1)), float(header["HubbleParam"])
    if field == "Coordinates" or field in HSML_NAMES:
        return a / h
    return 1.0 / h if field == "Masses" else 1.0


def _numeric(schema: T.StructType, name: str) -> Column:
    """Whole numbers and decimals become doubles; floats are widened; vectors are left alone."""
    if isinstance(schema[name].dataType, T.ArrayType):
        return F.col(name)
    return F.col(name).cast("double")


def read_field(df: DataFrame, field: str, header: Mapping[str, float] | None = None) -> Column:
    """A field by name with stand-ins, ``Name[i]`` components, unit correction and upcast."""
    if field.endswith("]") and "[" in field and field not in df.columns:
        base, index = field[:-1].split("[", 1)
        return F.get(read_field(df, base, header), F.lit(int(index))).cast("double")
    name = stored_name(df.columns, field)
    factor = unit_factor(field, header or {})
    col = _numeric(df.schema, name)
    if factor == 1.0:
        return col
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.transform(col, lambda c: c * F.lit(factor))
    return col * F.lit(factor)


def component(vec: Column, i: int) -> Column:
    return F.get(vec, F.lit(i)).cast("double")


def xyz(vec: Column) -> list[Column]:
    return [component(vec, i) for i in range(3)]


def squared(v: Sequence[Column]) -> Column:
    return v[0] * v[0] + v[1] * v[1] + v[2] * v[2]


def norm(v: Sequence[Column]) -> Column:
    return F.sqrt(squared(v))


def los_global(v: Sequence[Column], forward: Sequence[float]) -> Column:
    """Component along one direction for all rows."""
    return v[0] * forward[0] + v[1] * forward[1] + v[2] * forward[2]


def los_per_row(v: Sequence[Column], at: Sequence[Column], eye: Sequence[float]) -> Column:
    """Component along the unit vector from the eye to each row's position."""
    d = [a - (e if isinstance(e, Column) else F.lit(float(e))) for a, e in zip(at, eye)]
    return los_global(v, d) / F.greatest(norm(d), F.lit(1e-30))


def project_vector(vec: Column, projection: str, forward=None, eye=None, at=None) -> Column:
    """A vector column projected: along the line of sight (3-vectors), or its norm or squared norm over all
    components, however many."""
    if projection == "LOS":
        return los_per_row(xyz(vec), at, eye) if eye is not None and at is not None else los_global(xyz(vec), forward)
    total = F.aggregate(vec, F.lit(0.0), lambda sum_, c: sum_ + c.cast("double") * c.cast("double"))
    return F.sqrt(total) if projection == "|v|" else total


def combine(w: Column, w2: Column, op: str) -> Column:
    """Two scalars with one operator; ``/`` never fails and gives 0 over 0; unknown means ``*``. Null if
    either is null (a missing field)."""
    if op == "+":
        return w + w2
    if op == "-":
        return w - w2
    if op == "/":
        return w / F.greatest(F.abs(w2), F.lit(1e-30)) * F.signum(w2)
    if op == "min":
        return F.when(w.isNotNull() & w2.isNotNull(), F.least(w, w2))
    if op == "max":
        return F.when(w.isNotNull() & w2.isNotNull(), F.greatest(w, w2))
    return w * w2


@dataclass(frozen=True)
class FieldSpec:
    """What a map shows: weight field (op second weight), data field, vector projection, mode, range."""

    weight: str = "Masses"
    weight2: str | None = None
    op: str = "*"
    data: str = "Masses"
    projection: str = "LOS"
    mode: str = "SurfaceDensity"
    low: float = -1.0
    high: float = 3.0
    log: bool = True

    @property
    def resolve_code(self) -> int:
        return MODES[self.mode]

    @property
    def needs_quantity(self) -> bool:
        return self.mode != "SurfaceDensity"


def is_vector(df: DataFrame, field: str) -> bool:
    if field.endswith("]") and field not in df.columns:
        return False
    return isinstance(df.schema[stored_name(df.columns, field)].dataType, T.ArrayType)


def resolve_field(df: DataFrame, field: str, projection: str = "LOS", forward=(0.0, 0.0, -1.0), eye=None,
                  header=None) -> Column:
    """A scalar as it is, a vector projected; with an eye the line of sight is taken per row."""
    if not is_vector(df, field):
        return read_field(df, field, header)
    at = xyz(read_field(df, "Coordinates", header)) if eye is not None else None
    return project_vector(read_field(df, field, header), projection, forward, eye, at)


def single_field(df: DataFrame, spec: FieldSpec, forward=(0.0, 0.0, -1.0), eye=None, header=None):
    """Weight and quantity of a single map. The second weight counts only for surface density."""
    args = (spec.projection, forward, eye, header)
    weight = resolve_field(df, spec.weight, *args)
    if spec.needs_quantity:
        return weight, resolve_field(df, spec.data, *args)
    if spec.weight2 is not None:
        weight = combine(weight, resolve_field(df, spec.weight2, *args), spec.op)
    return weight, None


def slot_field(df: DataFrame, spec: FieldSpec, forward=(0.0, 0.0, -1.0), eye=None, header=None):
    """Weight and quantity of a composite slot. The second weight counts in every mode."""
    args = (spec.projection, forward, eye, header)
    weight = resolve_field(df, spec.weight, *args)
    if spec.weight2 is not None:
        weight = combine(weight, resolve_field(df, spec.weight2, *args), spec.op)
    return weight, resolve_field(df, spec.data, *args) if spec.needs_quantity else None


# ---- field lists -----------------------------------------------------------------------------


def vector_widths(df: DataFrame) -> dict[str, int]:
    """Width of every array column, from a one-row aggregate (the schema does not hold it). 0: no rows."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not names:
        return {}
    row = df.agg(*[F.max(F.size(F.col(f"`{n}`"))).alias(n) for n in names]).first()
    return {n: max(row[n] or 0, 0) for n in names}


def scalar_fields(df: DataFrame, widths: Mapping[str, int] | None = None) -> set[str]:
    """Scalar names of one type; a vector of width k is listed as ``Name[0]``..``Name[k-1]``.

    ``widths`` gives the width of array columns; without it they are read from the data.
    """
    widths = vector_widths(df) if widths is None else widths
    out = {"Masses"}
    for f in df.schema.fields:
        if f.name in SKIP_FIELDS:
            continue
        if isinstance(f.dataType, T.ArrayType):
            out.update(f"{f.name}[{i}]" for i in range(widths[f.name]))
        elif isinstance(f.dataType, T.NumericType):
            out.add(f.name)
    return out


def vector_fields(df: DataFrame, widths: Mapping[str, int] | None = None) -> set[str]:
    """Arrays of width 3."""
    widths = vector_widths(df) if widths is None else widths
    return {
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and f.name not in SKIP_FIELDS and widths[f.name] == 3
    }


def common_fields(field_sets: Sequence[set[str]]) -> list[str]:
    """Names every selected type has, ``Masses`` first."""
    common = set.intersection(*field_sets) if field_sets else set()
    return ["Masses", *sorted(common - {"Masses"})]


def toggle_type(selected: Sequence[int], ptype: int) -> list[int]:
    return sorted(set(selected) ^ {ptype})


def reset_missing(spec: FieldSpec, fields: Sequence[str]) -> FieldSpec:
    """After a type change, fields that are gone fall back to ``Masses`` (second weight: none)."""
    return replace(
        spec,
        weight=spec.weight if spec.weight in fields else "Masses",
        weight2=spec.weight2 if spec.weight2 in fields else None,
        data=spec.data if spec.data in fields else "Masses",
    )
