"""Multi-part snapshots, layout choice, type discovery and the pooled particle table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.functions.fields import HSML_NAMES, read_field, xyz

# Labels of the numbered particle types and header keys of the softening length.
LABELS = {0: "gas", 1: "halo", 2: "disk", 3: "bulge", 4: "stars", 5: "sinks"}
SOFTENING_KEYS = ["Softening_Type{p}", "SofteningType{p}", "SofteningComovingType{p}", "Softening_Type_{p}"]
PART = r"\.(\d+)\.parquet(?:/|$)"


# ---- parts -----------------------------------------------------------------------------------


def part_number() -> Column:
    """Part number from the name of the file or of its folder: ``stem.<n>.parquet``, 0 where there is none."""
    text = F.regexp_extract(F.col("_metadata.file_path"), PART, 1)
    return F.when(text == "", 0).otherwise(text.try_cast("int"))


def read_parts(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All parts of a snapshot with ``part_no``; columns are the union over parts, absent ones null.

    ``path`` is a directory, or one part, which stands for all its siblings. A missing path fails. With a
    ``schema`` no file is opened to find the columns; without one, Spark merges those of all parts.
    """
    import re

    found = re.match(r"(.+)\.(\d+)\.parquet$", path)
    source = f"{found.group(1)}.*.parquet" if found else path
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    scan = reader.parquet(source)
    return scan.select("*", part_number().alias("part_no"))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts given as tables, by name; a column a part lacks is null there."""
    out = parts[0].withColumn("part_no", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("part_no", F.lit(i)), allowMissingColumns=True)
    return out


def header_of(headers: DataFrame) -> dict[str, float]:
    """Header of the first part as a dict (one row)."""
    row = headers.orderBy("part_no").drop("part_no").first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def layout(columns: Sequence[str]) -> str:
    """Reader for a table, from its column names."""
    have = set(columns)
    if {"x1f", "x2f", "x3f"} <= have:
        return "faces"
    if {"center", "size", "node_type"} <= have:
        return "amr"
    if "Coordinates" in have or "CenterOfMass" in have:
        return "particles"
    return "catalog"


# ---- types -----------------------------------------------------------------------------------


def types(df: DataFrame, ptype: str = "ptype", mesh: bool = False) -> DataFrame:
    """Types present with row count, label and whether they are the default selection (0, else first)."""
    counts = df.groupBy(ptype).agg(F.count(F.lit(1)).alias("n"))
    labels = F.lit("mesh") if mesh else F.element_at(
        F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv]), F.col(ptype)
    )
    first = counts.agg(F.min(F.struct(F.col(ptype) != 0, F.col(ptype)))).scalar()
    return counts.select(ptype, "n", labels.alias("label"), (F.struct(F.col(ptype) != 0, F.col(ptype)) == first).alias("selected"))


def select_types(df: DataFrame, wanted: Sequence[int], ptype: str = "ptype") -> DataFrame:
    """Rows of the wanted types; types that do not exist are ignored, none gives an empty pool."""
    return df.where(F.col(ptype).isin([int(p) for p in wanted])) if len(wanted) else df.where(F.lit(False))


# ---- smoothing length and pool ---------------------------------------------------------------


def softening(header: Mapping, p: int) -> float | None:
    """Positive softening length of a type from the header, by key spelling, then by table."""
    for key in SOFTENING_KEYS:
        value = header.get(key.format(p=p))
        if value is not None and float(value) > 0:
            return float(value)
    table = header.get("SofteningTable")
    if table is not None and p < len(table) and float(table[p]) > 0:
        return float(table[p])
    return None


def smoothing_length(df: DataFrame, p: int, header: Mapping | None = None) -> Column | None:
    """Stored length, else 2∛V, else 2∛(m/ρ) (0 without density), else the header's softening.

    None means it has to come from the neighbours. Volume and density get no unit correction.
    """
    header = header or {}
    for name in HSML_NAMES:
        if name in df.columns:
            return read_field(df, name, header)
    if "Volume" in df.columns:
        return 2.0 * F.cbrt(read_field(df, "Volume", header))
    if "Density" in df.columns and "Masses" in df.columns:
        mass, rho = read_field(df, "Masses", header), read_field(df, "Density", header)
        return 2.0 * F.cbrt(F.when(rho > 0, mass / rho).otherwise(0.0))
    value = softening(header, p)
    return None if value is None else F.lit(value)


def pool(groups: Mapping[int, DataFrame], wanted: Sequence[int], header: Mapping | None = None,
         keep: Sequence[str] = ()) -> DataFrame:
    """Selected types as one table ``ptype, x, y, z, mass, hsml`` plus ``keep`` fields.

    Types without any stored length get it from their own neighbours.
    """
    from motefield.operators.neighbours import with_smoothing_lengths

    out = None
    for p in [p for p in wanted if p in groups]:
        df = groups[p]
        x, y, z = xyz(read_field(df, "Coordinates", header))
        h = smoothing_length(df, p, header)
        cols = [F.lit(p).alias("ptype"), x.alias("x"), y.alias("y"), z.alias("z"),
                read_field(df, "Masses", header).alias("mass")]
        cols += [read_field(df, k, header).alias(k) for k in keep]
        if h is None:
            part = with_smoothing_lengths(df.select(*cols), box_size=(header or {}).get("BoxSize"))
        else:
            part = df.select(*cols, h.alias("hsml"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        some = next(iter(groups.values()))
        return some.sparkSession.createDataFrame([], "ptype int, x double, y double, z double, mass double, hsml double")
    return out


def field_names(df: DataFrame) -> DataFrame:
    """Column names of a table as rows, sorted with ``Masses`` first."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    return names.orderBy(F.col("name") != "Masses", "name")


# ---- derived-field cache ---------------------------------------------------------------------


def cached_lengths(df: DataFrame, path: str, key: Sequence[str], compute) -> DataFrame:
    """``df`` with ``hsml`` from the table at ``path``; computed and written first if absent or stale.

    The stored table is used only if ``df`` has the rows it was computed from: as many, with the same sum of row hashes. For lengths that
    are computed again only where parts changed, see `derived.kept_lengths`.
    """
    from pyspark.errors import AnalysisException

    from motefield.sources.derived import row_sum

    spark = df.sparkSession
    content = df.agg(F.count(F.lit(1)).alias("n"), row_sum(sorted(df.columns)).alias("total"))
    now = content.first()
    try:
        fresh = spark.read.parquet(f"{path}/print").first() == now
    except AnalysisException:
        fresh = False
    if not fresh:
        compute(df).select(*key, "hsml").write.mode("overwrite").parquet(f"{path}/lengths")
        spark.createDataFrame([now], content.schema).write.mode("overwrite").parquet(f"{path}/print")
    return df.drop("hsml").join(spark.read.parquet(f"{path}/lengths"), list(key))
