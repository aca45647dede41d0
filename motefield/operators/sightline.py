"""Column density between stars and the observer.

All sight lines end at the camera, so gas matches a star exactly when the star's direction lies
within the gas particle's angular radius, seen from the camera. Directions are points on the unit
sphere: each gas row falls in one grid cell at the level that fits its angular size, each star visits
the cells around it at every level in use, and an equi-join replaces the all-pairs distance test.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.raster import _expand
from motefield.operators.skew import salted_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the Arrow helpers travel with the job

LEVELS = 20  # finest cell edge 2**-19 rad; smaller discs share that level
SLACK = 1.0 + 1e-9


#: up to so many star cells (about 100 bytes each) are broadcast, and gas is not shuffled at all
BROADCAST_CELLS = 400_000

BATCH = 1 << 16  # gas rows that a task groups by cell at a time
BLOCK = 1 << 16  # pairs in one product
SMALL = 1 << 11  # groups of fewer pairs are put together


def _directions(df: DataFrame, eyes: Sequence[Sequence[float]]) -> DataFrame:
    """One row per eye: ``dx, dy, dz`` relative to it, distance ``d``, unit direction ``nx, ny, nz``, and ``spot``,
    the eye's index. The eyes are an array literal that is exploded in the scan stage."""
    all_ = [F.struct(F.lit(i).alias("i"), *[F.lit(float(e)).alias(a) for a, e in zip("xyz", eye)]) for i, eye in enumerate(eyes)]
    rel = df.withColumn("_eye", F.explode(F.array(*all_))).withColumn("spot", F.col("_eye.i"))
    rel = rel.withColumns({f"d{a}": F.col(a) - F.col(f"_eye.{a}") for a in "xyz"}).drop("_eye")
    rel = rel.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    far = F.col("d") > 0
    return rel.withColumns({f"n{a}": F.when(far, F.col(f"d{a}") / F.col("d")).otherwise(0.0) for a in "xyz"})


def _edge(level):
    """Cell edge at a level: level 0 is one cell for the whole sky, then 1, 1/2, 1/4, ..."""
    return F.get(F.lit([2.0] + [2.0 ** (1 - k) for k in range(1, LEVELS + 1)]), level)


def gas_cells(gas: DataFrame, eyes: Sequence[Sequence[float]], mass: str = "mass", hsml: str = "hsml",
              key: Sequence[str] = ("pid",)) -> DataFrame:
    """Gas with its sky cell: the finest level whose cells are no smaller than its disc."""
    h = F.col(hsml)
    rel = _directions(gas.where(h > 0), eyes)
    ratio = F.when(h < F.col("d"), h / F.col("d")).otherwise(1.0)
    rel = rel.withColumn("ratio", ratio)
    ratio = F.col("ratio")
    # a gas row around or at the eye can cover any direction
    chord = F.when(ratio < 1.0, ratio * F.sqrt(2.0 / (1.0 + F.sqrt(1.0 - ratio * ratio))) * SLACK).otherwise(2.0)
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(1.0 - F.log2(chord)))).cast("int")
    # keys are never null: Spark would filter nullable join keys again below every projection
    rel = rel.withColumn("level", F.coalesce(level, F.lit(0)))
    edge = _edge(F.col("level"))
    cells = {
        f"c{a}": F.coalesce(F.when(F.col("level") > 0, F.floor(F.col(f"n{a}") / edge)).cast("int"), F.lit(0)) for a in "xyz"
    }
    return rel.withColumns(cells).select(
        *key, "spot", "level", "cx", "cy", "cz", "dx", "dy", "dz", F.col(mass).alias("m"), (h * h).alias("h2")
    )


def star_cells(stars: DataFrame, eyes: Sequence[Sequence[float]], gas: DataFrame) -> DataFrame:
    """Stars in every cell around their direction, at every level the gas uses."""
    rel = _directions(stars, eyes).where("d > 0")
    cells = rel.withColumn("level", F.explode(levels_of(gas)))
    for a in "xyz":
        low = F.floor(F.col(f"n{a}") / _edge(F.col("level"))).cast("int")
        cells = cells.withColumn(f"_{a}", low)
        span = F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col(f"_{a}") - 1, F.col(f"_{a}") + 1))
        cells = cells.withColumn(f"c{a}", F.explode(span))
    # only cells that the unit sphere passes through can hold a direction: drop the rest before the exchange
    edge = _edge(F.col("level"))
    near = far = F.lit(0.0)
    for a in "xyz":
        lo, hi = F.col(f"c{a}") * edge, (F.col(f"c{a}") + 1) * edge
        n, f = F.greatest(lo, -hi, F.lit(0.0)), F.greatest(F.abs(lo), F.abs(hi))
        near, far = near + n * n, far + f * f
    cells = cells.where((F.col("level") == 0) | ((near <= SLACK) & (far * SLACK >= 1.0)))
    return cells.select("star", "spot", "level", "cx", "cy", "cz", "nx", "ny", "nz", "d")


def levels_of(gas: DataFrame):
    """Levels in use, at most LEVELS + 1 of them, as a scalar subquery."""
    return gas.agg(F.collect_set("level")).scalar()


class Sight:
    """Sums over the gas of one task for each direction. ``cell`` is ascending; directions of one cell are neighbours."""

    def __init__(self, cell, nx, ny, nz, d, place):
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start = np.zeros(int(cell[-1]) + 2 if len(cell) else 1, np.int64)
        self.start[:-1] = first  # every cell has a direction
        self.start[-1] = len(cell)
        self.n, self.d, self.place = np.stack([nx, ny, nz]), d, place
        size = int(place.max()) + 1 if len(place) else 0
        self.column, self.count = np.zeros(size), np.zeros(size, np.int64)

    def add(self, cell, dx, dy, dz, m, h2) -> None:
        ok = np.isfinite(dx) & np.isfinite(dy) & np.isfinite(dz)
        order = np.flatnonzero(ok)[np.argsort(cell[ok], kind="stable")]
        cell, gas = cell[order], np.stack([dx, dy, dz])[:, order]
        weight = np.where(np.isnan(m), 0.0, m)[order] * (3.0 / math.pi) / h2[order]
        h2 = h2[order]
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        rows = np.diff(at, append=len(cell))
        width = np.diff(self.start)[cell[at]] if len(at) else rows
        big = rows * width >= SMALL
        for k in np.flatnonzero(big):
            stars = slice(self.start[cell[at[k]]], self.start[cell[at[k]] + 1])
            step = max(1, BLOCK // int(width[k]))
            for lo in range(at[k], at[k] + rows[k], step):
                to = slice(lo, min(lo + step, at[k] + rows[k]))
                self._block(gas[:, to], weight[to], h2[to], stars)
        few = np.flatnonzero(np.repeat(~big, rows))
        upto = np.cumsum(np.repeat(width, rows)[few])
        lo = 0
        while lo < len(few):
            to = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4 * BLOCK, "right")))
            self._pairs(few[lo:to], cell, gas, weight, h2)
            lo = to

    def _block(self, gas, weight, h2, stars: slice) -> None:
        """All gas against all directions of a cell. The distance from the line is that of the cross product."""
        n = self.n[:, stars]
        along = gas.T @ n
        b2 = np.zeros(along.shape)
        for i, j in ((1, 2), (2, 0), (0, 1)):
            part = np.stack([gas[i], -gas[j]]).T @ np.stack([n[j], n[i]])
            part *= part
            b2 += part
        hit = (b2 < h2[:, None]) & (along > 0) & (along < self.d[stars])
        b2 /= -h2[:, None]
        b2 += 1.0
        b2 *= hit
        b2 *= b2
        place = self.place[stars]
        if np.isfinite(weight).all():
            self.column[place] += weight @ b2
        else:
            self.column[place] += np.where(hit, weight[:, None] * b2, 0.0).sum(axis=0)
        self.count[place] += hit.sum(axis=0)

    def _pairs(self, rows, cell, gas, weight, h2) -> None:
        """As `_block`, for gas in cells of little work: one entry per pair."""
        first = self.start[cell[rows]]
        width = self.start[cell[rows] + 1] - first
        g, s = np.repeat(rows, width), _expand(first, width)
        (x, y, z), (nx, ny, nz) = gas[:, g], self.n[:, s]
        along = x * nx + y * ny + z * nz
        off = (y * nz - z * ny, z * nx - x * nz, x * ny - y * nx)
        b2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
        hit = np.flatnonzero((b2 < h2[g]) & (along > 0) & (along < self.d[s]))
        g, place = g[hit], self.place[s[hit]]
        w = 1.0 - b2[hit] / h2[g]
        np.add.at(self.column, place, weight[g] * w * w)
        np.add.at(self.count, place, 1)


def _sums_in_tasks(cells: DataFrame, visits: pa.Table, star_type: str) -> DataFrame:
    """``star, spot, column, n_gas`` per task: gas looks its cell up where it is read, and its pairs are summed in arrays."""
    spark, keys = cells.sparkSession, ["spot", "level", "cx", "cy", "cz"]
    table = visits.to_pandas()
    table = table[np.isfinite(table[["nx", "ny", "nz", "d"]]).all(axis=1)]
    table["cell"] = table.groupby(keys, sort=False).ngroup()
    table["place"] = table.groupby(["star", "spot"], sort=False).ngroup()
    table = table.sort_values("cell")
    known = spark.createDataFrame(table.drop_duplicates("cell")[[*keys, "cell"]].astype({"cell": "int64"}), "spot int, level int, cx int, cy int, cz int, cell long")
    ids = table.drop_duplicates("place").sort_values("place")
    arrays = [table[c].to_numpy() for c in ("cell", "nx", "ny", "nz", "d", "place")]
    shared = spark.sparkContext.broadcast((arrays, pa.array(ids["star"], visits.schema.field("star").type), pa.array(ids["spot"], pa.int32())))
    rows = cells.join(F.broadcast(known), keys).select("cell", "dx", "dy", "dz", F.col("m").cast("double"), F.col("h2").cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, star, spot = shared.value
        sight, held, size = Sight(*arrays), [], 0

        def flush():
            if held:
                sight.add(*(c.to_numpy() for c in pa.Table.from_batches(held).columns))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BATCH:
                flush()
                held, size = [], 0
        flush()
        at = pa.array(np.flatnonzero(sight.count))
        yield pa.RecordBatch.from_arrays([star.take(at), spot.take(at), pa.array(sight.column).take(at), pa.array(sight.count).take(at)],
                                         ["star", "spot", "column", "n_gas"])

    return rows.mapInArrow(run, f"star {star_type}, spot int, column double, n_gas long")


def _sums_by_shuffle(pairs: DataFrame) -> DataFrame:
    """``star, spot, column, n_gas`` from rows of one gas and one star cell each."""
    # t: distance of the gas along the line, from the star towards the camera
    along = F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz")
    pairs = pairs.withColumn("along", along).where((F.col("along") > 0) & (F.col("along") < F.col("d")))
    off = [F.col(f"d{a}") - F.col("along") * F.col(f"n{a}") for a in "xyz"]
    pairs = pairs.withColumn("b2", off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).where("b2 < h2")
    w = 1.0 - F.col("b2") / F.col("h2")
    part = F.col("m") * (3.0 / math.pi) / F.col("h2") * w * w
    return pairs.groupBy("star", "spot").agg(F.sum(part).alias("column"), F.count(F.lit(1)).alias("n_gas"))


def columns_at(gas: DataFrame, stars: DataFrame, eyes: Sequence[Sequence[float]], mass: str = "mass", hsml: str = "hsml",
               star_id: str = "sid", key: Sequence[str] = ("pid",), few: int = BROADCAST_CELLS) -> DataFrame:
    """``star_id, spot, column, n_gas`` for every star and eye: Σ m·3/(πh²)·(1-b²/h²)² over gas nearer than h to
    the sight line; ``spot`` is the eye's index.

    Gas is read once however many eyes there are. Stars at one position share their result. Up to ``few`` star
    cells are broadcast, so gas meets them where it is read and the pairs are summed in the tasks by products of
    matrices: no row is made per pair. More cells are joined by shuffle with salts on both sides: a third of all gas in one direction, or all stars in the one cell
    that gas around an eye uses, is spread over many tasks. The sum per star is partial before the last
    exchange. A star with a null coordinate has column 0.
    """
    spots = stars.groupBy("x", "y", "z").agg(F.min(star_id).alias("star"))
    cells = gas_cells(gas, eyes, mass, hsml, key)
    visits = star_cells(spots, eyes, cells)
    keys = ["spot", "level", "cx", "cy", "cz"]
    held = visits.limit(few + 1).toArrow()
    if held.num_rows <= few:
        sums = _sums_in_tasks(cells, held, spots.schema["star"].dataType.simpleString())
        sums = sums.groupBy("star", "spot").agg(F.sum("column").alias("column"), F.sum("n_gas").alias("n_gas"))
    else:
        sums = _sums_by_shuffle(salted_join(cells, visits, keys, key, salt_small=["star"]))
    every = spots.withColumn("spot", F.explode(F.array(*[F.lit(i) for i in range(len(eyes))])))
    out = every.join(sums, ["star", "spot"], "left").select("x", "y", "z", "spot", "column", "n_gas")
    same = [stars[a].eqNullSafe(out[a]) for a in "xyz"]
    return stars.join(out, same[0] & same[1] & same[2]).select(
        star_id, "spot", F.coalesce("column", F.lit(0.0)).alias("column"), F.coalesce("n_gas", F.lit(0).cast("long")).alias("n_gas")
    )


def columns(gas: DataFrame, stars: DataFrame, eye: Sequence[float], **args) -> DataFrame:
    """``star_id, column, n_gas`` seen from one eye; see `columns_at`."""
    return columns_at(gas, stars, [eye], **args).drop("spot")


def columns_for_path(gas: DataFrame, stars: DataFrame, positions: Sequence[Sequence[float]], **args) -> DataFrame:
    """Columns per frame of a camera path: frames that only rotate share one result."""
    frames = [tuple(float(c) for c in p) for p in positions]
    eyes = list(dict.fromkeys(frames))
    cams = [F.array(*[F.lit(i) for i, p in enumerate(frames) if p == e]) for e in eyes]
    out = columns_at(gas, stars, eyes, **args)
    return out.withColumn("cam_id", F.explode(F.get(F.array(*cams), F.col("spot")))).select("cam_id", *[c for c in out.columns if c != "spot"])


def octave_histogram(gas: DataFrame, hsml: str = "hsml") -> DataFrame:
    """Rows and largest h per octave above the smallest positive h."""
    h = F.col(hsml)
    low = gas.agg(F.min(F.when(h > 0, h))).scalar()
    rel = gas.where(h > 0).select(h.alias("h"), (h / low).alias("ratio"))
    guess = F.floor(F.log2("ratio"))  # may be one off next to a power of two: a comparison decides
    octave = guess + F.when(F.col("ratio") >= F.pow(F.lit(2.0), guess + 1), 1).when(F.col("ratio") < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    return rel.groupBy(octave.cast("int").alias("octave")).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h_max"))
