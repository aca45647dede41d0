"""Steps whose work must not outgrow their input: what the plans and tasks do, and that the results are those of plain forms."""

import math

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from motefield.operators import ordering, overlay, raster, sampling, sightline
from motefield.operators.camera import Camera
from motefield.operators.splat import splat
from motefield.queries import streams
from motefield.sources import spatial

CAM = Camera((0.5, 0.5, 1.5), width=40, height=30)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stars(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), *map(float, rng.uniform(0, 1, 3)), float(10 ** rng.uniform(-2, 5)), *map(float, rng.uniform(0, 1, 3))) for k in rng.permutation(300)]
    rows += [(None, 0.5, 0.5, 0.9, 1e4, 0.1, 0.2, 0.3), (301, None, 0.5, 0.9, 1e4, 0.1, 0.2, 0.3), (302, 0.2, 0.5, 0.9, 1e3, None, 0.2, 0.3),
             (303, 0.5, 0.5, 1.6, 1e4, 0.1, 0.2, 0.3), (304, 0.6, 0.5, 0.9, None, 0.1, 0.2, 0.3)]
    return spark.createDataFrame(rows, "sid long, x double, y double, z double, luminosity double, fill_r double, fill_g double, fill_b double")


@pytest.mark.parametrize("alpha", [1.0, 0.6])
def test_markers_are_drawn_without_a_row_per_pixel(spark, alpha):
    s = stars(spark).repartition(5)
    got = overlay.marker_overlay(s, CAM, 1e-3, "sid", opacity=alpha)
    assert "Generate" not in plan(got) and "MapInArrow" in plan(got)
    hits = overlay.star_discs(s, CAM, "luminosity", 1e-3, keep=["sid", "fill_r", "fill_g", "fill_b"])
    rgb = [F.when(F.sqrt("r2") <= 0.8, F.col(f"fill_{c}")).otherwise(F.lit(1.0)).alias(c) for c in "rgb"]
    want = overlay.over_in_order(hits.select("px", "py", "sid", *rgb), "sid", alpha)
    a, b = ({(r.px, r.py): (r.r, r.g, r.b, r.cover) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 500
    nan = lambda rows: [[math.nan if v is None else v for v in rows[k]] for k in b]
    np.testing.assert_allclose(nan(a), nan(b), rtol=1e-9, atol=1e-12)


def test_an_opaque_marker_without_an_order_has_no_colour(spark):
    one = stars(spark).where("sid is null")
    got = overlay.marker_overlay(one, CAM, 1e-3, "sid").collect()
    assert got and all(r.r is None and r.cover == 1.0 for r in got)
    assert overlay.marker_overlay(one.limit(0), CAM, 1e-3, "sid").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 200])
def test_ranges_are_found_by_halving(spark, n):
    keys = [None, float("nan"), float("-inf"), *np.random.default_rng(n).integers(0, 50, 300).astype(float).tolist()]
    df = spark.createDataFrame([(k,) for k in keys], "k double")
    bounds = np.sort(np.random.default_rng(n + 1).integers(0, 50, n - 1)).astype(float)
    cut = ordering.in_bucket(df, "k", F.lit(bounds.tolist()).cast("array<double>"), n)
    assert "lambda" not in plan(cut)
    for r in cut.collect():
        assert r._b == (0 if r.k is None else len(bounds) if math.isnan(r.k) else np.searchsorted(bounds, r.k, "left"))


def test_no_ranges_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k double, w double")
    assert ordering.numbered(df, ["k"]).count() == 0


def test_refinement_hashes_a_row_once(spark):
    sizes = sampling.refinement_sizes(20_000)
    df = spark.range(20_000).select(F.col("id").alias("pid")).unionByName(spark.sql("SELECT cast(null AS long) AS pid"))
    levels = sampling.refinement_levels(df, "pid", sizes)
    assert plan(levels).count("md5(") == 1
    got = levels.groupBy("pid").agg(F.min("level").alias("first"), F.count(F.lit(1)).alias("n")).join(
        df.withColumn("u", sampling.order_key("pid")), "pid").toPandas()
    want = np.searchsorted(np.array(sizes[:-1]) / sizes[-1], got["u"], "right")
    assert (got["first"] == want).all() and (got["n"] == len(sizes) - want).all()
    assert [r.level for r in levels.where("pid is null").collect()] == [len(sizes) - 1]


def test_small_parts_do_not_make_as_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 1, (3000, 3)), columns=list("xyz")).assign(hsml=0.01, mass=1.0, ptype=rng.integers(0, 2, 3000)))
    spatial.write_spatial(df, str(tmp_path / "s"), rows=20)
    files = [p.name for p in (tmp_path / "s" / "rows").rglob("part-*.parquet")]
    assert len(files) >= 150 and len({f.split("-")[1] for f in files}) <= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "s" / "rows")).count() == 3000
    assert spark.read.parquet(str(tmp_path / "s" / "bounds")).groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= 20


def test_a_stream_has_as_many_files_as_its_table_has_splits(spark, tmp_path, monkeypatch):
    n = 4000
    k = F.col("id")
    lines = spark.range(0, n, 1, 10).select(
        k.alias("l_orderkey"), (k * 7 % 101).alias("l_partkey"), (k * 3 % 17).alias("l_suppkey"), (k % 7).cast("int").alias("l_linenumber"),
        F.lit(2.0).alias("l_quantity"), (k * 1.5).alias("l_extendedprice"), F.lit(0.02).alias("l_discount"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a split per file
    try:
        monkeypatch.setattr(streams, "fresh", lambda spark, name: str(tmp_path / name))
        got = streams.i01(spark, str(tmp_path))
        files = list((tmp_path / "live" / "in").glob("part-*.parquet"))
        assert len(files) == 12 and sum(pq.read_metadata(f).num_rows for f in files) == n
        assert {p.name for p in (tmp_path / "live" / "map").glob("batch=*")} == {"batch=0", "batch=1"}
        whole = splat(streams.raw(spark, str(tmp_path), "lineitem").transform(lambda b: spark.sql(streams.PARTICLE.replace("FROM lineitem", "FROM {b}"), b=b)), streams.CAM)
        assert got.count() == whole.count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_sight_lines_make_no_row_per_pair(spark, monkeypatch, small):
    monkeypatch.setattr(sightline, "SMALL", small)
    rng = np.random.default_rng(4)
    gas = pd.DataFrame(rng.uniform(0, 1, (800, 3)), columns=list("xyz")).assign(mass=rng.uniform(1, 2, 800), hsml=10 ** rng.uniform(-2, 0.3, 800), pid=np.arange(800))
    eye, s = np.array([0.5, 0.45, 0.55]), rng.uniform(0, 1, (40, 3))
    odd = [(None, 0.5, 0.5, 1.0, 0.2, -1), (0.4, 0.5, 0.5, None, 0.0, -2)]
    g = spark.createDataFrame([tuple(map(float, r[:5])) + (int(r[5]),) for r in gas.itertuples(index=False)] + odd, "x double, y double, z double, mass double, hsml double, pid long")
    t = spark.createDataFrame(pd.DataFrame(s, columns=list("xyz")).assign(sid=[f"s{k}" for k in range(40)]))
    out = sightline.columns(g, t, eye.tolist())
    assert "MapInArrow" in plan(out)
    got = {r.sid: (r["column"], r.n_gas) for r in out.collect()}
    for k in range(40):
        ray = eye - s[k]
        d = np.linalg.norm(ray)
        rel = gas[list("xyz")].to_numpy() - s[k]
        along = rel @ ray / d
        b2 = (rel * rel).sum(1) - along * along
        h2 = gas.hsml.to_numpy() ** 2
        hit = (along > 0) & (along < d) & (b2 < h2)
        want = (gas.mass * 3 / math.pi / h2 * (1 - b2 / h2) ** 2)[hit].sum()
        assert got[f"s{k}"][1] == hit.sum()
        assert got[f"s{k}"][0] == pytest.approx(want, rel=1e-9)


def test_wide_discs_are_not_cut_to_rows(monkeypatch):
    rng = np.random.default_rng(5)
    n = 200
    cx, cy, rx = rng.uniform(-10, 50, n), rng.uniform(-10, 40, n), rng.uniform(20, 90, n)
    a, q = rng.uniform(1, 2, n), np.where(rng.uniform(0, 1, n) < 0.1, np.nan, rng.normal(0, 1, n))
    for kernel in ("cubic_spline", "sphere"):
        whole, cut = raster.Grid(40, 30, True, kernel), raster.Grid(40, 30, True, kernel)
        monkeypatch.setattr(raster, "WIDE", 4)
        real, rows = raster.Grid._rows, []
        monkeypatch.setattr(raster.Grid, "_rows", lambda self, py, *args: rows.append(len(py)) or real(self, py, *args))
        whole.add(cx, cy, rx, rx, a, q)
        drawn, rows[:] = sum(rows), []
        monkeypatch.setattr(raster, "WIDE", 0)
        cut.add(cx, cy, rx, rx, a, q)
        assert drawn < 0.4 * sum(rows)
        monkeypatch.undo()
        assert (whole.hit == cut.hit).all()
        np.testing.assert_allclose(whole.sums, cut.sums, rtol=1e-9, atol=1e-9)
