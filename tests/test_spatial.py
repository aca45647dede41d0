"""Spatial snapshots read by camera, and paths culled by cell: the same maps from fewer files and rows."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.operators import flight
from motefield.operators.camera import Camera, fan_out, fields_of, literal, meets, zoom_path
from motefield.operators.splat import accumulate, contributions, splat
from motefield.sources import spatial

SMALL = Camera((0.5, 0.5, 0.5), forward=(0.9, 0.3, 0.2), fov=20.0, far=0.5, width=40, height=30)


def rows(spark, n=6000, seed=1):
    rng = np.random.default_rng(seed)
    xyz = np.concatenate([rng.uniform(0, 1, (n // 2, 3)), rng.normal(0.75, 0.01, (n // 3, 3)), np.repeat([[0.7, 0.55, 0.55]], n - n // 2 - n // 3, axis=0)])
    df = pd.DataFrame(xyz, columns=list("xyz")).assign(
        hsml=rng.choice([0.006, 0.014], n) * rng.uniform(0.9, 1.1, n), mass=rng.uniform(1, 2, n), ptype=rng.choice([0, 0, 0, 1, 2], n), pid=np.arange(n))
    odd = pd.DataFrame([(None, 0.5, 0.5, 0.1, 1.0, 0, -1), (0.6, 0.5, 0.5, None, 1.0, 1, -2), (0.6, 0.5, 0.5, 0.0, 1.0, 2, -3)],
                       columns=["x", "y", "z", "hsml", "mass", "ptype", "pid"])
    schema = "x double, y double, z double, hsml double, mass double, ptype int, pid long"
    return spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
                                  for r in pd.concat([df, odd]).itertuples(index=False)], schema).repartition(4)


def pixels(accum, *keys):
    return {tuple(r[k] for k in (*keys, "px", "py")): r.den for r in accum.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9)


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spatial") / "s")
    spatial.write_spatial(rows(spark), path, rows=60)
    return path


def test_every_row_is_kept_once(spark, snapshot):
    back = spark.read.parquet(f"{snapshot}/rows").drop("octave", "part")
    df = rows(spark)
    assert back.count() == df.count() and back.select(*df.columns).exceptAll(df).count() == 0
    bounds = spark.read.parquet(f"{snapshot}/bounds")
    assert bounds.agg(F.sum("n")).first()[0] == df.count()
    # a spot that a sixth of all rows share, and the curve's cells around it, are still cut into parts
    assert bounds.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 400


def files_read(df):
    """Files that the scan of a plan without exchanges opens, from its metrics."""
    df._jdf.collectToPython()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


@pytest.mark.parametrize("cam", [SMALL, replace(SMALL, forward=(-0.2, 1.0, 0.1), fov=60.0), replace(SMALL, position=(0.7, 0.55, 0.55), far=0.05),
                                 Camera((0.5, 0.5, 1.5), width=40, height=30)])
def test_views_read_less_and_show_the_same(spark, snapshot, cam):
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)  # plans show all filters
    view = spatial.read_view(spark, snapshot, cam, [0, 2])
    same(pixels(splat(view, cam)), pixels(splat(rows(spark).where("ptype in (0, 2)"), cam)))
    plan = view._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert all(f"{op}({a}," in pushed for a in "xyz" for op in ("GreaterThanOrEqual", "LessThanOrEqual"))
    assert "part#" in plan[plan.index("PartitionFilters"): plan.index("PushedFilters")]
    if cam.far < 1:
        wanted = spark.read.parquet(f"{snapshot}/rows").where("ptype in (0, 2)")
        assert 0 < files_read(view) < 0.7 * files_read(wanted)


def test_a_view_of_nothing(spark, snapshot):
    away = replace(SMALL, position=(5.0, 5.0, 5.0), forward=(1.0, 1.0, 1.0))
    view = spatial.read_view(spark, snapshot, away)
    assert view.count() == 0 and set(view.columns) == set(rows(spark).columns)
    assert spatial.read_view(spark, snapshot, SMALL, []).count() == 0


def test_boxes_are_never_lost(spark):
    """`meets` against points: whatever a camera can draw lies in a box that it meets, and in its ranges."""
    rng = np.random.default_rng(5)
    for _ in range(12):
        cam = Camera(tuple(rng.uniform(-1, 1, 3)), tuple(rng.normal(0, 1, 3)), (0.1, 1.0, 0.2), float(rng.uniform(10, 120)), 1e-3, float(rng.uniform(0.2, 2)), 30, 20)
        df = spark.createDataFrame(pd.DataFrame(rng.uniform(-1, 1, (400, 3)), columns=list("xyz")).assign(hsml=rng.uniform(0.01, 0.3, 400), pid=np.arange(400)))
        drawn = {r.pid for r in contributions(df, literal(cam), F.lit(1.0), F.col("hsml"), keep=["pid"]).where("sigma is not null").select("pid").distinct().collect()}
        spot = {a: F.col(a) for a in "xyz"}
        met = {r.pid for r in df.where(meets(cam, spot, spot, F.col("hsml"))).collect()}
        box = spatial.frustum_box(cam, 0.3)
        held = {r.pid for r in df.collect() if all(box[a][0] <= r[a] <= box[a][1] for a in "xyz")}
        assert drawn <= met and drawn <= held


PATH = [replace(SMALL, forward=f, far=0.4) for f in ((1.0, 0.2, 0.1), (-1.0, 0.3, 0.0), (0.1, 0.2, 1.0), (0.3, -0.9, 0.2), (0.5, 0.5, 0.5))]


def path_map(frames):
    frames = frames.withColumn("cam_id", F.col("cam.cam_id"))
    hits = contributions(frames, fields_of(), F.col("mass"), F.col("hsml"), keep=["cam_id"], width=F.lit(40), height=F.lit(30), carry=["cam"])
    return pixels(accumulate(hits, ["cam_id", "px", "py"], False), "cam_id")


@pytest.mark.parametrize("few", [flight.PAIRS, 0])
def test_paths_copy_only_rows_that_may_be_seen(spark, few):
    df = rows(spark)
    culled = flight.fan_out_seen(df, PATH, few=few)
    same(path_map(culled), path_map(fan_out(df, PATH)))
    assert culled.count() < 0.3 * df.count() * len(PATH)
    plan = culled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_path_over_an_empty_table(spark):
    assert flight.fan_out_seen(rows(spark).limit(0), PATH).count() == 0


def test_zoom_path_stops_at_the_floor():
    cam = Camera((0.0, 0.0, 10.0))
    gaps = lambda path: [c.position[2] for c in path]
    path = gaps(zoom_path(cam, (0.0, 0.0, 0.0), 100, 0.5, 1.0, 0.5))
    assert path == pytest.approx([max(10 * math.exp(-0.5 * i), 0.5) for i in range(len(path))])
    assert len(path) == 10  # the floor is reached after 3 units of time, four e-foldings are over after 4
    assert len(zoom_path(cam, (0.0, 0.0, 0.0), 100, 0.5, 1.0, 1e-2)) == 15
    assert len(zoom_path(cam, (0.0, 0.0, 0.0), 4, 0.5, 1.0, 0.5)) == 4
    assert len(zoom_path(cam, (0.0, 0.0, 0.0), 100, 0.5, 1.0, 0.0)) == 100
    assert len(zoom_path(cam, (0.0, 0.0, 0.0), 100, 0.5, 1.0, 20.0)) == 10
