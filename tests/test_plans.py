"""Whole jobs on derived particles."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from motefield.functions.fields import FieldSpec
from motefield.operators.camera import Camera, zoom_path
from motefield.operators.splat import splat
from motefield.plans.snapshot import composite_image, field_image, fly_through
from motefield.sources.tables import derived

CAM = Camera((0.5, 0.5, 1.5), width=24, height=24)


@pytest.fixture(scope="module")
def pool(spark):
    p = derived(spark, "/root/testdata/sf0.001", "particle")
    return p.select("x", "y", "z", "hsml", F.col("mass").alias("Masses"), F.col("temperature").alias("Temperature"),
                    F.array("vx", "vy", "vz").alias("Velocities"), F.array("x", "y", "z").alias("Coordinates"), "mass")


def test_field_image_uses_the_whole_range(pool):
    image = field_image(pool, CAM, FieldSpec(data="Temperature", mode="WeightedAverage", log=False)).toPandas()
    assert len(image) == 24 * 24 and image.r.max() > 0.9 and image.r[image.r > 0].min() < 0.3


def test_composite_image_covers_the_map(pool):
    light, tint = FieldSpec(), FieldSpec(data="Velocities", mode="WeightedVariance", log=False)
    image = composite_image(pool, CAM, light, tint).toPandas()
    assert len(image) == splat(pool, CAM).count() and image[["r", "g", "b"]].max().max() > 0.5


def test_fly_through_equals_single_frames(pool):
    path = zoom_path(CAM, (0.5, 0.5, 0.5), 3, 0.5, 1.0, 0.3)
    frames = fly_through(pool, path, FieldSpec()).toPandas()
    for i, cam in enumerate(path):
        one = splat(pool, replace(cam)).toPandas().set_index(["px", "py"])["den"].sort_index()
        got = frames[frames.cam_id == i].set_index(["px", "py"])["den"].sort_index()
        assert list(one.index) == list(got.index) and got.to_numpy() == pytest.approx(one.to_numpy())


def test_stars_take_units_and_luminosities_from_what_is_stored(spark, tmp_path):
    from motefield.plans.reader import load_stars

    stars = "array(1D, 2D, 4D) AS Coordinates, 3D AS Masses"
    header = spark.range(1).selectExpr("1 AS ComovingIntegrationOn", "0.5D AS Time", "0.5D AS HubbleParam")
    cases = {"plain": (stars, (6.0, 1.4 * 6.0**3.5)), "sink": (stars + ", 1D AS Sink_Mass", (1.0, 1.0)),
             "given": (stars + ", 7 AS StarLuminosity", (6.0, 7.0)), "solar": (stars + ", 7 AS StarLuminosity, 8 AS StarLuminosity_Solar", (6.0, 8.0))}
    for name, (columns, (mass, light)) in cases.items():
        path = f"{tmp_path}/{name}"
        spark.sql(f"SELECT {columns}").write.parquet(f"{path}/PartType4/s.0.parquet")
        header.write.parquet(f"{path}/Header/s.0.parquet")
        row = load_stars(spark, path).first()
        assert (row.x, row.y, row.z) == (1.0, 2.0, 4.0) and row.mass == mass
        assert abs(row.luminosity - light) < 1e-9 * light
