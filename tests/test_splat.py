"""Splat geometry by hand, agreement with the flat-plane formulation, offsets and invariants."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motefield.functions.kernels import KERNELS, NORMS, supported_kernel
from motefield.operators.camera import Camera
from motefield.operators.compare import compare_maps, flat_plane_density
from motefield.operators.multigrid import splat_multigrid
from motefield.operators.neighbours import with_smoothing_lengths
from motefield.operators.resolve import colored, resolved
from motefield.operators.sampling import refinement_levels, refinement_sizes
from motefield.operators.splat import splat

CAM = Camera((0.0, 0.0, 1.0), width=4, height=4)  # fov 90: the z = 0 plane spans -1..1


def rows(spark, *points):
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double, mass double, hsml double")


def as_dict(accum):
    return {(r.px, r.py): r.den for r in accum.collect()}


def test_pixel_centre_and_origin(spark):
    # pixel (2, 1) has its centre at NDC (0.25, 0.25): right of and above the middle, row 0 on top
    got = as_dict(splat(rows(spark, (0.25, 0.25, 0.0, 2.0, 0.1)), CAM))
    assert got.keys() == {(2, 1)}
    assert got[2, 1] == pytest.approx(2.0 * NORMS["cubic_spline"] / 0.01)


def test_sub_pixel_disc_hits_nothing(spark):
    assert as_dict(splat(rows(spark, (0.0, 0.0, 0.0, 1.0, 0.1)), CAM)) == {}


def test_disc_over_two_columns(spark):
    got = as_dict(splat(rows(spark, (0.0, 0.25, 0.0, 1.0, 0.4)), CAM))
    r = 0.25 / 0.4
    want = 2 * (1 - r) ** 3 * NORMS["cubic_spline"] / 0.16
    assert got.keys() == {(1, 1), (2, 1)}
    assert all(v == pytest.approx(want) for v in got.values())


def test_depth_clip(spark):
    behind, beyond = (0.25, 0.25, 1.5, 1.0, 0.5), (0.25, 0.25, -9.5, 1.0, 5.0)
    assert as_dict(splat(rows(spark, behind, beyond), CAM)) == {}


def test_zero_length_is_skipped(spark):
    assert as_dict(splat(rows(spark, (0.25, 0.25, 0.0, 1.0, 0.0)), CAM)) == {}


def test_kernels_vanish_outside(spark):
    df = spark.range(1).select(*[supported_kernel(k, F.lit(1.0001)).alias(k) for k in KERNELS])
    assert set(df.first()) == {0.0}


def test_kernels_integrate_to_one():
    r = (np.arange(20000) + 0.5) / 20000
    w = np.where(r <= 0.5, 1 - 6 * r * r * (1 - r), 2 * (1 - r) ** 3) * NORMS["cubic_spline"]
    assert (2 * math.pi * r * w).mean() == pytest.approx(1.0, abs=1e-3)


@pytest.fixture(scope="module")
def cube(spark):
    xyz = np.random.default_rng(42).uniform(0, 1, (10_000, 3))
    df = spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz"))).withColumn("mass", F.lit(1e-4)).repartition(4)
    return with_smoothing_lengths(df, box_size=1.0).cache()


def agrees(c):
    assert 0.9 < c["mass_ratio"] < 1.1
    assert c["overlap"] > 128 * 128 * 0.5
    assert c["log_corr"] > 0.99
    assert c["median_dlog"] < 0.1


EYE = Camera((0.5, 0.5, 1.5))


@pytest.mark.parametrize("levels", [1, 4])
def test_agrees_with_flat_plane(cube, levels):
    ours = splat(cube, EYE) if levels == 1 else splat_multigrid(cube, EYE, n_levels=levels)
    agrees(compare_maps(flat_plane_density(cube, (0.5, 0.5, 0.5), 1.0, 128), ours).first())


def test_agrees_far_from_the_origin(cube):
    far = cube.select(*[(F.col(a) + 1e9).alias(a) for a in "xyz"], "mass", "hsml")
    cam = replace(EYE, position=tuple(c + 1e9 for c in EYE.position))
    agrees(compare_maps(flat_plane_density(far, (0.5 + 1e9,) * 3, 1.0, 128), splat(far, cam)).first())


def test_mass_is_kept(cube):
    # den is mass per world area at each particle's depth; on the unit plane a pixel is (2/128)² wide
    near = cube.where("z < 1e9").select("x", "y", F.lit(0.5).alias("z"), "mass", "hsml")
    cam = replace(EYE, position=(0.5, 0.5, 1.5), width=256, height=256)
    total = splat(near, cam).agg(F.sum("den")).first()[0] * (2 / 256) ** 2
    assert total == pytest.approx(1.0, rel=0.01)


def test_refinement_levels_are_nested(spark):
    df = spark.range(5000).withColumnRenamed("id", "pid")
    sizes = refinement_sizes(5000)
    assert sizes[0] == 1000 and sizes[-1] == 5000
    levels = refinement_levels(df, "pid", sizes).select("pid", "level").toPandas()
    sets = levels.groupby("level")["pid"].agg(set)
    assert all(sets[i] <= sets[i + 1] for i in range(len(sizes) - 1)) and len(sets.iloc[-1]) == 5000


def test_empty_pixels_are_black(spark):
    image = colored(splat(rows(spark, (0.25, 0.25, 0.0, 2.0, 0.1)), CAM), CAM, 0, 0.0, 1e3, False, "hot").toPandas()
    assert len(image) == 16
    lit = image[(image.r > 0) | (image.g > 0) | (image.b > 0)]
    assert list(zip(lit.px, lit.py)) == [(2, 1)] and set(image.a) == {1.0}


def test_average_and_deviation(spark):
    df = rows(spark, (0.25, 0.25, 0.0, 1.0, 0.1), (0.25, 0.25, 0.0, 3.0, 0.1)).withColumn("q", F.col("mass") * 2)
    a = splat(df, CAM, qty="q")
    assert resolved(a, 1).first()["value"] == pytest.approx(5.0)
    assert resolved(a, 2).first()["value"] == pytest.approx(math.sqrt(28 - 25))


def test_spreading_large_discs_changes_nothing(cube):
    cam = replace(EYE, position=(0.5, 0.5, 0.55))
    a, b = (splat(cube, cam, large=n).toPandas().set_index(["px", "py"])["den"].sort_index() for n in (None, 8.0))
    assert list(a.index) == list(b.index) and a.to_numpy() == pytest.approx(b.to_numpy())
