"""Sums on a grid inside the tasks against the exploded form."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from motefield.functions.kernels import KERNELS
from motefield.operators import raster
from motefield.operators.camera import Camera
from motefield.operators.splat import splat

CAM = Camera((0.5, 0.5, 1.5), width=40, height=30)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 1500
    df = pd.DataFrame(rng.uniform(0, 1, (n, 3)), columns=list("xyz")).assign(hsml=10 ** rng.uniform(-3, 0.3, n), mass=rng.uniform(1, 2, n), t=rng.normal(0, 1, n))
    odd = [(0.5, 0.5, 0.5, 0.2, 1.0, None), (None, 0.5, 0.5, 0.2, 1.0, 1.0), (0.5, 0.5, 0.5, None, 1.0, 1.0), (0.5, 0.5, 0.5, 0.0, 1.0, 1.0),
           (0.5, 0.5, 0.5, 0.2, None, 1.0), (0.5, 0.5, 9.0, 0.2, 1.0, 1.0), (0.5, 0.5, 1.4999, 0.2, 1.0, 1.0)]
    rows = [tuple(float(v) for v in r) for r in df.itertuples(index=False)] + odd
    return spark.createDataFrame(rows, "x double, y double, z double, hsml double, mass double, t double").repartition(3).cache()


def table(df):
    return {(r.px, r.py): tuple(r[c] for c in df.columns[2:]) for r in df.collect()}


def check(a, b):
    assert a.columns == b.columns
    got, want = table(a), table(b)
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kernel", KERNELS)
def test_equals_the_exploded_form(rows, kernel):
    check(raster.splat_raster(rows, CAM, kernel=kernel), splat(rows, CAM, kernel=kernel))


@pytest.mark.parametrize("at_once", [raster.AT_ONCE, 64])
def test_quantity_nulls_and_small_steps(rows, monkeypatch, at_once):
    monkeypatch.setattr(raster, "AT_ONCE", at_once)
    tilted = replace(CAM, position=(1.2, 0.9, 1.3), forward=(-0.7, -0.4, -0.8), fov=50.0)
    for cam in (CAM, tilted, replace(CAM, position=(0.5, 0.5, 0.5)), replace(CAM, width=700, height=3)):
        check(raster.splat_raster(rows, cam, qty="t"), splat(rows, cam, qty="t"))


def test_nothing_to_draw(rows):
    away = replace(CAM, position=(0.5, 0.5, -5.0))
    assert raster.splat_raster(rows, away).count() == 0
    assert raster.splat_raster(rows.limit(0), CAM, qty="t").count() == 0
