"""Column densities against brute force: gas around the eye, behind the star, copies, one hot direction."""

import math

import numpy as np
import pandas as pd
import pytest

from motefield.operators.sightline import columns, columns_for_path


def brute(gas, stars, eye):
    out = []
    for s in stars[:, :3]:
        ray = eye - s
        d = np.linalg.norm(ray)
        if d == 0:
            out.append(0.0)
            continue
        rel = gas[:, :3] - s
        t = rel @ (ray / d)
        b2 = np.maximum((rel**2).sum(1) - t * t, 0)
        h2 = gas[:, 4] ** 2
        m = (t > 0) & (t < d) & (b2 < h2)
        out.append((gas[m, 3] * 3 / (math.pi * h2[m]) * (1 - b2[m] / h2[m]) ** 2).sum())
    return np.array(out)


def run(spark, gas, stars, eye, **args):
    g = spark.createDataFrame(pd.DataFrame(gas, columns=["x", "y", "z", "mass", "hsml"])).repartition(4)
    g = g.selectExpr("*", "monotonically_increasing_id() AS pid")
    s = spark.createDataFrame(pd.DataFrame(stars, columns=list("xyz")).assign(sid=range(len(stars))))
    return columns(g, s, eye, **args).orderBy("sid").toPandas()["column"].to_numpy()


def check(spark, gas, stars, eye):
    for few in (400_000, 0):  # star cells broadcast, and shuffled
        np.testing.assert_allclose(run(spark, gas, stars, eye, few=few), brute(gas, stars, np.array(eye)), rtol=1e-7, atol=1e-9)


def gas_of(rng, n, h):
    return np.column_stack([rng.uniform(0, 1, (n, 3)), rng.uniform(1, 2, n), h])


def test_eye_outside(spark):
    rng = np.random.default_rng(1)
    check(spark, gas_of(rng, 3000, rng.uniform(0.01, 0.05, 3000)), rng.uniform(0, 1, (60, 3)), (0.5, 0.4, 3.0))


def test_eye_inside_with_huge_and_tiny_gas(spark):
    rng = np.random.default_rng(2)
    h = np.exp(rng.normal(-4, 1.5, 3000))
    stars = np.concatenate([rng.uniform(0, 1, (60, 3)), [[0.5, 0.5, 0.5]]])
    gas = gas_of(rng, 3000, h)
    gas[0, :3] = (0.5, 0.5, 0.501)  # gas that holds the eye
    check(spark, gas, stars, (0.5, 0.5, 0.5))


def test_hot_direction_and_copied_stars(spark):
    rng = np.random.default_rng(3)
    gas = gas_of(rng, 3000, np.full(3000, 0.02))
    gas[:1000, :3] = (0.3, 0.3, 0.3)
    stars = np.concatenate([np.repeat([[0.2, 0.2, 0.2]], 30, axis=0), rng.uniform(0, 1, (30, 3))])
    check(spark, gas, stars, (1.5, 1.5, 1.5))


def test_all_stars_in_one_cell_and_gas_around_the_eye(spark):
    rng = np.random.default_rng(4)
    gas = gas_of(rng, 1500, np.where(np.arange(1500) % 3 == 0, 2.0, 0.02))  # a third holds the eye
    stars = np.array([0.5, 0.5, 0.9]) + rng.uniform(0, 1e-3, (400, 3))
    check(spark, gas, stars, (0.5, 0.5, 0.5))


def test_path_reads_gas_once(spark):
    rng = np.random.default_rng(5)
    gas = spark.createDataFrame(pd.DataFrame(gas_of(rng, 300, np.full(300, 0.1)), columns=["x", "y", "z", "mass", "hsml"])).selectExpr("*", "monotonically_increasing_id() AS pid")
    stars = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 1, (9, 3)), columns=list("xyz")).assign(sid=range(9)))
    eyes = [(0.5, 0.5, 1.0 + 0.1 * i) for i in range(12)]
    got = columns_for_path(gas, stars, [*eyes, eyes[0]])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 12  # not one plan per position
    rows = got.toPandas()
    assert len(rows) == 13 * 9
    one = columns(gas, stars, eyes[3]).toPandas().sort_values("sid")
    np.testing.assert_allclose(rows[rows.cam_id == 3].sort_values("sid")["column"], one["column"])


def test_star_on_axis(spark):
    gas = np.array([[0.0, 0.0, 0.5, 1.0, 0.25], [0.0, 0.0, -0.5, 1.0, 0.25], [0.0, 0.25, 0.5, 1.0, 0.25]])
    assert run(spark, gas, np.zeros((1, 3)), (0.0, 0.0, 1.0))[0] == pytest.approx(3 / (math.pi * 0.0625))
