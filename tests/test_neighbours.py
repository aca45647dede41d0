"""Nearest neighbours and smoothing lengths against brute force, with copies and dense clusters."""

import numpy as np
import pandas as pd
import pytest

from motefield.operators import neighbours
from motefield.operators.kdtree import Cloud, Leaves, kernel_sums, nearest_in
from motefield.operators.neighbours import _neighbour_number, nearest, smoothing_lengths, usable_period


def brute(xyz, k, period=None):
    gap = np.abs(xyz[:, None, :] - xyz[None, :, :])
    if period:
        gap = np.minimum(gap, period - gap)
    return np.sort(np.sqrt((gap**2).sum(axis=2)), axis=1)[:, :k]


def frame(spark, xyz):
    return spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz"))).repartition(4)


def check(spark, xyz, k, period=None):
    got = nearest(frame(spark, xyz), k, period).toPandas()
    want = {tuple(p): d for p, d in zip(xyz, brute(xyz, k, period))}
    assert len(got) == len(want)
    for r in got.itertuples():
        np.testing.assert_allclose(r.distances, want[r.x, r.y, r.z], rtol=1e-9, atol=1e-12)


def test_uniform(spark):
    check(spark, np.random.default_rng(1).uniform(0, 1, (1500, 3)), 20)


def test_periodic(spark):
    check(spark, np.random.default_rng(2).uniform(0, 1, (1200, 3)), 20, 1.0)


def test_a_third_in_one_place_and_a_dense_cluster(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([
        np.repeat([[0.25, 0.5, 0.75]], 500, axis=0), rng.normal(0.6, 1e-4, (500, 3)), rng.uniform(0, 1, (500, 3)),
        np.repeat(rng.uniform(0, 1, (20, 3)), 7, axis=0),
    ])
    check(spark, xyz, 16)


def test_fewer_rows_than_neighbours(spark):
    got = nearest(frame(spark, np.random.default_rng(4).uniform(0, 1, (10, 3))), 16).toPandas()
    assert (got.distances.str.len() == 10).all()


def test_smoothing_length_reaches_the_target(spark):
    xyz = np.random.default_rng(5).uniform(0, 1, (2000, 3))
    got = smoothing_lengths(frame(spark, xyz), box_size=1.0).toPandas()
    assert len(got) == 2000
    dist = brute(got[["x", "y", "z"]].to_numpy(), 200, 1.0)
    n = _neighbour_number(got.hsml.to_numpy(), dist)
    assert np.abs(n - 32).max() < 0.32


def test_period_needs_every_row_inside(spark):
    inside = frame(spark, np.array([[0.0, 0.5, 0.9]]))
    assert usable_period(inside, 1.0) == 1.0
    assert usable_period(inside, 0.9) is None and usable_period(inside, 0.0) is None and usable_period(inside, None) is None


def test_distances_include_the_row_itself(spark):
    got = nearest(frame(spark, np.array([[0.0, 0.0, 0.0], [3.0, 4.0, 0.0]])), 2).toPandas()
    assert all(list(d) == pytest.approx([0.0, 5.0]) for d in got.distances)


def solved_over_all_rows(xyz, target=32.0):
    dist = brute(xyz, len(xyz))
    lo, hi = np.zeros(len(xyz)), np.full(len(xyz), 8.0)
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        over = _neighbour_number(mid, dist) >= target
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
    return {tuple(p): h for p, h in zip(xyz, 0.5 * (lo + hi))}


def test_smoothing_length_beyond_any_list(spark):
    """One row faces a cluster of thousands; the solution lies beyond its 50 nearest, and beyond 1 600."""
    rng = np.random.default_rng(6)
    xyz = np.concatenate([[[0.0, 0.0, 0.0]], [1.0, 0.0, 0.0] + rng.normal(0, 0.01, (2500, 3)), rng.uniform(0, 1, (40, 3))])
    got = smoothing_lengths(frame(spark, xyz)).toPandas()
    want = solved_over_all_rows(xyz)
    assert len(got) == len(xyz)
    np.testing.assert_allclose(got.hsml, [want[r.x, r.y, r.z] for r in got.itertuples()], rtol=1e-8)


def test_smoothing_length_of_few_rows(spark):
    xyz = np.random.default_rng(7).uniform(0, 1, (9, 3))
    got = smoothing_lengths(frame(spark, xyz)).toPandas()
    want = solved_over_all_rows(xyz)
    np.testing.assert_allclose(got.hsml, [want[r.x, r.y, r.z] for r in got.itertuples()], rtol=1e-8)


def test_null_coordinates_keep_their_row(spark):
    rows = [(float(i), 0.0, 0.0) for i in range(40)] + [(None, 1.0, 1.0)]
    from motefield.operators.neighbours import with_smoothing_lengths

    got = with_smoothing_lengths(spark.createDataFrame(rows, "x double, y double, z double"))
    assert got.count() == 41 and got.where("hsml is null").count() == 1


# ---- many leaves ------------------------------------------------------------------------------


@pytest.fixture
def many_leaves(monkeypatch):
    """Leaves of some 100 rows, and visits in groups of 100."""
    monkeypatch.setattr(neighbours, "LEAF", 120)
    monkeypatch.setattr(neighbours, "VISITS", 100)


def test_leaves_uniform_and_periodic(spark, many_leaves):
    xyz = np.random.default_rng(11).uniform(0, 1, (1500, 3))
    check(spark, xyz, 20)
    check(spark, xyz, 20, 1.0)


def test_leaves_in_one_spot(spark, many_leaves):
    """All rows within a few units in the last place, far from the origin: one cell of any grid over the box of the data plus one row."""
    rng = np.random.default_rng(12)
    check(spark, np.concatenate([1e6 + rng.integers(0, 12, (900, 3)) * 2.0**-30, [[0.0, 0.0, 0.0]]]), 16)


def test_leaves_with_outliers_copies_and_a_cluster(spark, many_leaves):
    rng = np.random.default_rng(13)
    check(spark, np.concatenate([
        np.repeat([[0.25, 0.5, 0.75]], 600, axis=0), rng.normal(0.6, 1e-4, (700, 3)), rng.uniform(0, 1, (300, 3)),
        rng.uniform(-50, 50, (30, 3)), np.repeat(rng.uniform(0, 1, (20, 3)), 7, axis=0)]), 16)


def test_ball_wider_than_half_the_period(spark, many_leaves):
    check(spark, np.random.default_rng(14).uniform(0, 1, (130, 3)), 120, 1.0)


def test_smoothing_over_many_leaves(spark, many_leaves):
    rng = np.random.default_rng(15)
    xyz = np.concatenate([[[0.0, 0.0, 0.0]], [1.0, 0.0, 0.0] + rng.normal(0, 0.01, (1200, 3)), rng.uniform(0, 1, (400, 3))])
    got = smoothing_lengths(frame(spark, xyz)).toPandas()
    want = solved_over_all_rows(xyz)
    assert len(got) == len(xyz)
    np.testing.assert_allclose(got.hsml, [want[r.x, r.y, r.z] for r in got.itertuples()], rtol=1e-8)
    periodic = smoothing_lengths(frame(spark, xyz[-400:]), box_size=1.0).toPandas()
    n = _neighbour_number(periodic.hsml.to_numpy(), brute(periodic[["x", "y", "z"]].to_numpy(), 400, 1.0))
    assert np.abs(n - 32).max() < 1e-6


def test_no_exchange_by_row(spark, many_leaves):
    """Rows are exchanged by leaf (and salt) only; the plan that counts their neighbours has no key of a row."""
    import re

    found = nearest(frame(spark, np.random.default_rng(16).uniform(0, 1, (800, 3))), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)}
    assert keys and keys <= {"leaf", "home", "leaf, salt"}
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([(None, 1.0, 2.0)], "x double, y double, z double")
    assert nearest(empty).count() == 0 and smoothing_lengths(empty).count() == 0


def test_leaves_are_balanced():
    rng = np.random.default_rng(17)
    xyz = np.concatenate([rng.normal(0, 1e-6, (30_000, 3)), rng.uniform(-1, 1, (10_000, 3))])
    leaves = Leaves.of(xyz[rng.choice(len(xyz), 4096, replace=False)], 6)
    size = np.bincount(leaves.number(xyz), minlength=64)
    assert size.max() < 2 * len(xyz) / 64


def test_search_and_sums_inside_a_leaf():
    rng = np.random.default_rng(18)
    xyz, copies = rng.uniform(0, 1, (700, 3)), rng.integers(1, 4, 700)
    cloud, queries = Cloud(xyz, copies), Cloud(rng.uniform(-0.2, 1.2, (150, 3)))
    got = nearest_in(cloud, queries, np.full(150, 0.05), 12)
    d2 = ((queries.xyz[:, None] - np.repeat(xyz, copies, axis=0)[None]) ** 2).sum(axis=2)
    want = np.sort(np.where(d2 <= 0.05, d2, np.inf), axis=1)[:, :12]
    np.testing.assert_allclose(got, want, rtol=1e-12)
    h = np.linspace(0.05, 0.4, 9)[None, :] * np.ones((150, 1))
    sums = kernel_sums(cloud, queries, h) * (32 / 3)
    for j in range(9):
        np.testing.assert_allclose(sums[:, j], _neighbour_number(h[:, j], np.sqrt(d2)), rtol=1e-9, atol=1e-9)
