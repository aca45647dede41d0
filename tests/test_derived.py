"""Lengths kept by part: only what changed, and what depends on it, is computed again."""

import numpy as np
import pandas as pd
import pytest

from motefield.operators.neighbours import smoothing_lengths
from motefield.sources import derived


def table(spark, xyz, pid=None, wide=1.0):
    pid = np.arange(len(xyz)) if pid is None else pid
    part = np.clip(np.floor(xyz[:, 0] / wide * 8), 0, 7).astype(int)
    return spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz")).assign(pid=pid, part=part, note="n")).repartition(3)


@pytest.fixture
def solved_rows(monkeypatch):
    """Rows that the solver was given, call by call."""
    seen, real = [], derived.smoothing_lengths

    def spy(df, **args):
        seen.append(df.count())
        return real(df, **args)

    monkeypatch.setattr(derived, "smoothing_lengths", spy)
    return seen


def lengths(df):
    return {r.pid: r.hsml for r in df.select("pid", "hsml").collect()}


def same_as_whole(kept, df, box_size=None):
    want = {(r.x, r.y, r.z): r.hsml for r in smoothing_lengths(df.select("x", "y", "z"), box_size=box_size).collect()}
    got = kept.select("pid", "x", "y", "z", "hsml").collect()
    assert len(got) == df.count()
    np.testing.assert_allclose([r.hsml for r in got], [want[r.x, r.y, r.z] for r in got], rtol=1e-8)


def test_only_changed_parts_are_computed(spark, tmp_path, solved_rows):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(0, 1, (2400, 3)) * [4.0, 1.0, 1.0]
    path = str(tmp_path / "k")
    first = table(spark, xyz, wide=4.0)
    same_as_whole(derived.kept_lengths(first, path, ["pid"]), first)
    assert solved_rows == [2400]
    again = derived.kept_lengths(table(spark, xyz[::-1], np.arange(2400)[::-1], 4.0), path, ["pid"])  # other order, same rows
    assert set(again.columns) == {"x", "y", "z", "pid", "part", "note", "hsml"} and len(lengths(again)) == 2400 and solved_rows == [2400]

    moved = xyz.copy()
    at = np.flatnonzero(xyz[:, 0] >= 3.5)
    moved[at[:40], 1] = rng.uniform(0, 1, 40)  # as many rows as before
    same_as_whole(derived.kept_lengths(table(spark, moved, wide=4.0), path, ["pid"]), table(spark, moved, wide=4.0))
    assert len(solved_rows) == 2 and solved_rows[1] < 1200

    gone = moved[moved[:, 0] < 3.5]  # a part vanishes: its neighbours' lengths grow
    kept = np.flatnonzero(moved[:, 0] < 3.5)
    same_as_whole(derived.kept_lengths(table(spark, gone, kept, 4.0), path, ["pid"]), table(spark, gone, kept, 4.0))
    more = np.concatenate([gone, [[3.8, 0.5, 0.5], [3.8, 0.5, 0.5], [9.0, 0.5, 0.5]]])  # a new part of few rows far from all others
    same_as_whole(derived.kept_lengths(table(spark, more, wide=4.0), path, ["pid"]), table(spark, more, wide=4.0))


def test_periodic_borders(spark, tmp_path, solved_rows):
    rng = np.random.default_rng(2)
    xyz = rng.uniform(0, 1, (1500, 3))
    path = str(tmp_path / "p")
    derived.kept_lengths(table(spark, xyz), path, ["pid"], box_size=1.0)
    changed = xyz[(xyz[:, 0] < 0.875) | (np.arange(1500) % 2 == 0)]
    pid = np.flatnonzero((xyz[:, 0] < 0.875) | (np.arange(1500) % 2 == 0))
    kept = derived.kept_lengths(table(spark, changed, pid), path, ["pid"], box_size=1.0)
    same_as_whole(kept, table(spark, changed, pid), 1.0)  # rows at the other end of the box too


def test_a_call_that_died_is_made_good(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(0, 1, (900, 3))
    path = str(tmp_path / "d")
    derived.kept_lengths(table(spark, xyz), path, ["pid"])
    pid = np.flatnonzero((xyz[:, 0] < 0.875) | (np.arange(900) % 2 == 0))
    fewer = xyz[pid]
    real = derived._around
    monkeypatch.setattr(derived, "_around", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        derived.kept_lengths(table(spark, fewer, pid), path, ["pid"])
    monkeypatch.setattr(derived, "_around", real)
    same_as_whole(derived.kept_lengths(table(spark, fewer, pid), path, ["pid"]), table(spark, fewer, pid))


def test_nulls_and_small_tables(spark, tmp_path):
    schema = "pid long, part int, x double, y double, z double"
    rows = [(k, 0, 0.1 * k, 0.0, 0.0) for k in range(5)] + [(9, 1, None, 0.0, 0.0)]
    kept = lengths(derived.kept_lengths(spark.createDataFrame(rows, schema), str(tmp_path / "n"), ["pid"]))
    assert kept[9] is None and all(kept[k] > 0 for k in range(5))
    rows[5] = (9, 1, None, 1.0, 0.0)
    assert lengths(derived.kept_lengths(spark.createDataFrame(rows, schema), str(tmp_path / "n"), ["pid"])) == kept
    rows.append((10, 2, 0.25, 0.0, 0.0))
    df = spark.createDataFrame(rows, schema)
    same = lengths(derived.kept_lengths(df, str(tmp_path / "n"), ["pid"]))
    want = {r.x: r.hsml for r in smoothing_lengths(df.select("x", "y", "z")).collect()}
    assert same[10] == pytest.approx(want[0.25]) and same[0] == pytest.approx(want[0.0])
