"""Streaming maps written by changes: equal to the batch map, tile by tile, also when batches are run again."""

import shutil

import numpy as np
import pandas as pd
import pytest

from motefield.operators.camera import Camera
from motefield.operators.splat import splat
from motefield.streaming import live

CAM = Camera((0.5, 0.5, 1.5), width=24, height=20)
SCHEMA = "x double, y double, z double, mass double, hsml double"


def delivery(spark, path, k):
    """Particles of batch k lie in a band of their own (k), or everywhere (0)."""
    rng = np.random.default_rng(k)
    low, high = (0.0, 1.0) if k == 0 else (0.1 * k, 0.1 * k + 0.05)
    df = pd.DataFrame({"x": rng.uniform(0, 1, 200), "y": rng.uniform(low, high, 200), "z": rng.uniform(0.4, 0.6, 200)}).assign(mass=1.0, hsml=0.08)
    spark.createDataFrame(df, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def pixels(df):
    return {(r.px, r.py): r.den for r in df.collect()}


def check(spark, got, path):
    want = pixels(splat(spark.read.schema(SCHEMA).parquet(path), CAM))
    got = pixels(got)
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-9)


def stream(spark, path):
    return live.live_map(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), CAM)


def test_changes_equal_the_whole_map(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        delivery(spark, source, k)
    check(spark, live.run_updates(stream(spark, source), out, CAM.height, tiles=5), source)
    first = {(r.tile, r.batch) for r in spark.read.parquet(f"{out}/versions").collect()}
    assert {b for _, b in first} == {0, 1, 2, 3} and len(first) < 4 * 5  # later batches write a few tiles only
    delivery(spark, source, 8)  # the next call goes on
    check(spark, live.run_updates(stream(spark, source), out, CAM.height, tiles=5), source)
    assert {(r.tile, r.batch) for r in spark.read.parquet(f"{out}/versions").collect()} - first == {(t, b) for t, b in live._newest(live._versions(spark, out)).items() if b == 4}


@pytest.mark.parametrize("after", ["map", "versions"])
def test_a_batch_that_is_run_again(spark, tmp_path, monkeypatch, after):
    """The stream dies in its third batch, once its tiles are written or once they are named, and is started again."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        delivery(spark, source, k)
    real = type(spark.range(1).write).parquet

    def dying(self, path, *args, **options):
        batches = len(list((tmp_path / "out" / "map").glob("batch=*")))
        real(self, path, *args, **options)
        if path.endswith("batch=2") and after == "map" or path.endswith("versions") and after == "versions" and batches == 3:
            raise OSError("lost")

    monkeypatch.setattr(type(spark.range(1).write), "parquet", dying)
    with pytest.raises(Exception, match="lost"):
        live.run_updates(stream(spark, source), out, CAM.height, tiles=5)
    monkeypatch.setattr(type(spark.range(1).write), "parquet", real)
    check(spark, live.run_updates(stream(spark, source), out, CAM.height, tiles=5), source)
    counts = [(r.tile, r.batch) for r in spark.read.parquet(f"{out}/versions").collect()]
    assert {b for _, b in counts} == {0, 1, 2, 3}


def test_nothing_yet(spark, tmp_path):
    source = str(tmp_path / "in")
    delivery(spark, source, 0)
    shutil.move(next((tmp_path / "in").glob("part-*")), tmp_path / "kept.parquet")
    assert live.run_updates(stream(spark, source), str(tmp_path / "out"), CAM.height).count() == 0
