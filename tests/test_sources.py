"""Readers and rules on small hand-written tables."""

import pytest
from pyspark.sql import functions as F

from motefield.functions import fields
from motefield.functions.fields import FieldSpec
from motefield.operators import ranges
from motefield.operators.camera import Camera
from motefield.operators.overlay import cut_tracks, over_in_order, segments, track_overlay
from motefield.operators.ordering import interpolate, numbered, pick_ranks
from motefield.operators.sampling import subset
from motefield.operators.skew import hot_keys, salted_join
from motefield.operators.splat import splat
from motefield.sources import catalog, mesh, sinks, snapshot, tracks
from motefield.streaming.live import live_map, windowed_map


def test_parts_in_numeric_order(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for n, cols in ((0, {"a": [1.0], "b": [1.0]}), (2, {"a": [2.0]}), (10, {"a": [3.0], "b": [3.0]})):
        pq.write_table(pa.table(cols), tmp_path / f"snap.{n}.parquet")
    for path in (str(tmp_path), str(tmp_path / "snap.2.parquet")):
        got = [tuple(r) for r in snapshot.read_parts(spark, path).orderBy("part_no").select("part_no", "a", "b").collect()]
        assert got == [(0, 1.0, 1.0), (2, 2.0, None), (10, 3.0, 3.0)]
    with pytest.raises(Exception):
        snapshot.read_parts(spark, str(tmp_path / "none"))


def test_track_text(spark, tmp_path):
    line = lambda n, a, x: f"{n} {a} " + " ".join(["0"] * 11) + f" {x} 2 3"
    good = [line(1, 0.1, 1), line(2, 0.2, 2)]
    (tmp_path / "sink_7.txt").write_text("\n".join(["# head", "", "   ", "1 2 3", line(3, 0.15, "oops"), *good, line(4, 0.9, 4)]))
    (tmp_path / "sink_8.txt").write_text("\n".join([line(1, 0.1, 1), line(2, 0.8, 2)]))  # one sample left
    (tmp_path / "sink_x.txt").write_text("\n".join(good))
    got = tracks.read_tracks(spark, str(tmp_path), 0.5, 10.0).orderBy("nstep").collect()
    assert [tuple(r) for r in got] == [(7, 1, 0.1, 10.0, 20.0, 30.0), (7, 2, 0.2, 20.0, 20.0, 30.0)]


def test_header_rules(spark):
    df = spark.createDataFrame([(1.0,)], "Masses double")
    assert snapshot.smoothing_length(df, 2, {}) is None
    for key in ("Softening_Type2", "SofteningType2", "SofteningComovingType2", "Softening_Type_2"):
        assert snapshot.softening({key: 0.5}, 2) == 0.5
    assert snapshot.softening({"SofteningType2": 0.0, "SofteningTable": [1, 1, 0.25]}, 2) == 0.25
    assert snapshot.softening({"SofteningTable": [1, 1, 0.0]}, 2) is None
    assert fields.unit_factor("Masses", {"Time": 0.5, "HubbleParam": 0.7}) == 1.0


def test_missing_field_fails(spark):
    df = spark.createDataFrame([(1.0,)], "Masses double")
    with pytest.raises(fields.FieldNotFound):
        fields.read_field(df, "SmoothingLength")
    with pytest.raises(fields.FieldNotFound):
        snapshot.pool({0: df.withColumn("Coordinates", F.array(F.lit(0.0))).drop("Masses").withColumn("Hsml", F.lit(1.0))}, [0])


def test_empty_pool(spark):
    df = spark.createDataFrame([(1.0,)], "Masses double")
    assert snapshot.pool({0: df}, [3]).count() == 0


def test_pool_computes_missing_lengths(spark):
    df = spark.range(200).selectExpr("array(rand(1), rand(2), rand(3)) AS Coordinates", "1.0D AS Masses")
    from motefield.session import checkpoint

    pool = snapshot.pool({1: checkpoint(df)}, [1])
    assert pool.count() == 200 and pool.where("hsml > 0").count() == 200


def test_divide_by_zero_is_zero(spark):
    df = spark.createDataFrame([(6.0, 0.0), (6.0, -2.0)], "a double, b double")
    got = [r[0] for r in df.select(fields.combine(F.col("a"), F.col("b"), "/")).collect()]
    assert got == [0.0, -3.0]


def test_single_mode_ignores_second_weight(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "Masses double, T double")
    spec = FieldSpec(weight2="T", data="T", mode="WeightedAverage")
    assert df.select(fields.single_field(df, spec)[0]).first()[0] == 2.0
    assert df.select(fields.slot_field(df, spec)[0]).first()[0] == 6.0


def slots(spark, names, mesh_present=True):
    rows = [(0, i, n, not n.startswith("empty")) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "cat int, pos int, name string, loaded boolean")
    return {r.name: r.slot for r in catalog.assign_slots(df, ["cat"], mesh_present).collect()}


def test_slots(spark):
    assert slots(spark, ["star", "dm", "gas"]) == {"star": 5, "dm": 1, "gas": 2}
    assert slots(spark, ["star", "sink", "dm", "dark2", "x"]) == {"star": 4, "sink": 5, "dm": 1, "dark2": 2, "x": 3}
    assert slots(spark, ["a", "b", "c", "d", "e"]) == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 6}
    assert slots(spark, ["empty_star", "star"]) == {"star": 5}


def test_one_dimensional_amr_block(spark):
    df = spark.createDataFrame([(1, [0.5], [1.0], [2.0, 4.0]), (2, [0.5], [1.0], [9.0, 9.0])],
                               "node_type int, center array<double>, size array<double>, dens array<double>")
    got = [tuple(r) for r in mesh.amr_cells(df, (2, 1, 1), ["dens"], ndim=1).orderBy("cell").collect()]
    assert got == [(0, 0.25, 0.0, 0.0, 0.5, 2.0), (1, 0.75, 0.0, 0.0, 0.5, 4.0)]
    with pytest.raises(ValueError):
        mesh.amr_variables(["center"], ["dens"], [])


def test_range_rules(spark):
    one = lambda *v: spark.createDataFrame([(float(x), float(w)) for x, w in v], "value double, weight double")
    assert tuple(ranges.max_entropy_limits(one((1, 0), (5, 0)), "value", "weight").first()) == (1.0, 5.0)
    assert tuple(ranges.max_entropy_limits(one((-1, 1), (-5, 1)), "value", "weight", log=True).first()) == (-5.0, -1.0)
    flat = ranges.finish_range(one((3, 3)).selectExpr("value AS lo", "weight AS hi"), False).first()
    assert (flat["lo"], flat["hi"]) == (2.0, 4.0)
    thin = ranges.finish_range(one((100, 101)).selectExpr("value AS lo", "weight AS hi"), True).first()
    assert thin["hi"] - thin["lo"] == pytest.approx(2.0)
    accum = spark.createDataFrame([(0, 0, -1.0, 1.0, 1.0), (1, 0, 2.0, 1.0, 4.0), (2, 0, 3.0, 1.0, 9.0)], "px int, py int, num double, den double, sq double")
    got = ranges.auto_range(accum, 1, log=True).first()
    assert (got["lo"], got["hi"], got["log"]) == (-1.0, 3.0, False)
    assert tuple(ranges.auto_range(accum.where("px > 9"), 1).first()) == (-1.0, 3.0, True)


def test_interpolation_with_a_jump_and_clamps(spark):
    knots = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 2.0, 2.0)], "x double, yl double, yr double")
    probes = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (9.0,)], "x double")
    got = {r.x: r.y for r in interpolate(knots, probes).collect()}
    assert got == {-1.0: 0.0, 0.0: 1.0, 0.5: 1.5, 1.0: 2.0, 9.0: 2.0}


def test_ranks_with_a_hot_value(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7.0D ELSE id * 1.0D END AS v")
    values = sorted(r.v for r in df.collect())
    got = pick_ranks(df, "v", {"a": F.lit(0), "b": F.col("n") - 1, "c": F.floor(F.col("n") / 2)}).first()
    assert tuple(got) == (values[0], values[-1], values[1500])


def test_numbered_is_dense(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS k")
    got = [(r.k, r.pos) for r in numbered(df, ["k"]).orderBy("pos").collect()]
    assert [p for _, p in got] == list(range(1000)) and [k for k, _ in got] == sorted(k for k, _ in got)


def test_exact_subset(spark):
    df = spark.range(5000).withColumnRenamed("id", "pid")
    small, big = ({r.pid for r in subset(df, "pid", k).collect()} for k in (100, 900))
    assert len(small) == 100 and len(big) == 900 and small <= big
    assert subset(df, "pid", 9999).count() == 5000


def test_salted_join_with_a_hot_key(spark):
    big = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2999, "d")], "k long, s string")
    assert hot_keys(big, ["k"], 8).count() == 1
    assert salted_join(big, small, ["k"], ["id"], 8).groupBy("s").count().orderBy("s").collect() == \
        big.join(small, "k").groupBy("s").count().orderBy("s").collect()


def test_over_matches_painting_in_order(spark):
    hits = spark.range(200).selectExpr("0 AS px", "0 AS py", "id AS o", "id / 200.0D AS r", "1 - id / 200.0D AS g", "0.5D AS b")
    got = over_in_order(hits, "o", 0.05).first()
    r = cover = 0.0
    for i in range(200):
        r, cover = r * 0.95 + 0.05 * i / 200, cover * 0.95 + 0.05
    assert got["r"] == pytest.approx(r) and got["cover"] == pytest.approx(cover)


def test_track_is_as_wide_as_asked(spark):
    t = spark.createDataFrame([(1, 0, -0.5, 0.0, 0.0), (1, 1, 0.5, 0.0, 0.0)], "sink_id long, nstep long, x double, y double, z double")
    t = t.withColumns({c: F.lit(1.0) for c in "rgb"})
    segs = segments(cut_tracks(t.withColumn("aexp", F.lit(1.0)), 0.0)).withColumns({c: F.lit(1.0) for c in "rgb"})
    got = track_overlay(segs, Camera((0.0, 0.0, 1.0), width=64, height=64), ["sink_id", "nstep"], width=4.0).toPandas()
    assert set(got.groupby("px")["py"].count()) == {4} and got.px.min() == 16 and got.px.max() == 47


def test_accumulator_and_image_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(0, 1, 2.0)], "px int, py int, den double")
    sinks.write_accumulator(a, str(tmp_path / "a"))
    assert sinks.read_accumulator(spark, str(tmp_path / "a")).collect() == a.collect()
    sinks.write_image(a.withColumn("cam_id", F.lit(3)), str(tmp_path / "i"))
    assert (tmp_path / "i" / "cam_id=3").is_dir()


def test_length_cache_is_renewed_when_stale(spark, tmp_path):
    path, calls = str(tmp_path / "h"), []

    def compute(df):
        calls.append(1)
        return df.withColumn("hsml", F.col("pid") * 1.0)

    three = spark.range(3).withColumnRenamed("id", "pid")
    for df, n in ((three, 1), (three, 1), (spark.range(4).withColumnRenamed("id", "pid"), 2)):
        assert snapshot.cached_lengths(df, path, ["pid"], compute).count() == df.count() and len(calls) == n


PARTICLES = "x double, y double, z double, mass double, hsml double, ts timestamp"


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    cam = Camera((0.5, 0.5, 1.5), width=16, height=16)
    df = spark.range(300).selectExpr("(id * 37 % 101) / 101.0D x", "(id * 53 % 103) / 103.0D y", "(id * 71 % 107) / 107.0D z", "1.0D mass", "0.2D hsml")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    from motefield.streaming.live import run_to_table

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_table(live_map(stream, cam), str(tmp_path / "out"))
    rounded = lambda d: sorted((r.px, r.py, round(r.den, 6)) for r in d.collect())
    assert rounded(got) == rounded(splat(df, cam))


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    cam = Camera((0.0, 0.0, 1.0), width=4, height=4)
    row = lambda t: spark.sql(f"SELECT 0.25D x, 0.25D y, 0.0D z, 1.0D mass, 0.1D hsml, timestamp'{t}' ts")
    src = tmp_path / "in"
    for t in ("2024-01-01 00:10:00", "2024-01-01 03:00:00", "2024-01-01 00:20:00", "2024-01-01 06:00:00"):
        row(t).coalesce(1).write.mode("append").parquet(str(src))
        stream = windowed_map(spark.readStream.schema(PARTICLES).parquet(str(src)), cam, "ts", "1 hour", "10 minutes")
        q = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    one = 1.8189136353 / 0.01
    assert [r.start.hour for r in got] == [0, 3]
    assert got[0].den == pytest.approx(one)  # the late row of the first hour is not in it
