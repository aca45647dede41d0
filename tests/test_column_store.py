"""Column densities kept between calls."""

import math

import numpy as np
import pandas as pd
import pytest

from motefield.operators import column_store
from motefield.operators.column_store import columns_kept, known_eyes
from motefield.operators.sightline import columns_for_path


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    gas = pd.DataFrame(rng.uniform(0, 1, (4000, 3)), columns=list("xyz")).assign(mass=rng.uniform(1, 2, 4000), hsml=rng.uniform(0.02, 0.1, 4000), pid=np.arange(4000))
    path = str(tmp_path_factory.mktemp("gas") / "gas_rows.parquet")
    spark.createDataFrame(gas).write.parquet(path)
    stars = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 1, (30, 3)), columns=list("xyz")).assign(sid=np.arange(30)))
    return spark.read.parquet(path), stars


def same(got, want):
    key = lambda df: {(r.cam_id, r.sid): (r.column, r.n_gas) for r in df.collect()}
    got, want = key(got), key(want)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0], rel_tol=1e-9) and got[k][1] == want[k][1] for k in want)


A, B, C = (0.5, 0.5, 2.0), (0.1, -0.4, 1.5), (-1.0, 0.2, 0.3)


def test_only_missing_eyes_are_computed(spark, tables, tmp_path, monkeypatch):
    store, calls, real = str(tmp_path), [], column_store.columns_at
    monkeypatch.setattr(column_store, "columns_at", lambda gas, stars, eyes, **args: calls.append(list(eyes)) or real(gas, stars, eyes, **args))
    for path in ([A, A], [A, B, A], [B, A], [C, B]):
        same(columns_kept(store, "s1", *tables, path), columns_for_path(*tables, path))
    assert calls == [[A], [B], [C]]
    again = columns_kept(store, "s1", *tables, [C, A, B])
    plan = again._jdf.queryExecution().toString()
    assert "gas_rows" not in plan and "mass" not in plan
    assert len(calls) == 3
    columns_kept(store, "s2", *tables, [A])  # other data: nothing is known of it
    assert calls[3:] == [[A]]


def test_a_batch_without_a_commit_is_not_read(spark, tables, tmp_path, monkeypatch):
    store, real = str(tmp_path), column_store.columns_at
    columns_kept(store, "s", *tables, [A])
    broken = lambda gas, stars, eyes, **args: real(gas, stars, eyes, **args).withColumn("column", column_store.F.raise_error(column_store.F.lit("lost")).cast("double"))
    monkeypatch.setattr(column_store, "columns_at", broken)
    with pytest.raises(Exception, match="lost"):
        columns_kept(store, "s", *tables, [A, B])
    assert known_eyes(spark, store, "s").count() == 1
    monkeypatch.setattr(column_store, "columns_at", real)
    same(columns_kept(store, "s", *tables, [B, A]), columns_for_path(*tables, [B, A]))


def test_two_writers_of_one_eye_give_one_result(spark, tables, tmp_path, monkeypatch):
    store = str(tmp_path)
    columns_kept(store, "s", *tables, [A])
    nothing = spark.createDataFrame([], "ex double, ey double, ez double, batch string")
    real = column_store.known_eyes
    answers = iter([nothing])  # a writer that looked before the first one committed
    monkeypatch.setattr(column_store, "known_eyes", lambda *a: next(answers, None) or real(*a))
    same(columns_kept(store, "s", *tables, [A, B]), columns_for_path(*tables, [A, B]))
    monkeypatch.setattr(column_store, "known_eyes", real)
    same(columns_kept(store, "s", *tables, [B, A, A]), columns_for_path(*tables, [B, A, A]))
