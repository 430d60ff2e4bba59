"""The store: batches, reruns, broken runs and merged profiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprint.operators import moments as M
from lexiprint.operators import profiles
from lexiprint.operators.store import Store

SCHEMA = "model string, text string, vec array<double>, category string"


def samples(n=90, seed=0):
    r = np.random.default_rng(seed)
    return [(f"m{i % 3}", f"text {i}", r.normal(3, 2, 4).tolist(), "essay") for i in range(n)]


def profile_rows(store):
    return {r["model"]: (r["n"], r["centroid"], r["sd"]) for r in store.profiles().collect()}


def test_batches_equal_one_batch_and_repeats_change_nothing(spark, tmp_path):
    rows = samples()
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    whole, parts = Store(spark, f"{tmp_path}/whole"), Store(spark, f"{tmp_path}/parts")
    assert whole.add("all", frame(rows)) == 90
    assert parts.add("1", frame(rows[:40] + rows[:5])) == 40
    assert parts.add("2", frame(rows[30:])) == 50
    assert parts.add("1", frame(rows[:40])) == 0 and parts.add("3", frame(rows)) == 0
    a, b = profile_rows(whole), profile_rows(parts)
    assert a.keys() == b.keys() == {"m0", "m1", "m2"}
    for m in a:
        x = np.array([r[2] for r in rows if r[0] == m])
        for n, mean, sd in (a[m], b[m]):
            assert n == 30 and np.allclose(mean, x.mean(0)) and np.allclose(sd, x.std(0, ddof=1))
    assert {r["batch"]: r["added"] for r in parts.commits().collect()} == {"1": 40, "2": 50, "3": 0}
    assert parts.fingerprints().count() == 90 and all(r["ready"] for r in parts.status().collect())


def test_what_a_broken_run_left_does_not_count(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    rows = samples(30)
    with monkeypatch.context() as broken:
        broken.setattr(M, "moments", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.add("1", spark.createDataFrame(rows, SCHEMA))
    assert store.fingerprints().count() == 0 and store.profiles().count() == 0
    assert store.add("1", spark.createDataFrame(rows[:20], SCHEMA)) == 20
    assert store.fingerprints().count() == 20 and sum(n for n, _, _ in profile_rows(store).values()) == 20


def test_extraction_is_asked_for_new_texts_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(m, t) for m, t, _, _ in samples(12)]
    seen = []

    def extract(df):
        seen.append(df.count())
        return df.withColumn("vec", F.array(F.length("text").cast("double")))

    assert store.add("a", spark.createDataFrame(rows[:8], "model string, text string"), extract) == 8
    assert store.add("b", spark.createDataFrame([*rows, (None, "x"), ("m0", None), ("m0", "")], "model string, text string"), extract) == 5
    assert seen == [8, 5] and store.fingerprints().filter("prompt is not null").count() == 0


def test_moments_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(M, "HELD", 1)
    r = np.random.default_rng(4)
    x = r.normal(1e6, 1, (200, 3))
    rows = [(None if i % 4 == 0 else f"m{i % 4}", v.tolist()) for i, v in enumerate(x)] + [("m1", None), ("m1", []), ("m1", [1.0, None, 2.0]), ("m2", [1.0, 2.0])]
    found = {(r["model"], len(r["mean"])): r for r in M.moments(spark.createDataFrame(rows, "model string, vec array<double>").repartition(5)).collect()}
    assert found.keys() == {(None, 3), ("m1", 3), ("m2", 3), ("m3", 3), ("m2", 2)}
    assert np.allclose(np.array(found[None, 3]["comoment"]).reshape(3, 3) / 49, np.cov(x[::4].T))
    assert M.moments(spark.createDataFrame([], "model string, vec array<double>")).count() == 0
    few = profiles.covariance(spark.createDataFrame([("a", [1.0, 2.0])] * 9, "model string, vec array<double>"))
    assert few.count() == 0
