import numpy as np

from lexiprint.operators import learning
from lexiprint.plans import echoes, models


def table(spark, path):
    x = np.random.default_rng(1).normal(size=(90, 64))
    rows = [(i, i % 3, [float(v) for v in x[i]]) for i in range(len(x))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return x


def test_covariance_of_all_components(spark, tmp_path):
    x = table(spark, tmp_path)
    got = {(r["model"], r["i"], r["j"]): r["cov"] for r in models.QUERIES["profile_covariance_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 * 2080
    for m in range(3):
        want = np.cov(x[m::3].T)
        assert all(abs(got[f"m{m}", i, j] - want[i, j]) < 2e-6 for i in range(64) for j in range(i, 64))


def test_forest_takes_all_components_and_default_folds(spark, tmp_path, monkeypatch):
    table(spark, tmp_path)
    seen = []
    forest = learning.forest
    monkeypatch.setattr(learning, "forest", lambda train, columns, *rest: seen.append(columns) or forest(train, columns, *rest))
    got = echoes.QUERIES["cross_validated_forest"](spark, str(tmp_path))
    assert {r["fold"] for r in got.select("fold").collect()} == set(range(5)) and got.count() == 90
    assert seen == [[f"x{i}" for i in range(64)]] * 5
