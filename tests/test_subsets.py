"""Configurations judged together against each judged by itself in numpy."""

import numpy as np
import pytest

from lexiprint.operators import subsets as B

SCHEMA = "id long, model string, vec array<double>"


def plain(rows, chosen, folds=5):
    ids, names = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows])[:, chosen]
    said = []
    for i in range(len(rows)):
        train = ids % folds != ids[i] % folds
        known = sorted(set(names[train]))
        centre = {m: x[train & (names == m)].mean(0) for m in known}
        spread = np.maximum(np.mean([(x[j] - centre[names[j]]) ** 2 for j in np.nonzero(train)[0]], axis=0), B.LEAST_SPREAD)
        said.append(min(known, key=lambda m: (((x[i] - centre[m]) ** 2 / spread).sum(), m)))
    return names, np.array(said)


def test_configurations_against_numpy(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(3, 39)) * 0.4
    rows = [(i, f"m {i % 3}", (centres[i % 3] + r.normal(size=39)).tolist()) for i in range(150)]
    docs = spark.createDataFrame(rows + [(None, "m 1", [0.0] * 39), (7, None, [0.0] * 39), (8, "m 1", None), (9, "m 1", [1.0])], SCHEMA)
    subsets = B.places()
    assert [len(v) for v in subsets.values()] == [5, 15, 6, 6, 7, 20, 32, 39, 17, 27, 12]
    got = {x["config"]: x for x in B.judged(B.predictions(docs.repartition(4), subsets), subsets).collect()}
    assert got.keys() == subsets.keys()
    for name, chosen in subsets.items():
        true, said = plain(rows, chosen)
        accuracy = (true == said).mean()
        f1 = sum((true == m).mean() * 2 * ((true == m) & (said == m)).sum() / max((true == m).sum() + (said == m).sum(), 1) for m in set(true))
        assert got[name]["rows"] == 150 and got[name]["accuracy"] == pytest.approx(accuracy) and got[name]["f1"] == pytest.approx(f1)
        assert got[name]["verdict"] == ("GO" if accuracy > 0.7 else "INVESTIGATE" if accuracy > 0.5 else "NOGO")
    order = sorted(got.values(), key=lambda x: x["rank"])
    assert [x["accuracy"] for x in order] == sorted((x["accuracy"] for x in order), reverse=True)


def test_one_model_and_empty(spark):
    one = spark.createDataFrame([(i, "a", [1.0, 2.0]) for i in range(6)], SCHEMA)
    assert [tuple(r) for r in B.predictions(one, {"x": [0]}).collect()] == [("x", "a", "a", 6)]
    assert B.predictions(spark.createDataFrame([], SCHEMA), {"x": [0]}).count() == 0
    # a model that stands in one fold only is never known there
    lone = spark.createDataFrame([(0, "b", [9.0]), *[(i, "a", [1.0]) for i in range(10)]], SCHEMA)
    assert {tuple(r)[1:3] for r in B.predictions(lone, {"x": [0]}).collect()} == {("a", "a"), ("b", "a")}
