import math
import random

import pytest

from lexiprint.operators import evaluation, profiles, sequences


def paths(seed=0):
    r = random.Random(seed)
    rows = [("hot", 10_000 + i, [r.random() for _ in range(3)]) for i in range(120)]
    rows += [("hot", 0, [1.0, 0.0, 0.0]), ("hot", 10**9, [0.0, 0.0, 0.0])]
    return rows + [(f"p{k}", r.randrange(10**6) * 7 + k, [r.random() for _ in range(3)]) for k in range(6) for _ in range(k)]


def by_path(rows):
    out = {}
    for p, _, v in sorted(rows):
        out.setdefault(p, []).append(v)
    return out


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


@pytest.mark.parametrize("spans", [2, 64])
def test_following_points_across_spans(spark, spans):
    rows = paths()
    got = sequences.following(spark.createDataFrame(rows, "path string, pos long, vec array<double>"), 3, spans=spans).collect()
    whole = {(p, v): i for p, vs in by_path(rows).items() for i, v in enumerate(map(tuple, vs))}
    assert len(got) == len(rows)
    for r in got:
        i = whole[r["path"], tuple(r["vec"])]
        assert r["after"] == by_path(rows)[r["path"]][i + 1 : i + 4]


def test_decay_matches_brute_force(spark):
    rows = paths(1)
    got = {r["path"]: r for r in sequences.decay(spark.createDataFrame(rows, "path string, pos long, vec array<double>")).collect()}
    for p, vs in by_path(rows).items():
        for k in (1, 2, 3):
            pairs = [cosine(vs[i], vs[i + k]) for i in range(len(vs) - 3)]
            assert abs(got[p][f"decay_k{k}"] - (sum(pairs) / len(pairs) if pairs else 0)) < 1e-9
    assert sequences.decay(spark.createDataFrame([], "path string, pos long, vec array<double>")).count() == 0


def test_drift_from_either_end_and_alerts(spark):
    rows = [("a", t, [x, 0.0]) for t, x in enumerate([0.0, 0.02, 0.3, 0.28, 0.5])] + [("b", 3, [1.0, 1.0])]
    samples = spark.createDataFrame(rows, "model string, ts long, vec array<double>")
    first = {(r["model"], r["ts"]): r for r in profiles.drift(samples).collect()}
    assert [first["a", t]["level"] for t in range(5)] == ["none", "none", "critical", "critical", "critical"]
    assert [first["a", t]["change"] for t in range(5)] == [False, False, True, False, True] and not first["b", 3]["change"]
    last = {r["ts"]: r["drift"] for r in profiles.drift(samples, base="last").filter("model = 'a'").collect()}
    assert abs(last[4]) < 1e-12 and abs(last[0] - 0.5) < 1e-12
    told = evaluation.alerts(profiles.drift(samples), since=3, least="high").collect()
    assert sorted(r["ts"] for r in told) == [3, 4] and told[0]["message"] == "CRITICAL drift of a"


def test_class_report_with_a_model_never_predicted(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    got = {r["model"]: tuple(r)[1:] for r in evaluation.class_report(spark.createDataFrame(rows, "model string, predicted string")).collect()}
    assert got == {"a": (2, 1, 0.5, 1.0), "b": (1, 1, 1.0, 1 / 3), "c": (1, 0, 0.0, 0.0), None: (4, 2, 0.5, 0.5)}
    assert evaluation.class_report(spark.createDataFrame([], "model string, predicted string")).count() == 0


def test_claims(spark):
    vectors = spark.createDataFrame([(1, "M1", [0.0, 0.1]), (2, "m2", [0.0, 0.0]), (3, None, [9.0, 9.0]), (4, "m1-large", [0.0, 0.0])], "id long, claim string, vec array<double>")
    centres = spark.createDataFrame([("m1", [0.0, 0.0]), ("m2", [10.0, 10.0]), ("m3", [5.0, 5.0])], "model string, centroid array<double>")
    got = {r["id"]: r for r in evaluation.check_claims(vectors, centres).collect()}
    assert [got[i]["verified"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[2]["alert"] == "Claimed m2 but fingerprint matches m1" and got[2]["claim_confidence"] == 0.0
    ranks = evaluation.alternatives(vectors.filter("id = 1"), centres).orderBy("rank").collect()
    assert [r["model"] for r in ranks] == ["m1", "m3", "m2"] and [ranks[0]["confidence"], ranks[2]["confidence"]] == [1.0, 0.0]


def plain_returns(rows):
    out = {}
    for p, vs in by_path([r for r in rows if r[0] is not None]).items():
        far = [[math.dist(a, b) for b in vs] for a in vs]
        n = len(vs)
        jump = sum(far[i][i + 1] for i in range(n - 1)) / (n - 1) if n > 1 else 0
        near = lambda i, j, r: far[i][j] < r
        again = sum(any(near(i, j, jump / 2 if jump > 0 else 0.1) for j in range(i + 2, n)) for i in range(n)) / n
        orbit = sum(any(near(i, j, jump / 2) for j in range(i - 1)) for i in range(2, n)) / max(n - 2, 1)
        out[p] = (n, again, orbit) if n >= 3 else (n, 0, 0)
    return out


@pytest.mark.parametrize("piece", [7, 2048])
def test_returns_match_brute_force(spark, monkeypatch, piece):
    r = random.Random(5)
    rows = [("walk", i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(300)] + [("still", i, [0.5, 0.5]) for i in range(40)] + [("two", i, [float(i), 0.0]) for i in range(2)]
    rows += [("line", i, [float(i), 0.0]) for i in range(50)] + [("loop", i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(200)] + [("wide", i, [r.gauss(0, 1) for _ in range(2)]) for i in range(9)]
    points = spark.createDataFrame(rows, "path string, pos long, vec array<double>")
    want = plain_returns(rows)
    got = {x["path"]: (x["n"], x["return_rate"], x["orbit_rate"]) for x in sequences.returns(points, piece).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    assert 0 < got["walk"][1] < 1 and got["still"][1] == 38 / 40 and got["line"][1] == 0 and got["loop"][2] > 0
    # spans leave all as it is
    monkeypatch.setattr(sequences, "SPAN", 40)
    again = {x["path"]: (x["n"], x["return_rate"], x["orbit_rate"]) for x in sequences.returns(points, piece).collect()}
    assert again == got


def test_returns_of_awkward_rows(spark):
    rows = [(None, i, [0.0, float(i % 2)]) for i in range(6)] + [("x", 1, None), ("x", 2, [1.0]), ("x", 3, [1.0, 2.0]), ("x", 4, [1.0])]
    points = spark.createDataFrame(rows, "path string, pos long, vec array<double>")
    got = {x["path"]: tuple(x)[1:] for x in sequences.returns(points).collect()}
    assert got[None] == (6, pytest.approx(4 / 6), pytest.approx(1)) and got["x"][0] == 4
    assert sequences.returns(spark.createDataFrame([], "path string, pos long, vec array<double>")).count() == 0
    assert {x["path"]: x["n"] for x in profiles.trajectory(points.filter("path is null")).collect()} == {None: 6}


def test_a_long_path_is_not_compared_pair_by_pair(spark):
    """On a line of many points each cell holds few of them."""
    points = spark.range(60_000).selectExpr("'p' as path", "id as pos", "array(id + 0.25D * (id % 2), 1D) as vec")
    row = sequences.returns(points).first()
    assert (row["n"], row["return_rate"], row["orbit_rate"]) == (60_000, 0.0, 0.0)


def test_short_paths_need_no_cells(spark, monkeypatch):
    """A group for each cell of each path grew with the number of paths; a short path is one row."""
    monkeypatch.setattr(sequences, "_near", None)
    points = spark.range(3000).selectExpr("id % 300 as path", "id as pos", "array(double((id div 300) % 2), 0D) as vec")
    got = sequences.returns(points).collect()
    # a path of ten points goes to and fro between two places
    assert len(got) == 300 and {(r["n"], r["return_rate"], r["orbit_rate"]) for r in got} == {(10, 0.8, 1.0)}
