import numpy as np
import pyarrow as pa
import pytest

from lexiprint.llm import lsh

SCHEMA = "vec_id long, embedding array<float>, label int, v string, bucket string"


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(np.float32(c)) for c in v], 0, "v", "b") for i, v in enumerate(x)] + [(*e, 0, "v", "b") for e in extra], SCHEMA)


def exact(x, ids, queries, top):
    out = {}
    for q in queries:
        s = [(-float((x[q] * x[j]).sum()), ids[j]) for j in range(len(x)) if ids[j] != ids[q]]
        out[ids[q]] = sorted(s)[:top]
    return out


def unit(n, d=64, seed=0, centres=10):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) + 0.8 * r.normal(size=(centres, d))[r.integers(0, centres, n)]
    return np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)


def test_pseudo_rotation_is_orthogonal_and_buckets_are_nearest_axes():
    turn = lsh.signs(1, 48)[0]
    x = unit(20, 48)
    y = lsh.rotate(x, turn)
    np.testing.assert_allclose(y @ y.T, x @ x.T, atol=1e-12)
    axes = np.concatenate([np.eye(64), -np.eye(64)])
    np.testing.assert_allclose(lsh.signed_axes(x, turn), y @ axes.T, atol=1e-12)
    turns = lsh.signs(2, 48, 5)
    one, two = (lsh.rotate(x, t) @ axes.T for t in turns)
    sums = (one[:, :, None] + two[:, None]).reshape(20, -1)
    np.testing.assert_array_equal(lsh.bucket(x, turns), sums.argmax(axis=1))
    for row, found in zip(sums, lsh.probed(x, turns, 50)):
        assert set(found) == set(np.argsort(-row)[:50])


@pytest.mark.parametrize("n,piece", [(1500, 4096), (700, 50)])
def test_recall_scores_and_order(spark, monkeypatch, n, piece):
    monkeypatch.setattr(lsh, "PIECE", piece)
    x = unit(n)
    got = lsh.nearest(table(spark, x)).collect()
    want = exact(x, list(range(n)), range(0, n, 20), 20)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert all(v == sorted(v) and len({i for _, i in v}) == 20 for v in found.values())
    for q, rows in found.items():
        for s, j in rows:
            assert abs(-s - float((x[q] * x[j]).sum())) < 1e-12
    recall = np.mean([len({i for _, i in found[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    x = unit(300, 16, 3)
    x[100:180] = x[0]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] + [1.0] * 15), (1004, [float("inf")] * 16), (1005, [1.0] * 3), (None, [1.0] * 16), (1006, []), (40, [float(c) for c in np.float32(x[40])])]
    got = sorted(lsh.nearest(table(spark, x, bad)).collect(), key=lambda r: (r["query_id"], r["rank"]))
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == list(range(100, 120)) and by[100] == [0, *range(101, 120)]
    assert by.keys() == set(range(0, 300, 20)) and all(len(v) == 20 for v in by.values())


def test_few_vectors_and_empty(spark):
    x = unit(7, 5, 1)
    got = sorted(map(tuple, lsh.nearest(table(spark, x)).collect()))
    assert [r[2] for r in got] == [i for _, i in exact(x, list(range(7)), [0], 20)[0]] and [r[1] for r in got] == [1, 2, 3, 4, 5, 6]
    assert lsh.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_identifiers_count_once_by_their_best_vector(spark):
    x = unit(400, 16, 5)
    extra = [(i, [float(c) for c in np.float32(unit(1, 16, 900 + i)[0])]) for i in (0, 1, 1, 2, 20)]
    rows = [(i, v) for i, v in enumerate(x)] + [(i, np.array(v)) for i, v in extra]
    got = {}
    for r in sorted(lsh.nearest(table(spark, x, extra)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len({i for i, _ in v}) == len(v) == 20 for v in got.values())
    for q, found in got.items():
        for i, s in found:
            assert abs(s - max(float((a * b).sum()) for j, a in rows if j == q for k, b in rows if k == i)) < 1e-6


def test_cells_pieces_and_the_share_that_is_met(spark, monkeypatch):
    """More vectors, finer cells and a smaller share of candidates, at recall 0.9."""
    assert lsh.probes_for(500) > lsh.probes_for(2000) > lsh.probes_for(10**6) >= lsh.LEAST_PROBES
    x = unit(1200, 32, 2)
    want = exact(x, list(range(1200)), range(0, 1200, 20), 20)
    monkeypatch.setattr(lsh, "CELL", 40)
    monkeypatch.setattr(lsh, "QUERIES", 7)
    found = {}
    for r in lsh.nearest(table(spark, x)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_short_queries_meet_all_rows(spark):
    x = unit(900, 24, 4)
    got = {}
    for r in lsh.neighbours(table(spark, x).filter("vec_id % 20 = 0"), table(spark, x), tables=1, probes=1).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(v) == 20 for v in got.values())
    want = exact(x, list(range(900)), range(0, 900, 20), 20)
    assert sum(set(got[q]) == {i for _, i in want[q]} for q in want) > 40


def test_vectors_of_several_lengths_are_searched_among_themselves(spark):
    x, y = unit(300, 16, 7), unit(90, 12, 8)
    extra = [(1000 + i, [float(c) for c in np.float32(v)]) for i, v in enumerate(y)] + [(2000, [1.0, 0.0])]
    got = {}
    for r in sorted(lsh.nearest(table(spark, x, extra)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == {*range(0, 300, 20), *range(1000, 1090, 20)}
    want = exact(x, list(range(300)), range(0, 300, 20), 20) | exact(y, list(range(1000, 1090)), range(0, 90, 20), 20)
    assert all((i >= 1000) == (q >= 1000) for q, v in got.items() for i in v)
    assert np.mean([len(set(got[q]) & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("n", [2_000, 50_000])
def test_recall_of_many_vectors(spark, n):
    """By the operator itself, for isotropic vectors, which are the hardest."""
    x = np.float32(np.random.default_rng(n).normal(size=(n, 64)))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": lists}))
    got = lsh.nearest(frame).toPandas().groupby("query_id")["vec_id"].agg(set)
    step = max(20, n // 100 // 20 * 20)
    wide = x.astype(float)
    recall = []
    for q in range(0, n, step):
        score = wide @ wide[q]
        score[q] = -np.inf
        recall.append(len(got[q] & set(np.argpartition(-score, 20)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_rows_that_are_no_neighbours_change_nothing(spark):
    """Vectors too short to be near any query raise the number of rows only."""
    x = np.random.default_rng(6).normal(size=(500, 64))
    short = 1e-6 * np.random.default_rng(7).normal(size=(4000, 64))
    few, many = table(spark, x), table(spark, x, [(1000 + i, [float(np.float32(c)) for c in v]) for i, v in enumerate(short)])
    asked = few.filter("vec_id % 20 = 0")
    got, more = (sorted(map(tuple, lsh.neighbours(asked, t).collect())) for t in (few, many))
    assert len(got) == 500 and more == got
