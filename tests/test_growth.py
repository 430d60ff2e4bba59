"""Merged corpora, budgets and paths of texts against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiprint.operators import budget, cascade, embedding, merging, registry
from lexiprint.plans import growth


def test_sources_of_unlike_schema(spark):
    a = spark.createDataFrame([("b", "Same text.", "0.5", "GPT-X"), ("a", "Same text.", "hot", None), ("c", None, None, "")], "SAMPLE_ID string, text string, temperature string, Model string")
    b = spark.createDataFrame([(7, "Same text.", 3), (8, "Own one. And two!", None)], "seed_id long, text string, word_count int")
    c = spark.createDataFrame([("",)], "text string")
    got = {r["text"]: r for r in merging.merge({"a": a, "b": b, "c": c}).collect()}
    assert got.keys() == {"Same text.", "", "Own one. And two!"}
    same = got["Same text."]
    assert (same["sample_id"], same["temperature"], same["model_id"], same["source"], same["sources"], same["copies"]) == ("a", 0.7, "unknown", "a", ["a", "b"], 3)
    own = got["Own one. And two!"]
    assert own["seed_id"] == "8" and own["word_count"] == 4 and own["sentence_count"] == 2 and own["sample_id"].startswith("sample_") and own["prompt_style"] == "neutral"
    assert got[""]["sources"] == ["a", "c"] and got[""]["model_id"] == "unknown"
    assert merging.merge({"a": a, "b": b, "c": c}, deduplicate=False).count() == 6
    stats = {(r["kind"], r["value"]): (r["samples"], r["copies"]) for r in merging.statistics(merging.merge({"a": a, "b": b, "c": c})).collect()}
    assert stats["all", None] == (3, 6) and stats["source", "a"] == (2, 5) and stats["source", "b"] == (1, 1)
    assert merging.merge({"a": a.limit(0)}).count() == 0


@pytest.mark.parametrize("total", [0, 1, 40, 3000, 20_000, 10**9])
def test_budget_against_a_running_sum(spark, monkeypatch, total):
    monkeypatch.setattr(budget, "SPANS", 8)
    r = random.Random(total)
    # a third of the rows stand at one place in the order
    rows = [(i, 500 if i % 3 == 0 else r.randrange(1000), r.choice([None, -5, 0, 1, 7, 30])) for i in range(900)] + [(None, 3, 9), (9000, None, 9)]
    found = budget.within(spark.createDataFrame(rows, "id long, at long, pages int"), "at", "id", F.col("pages"), total, light=20)
    want, run = [], 0
    for i, at, c in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[0])):
        run += max(c or 0, 0)
        if run > total:
            break
        want.append((i, at, c, run))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.columns == ["id", "at", "pages", "running"]


def test_budget_of_equal_rows_and_none(spark):
    same = spark.createDataFrame([(1, 1, 2)] * 50, "id long, at long, pages int")
    assert sorted(r["running"] for r in budget.within(same, "at", "id", F.col("pages"), 31, light=1000).collect()) == list(range(2, 31, 2))
    assert budget.within(same.limit(0), "at", "id", F.col("pages"), 5).count() == 0


def plain_path(text):
    clauses = []
    for s in re.split(r"(?<=[.!?])\s+", text or ""):
        parts = re.split(r"(?<=[,;:])\s+|\s*—\s*|\s+(?:but|and|or|yet|so|however|therefore|thus|although|while)\s+", s, flags=re.IGNORECASE)
        clauses += [p.strip() for p in parts if len(p.split()) >= 3]
    x = [np.random.RandomState(int(hashlib.md5(c.encode()).hexdigest()[:8], 16)).randn(384) for c in clauses]
    n = len(x)
    if n < 2:
        return (n, 0, 0, 1, 0, 0)
    dist = lambda a, b: float(np.linalg.norm(a - b))
    jumps = [dist(a, b) for a, b in zip(x, x[1:])]
    mean = sum(jumps) / len(jumps)
    far = dist(x[-1], x[0])
    angles = [math.acos(max(-1, min(1, float((b - a) @ (c - b)) / (dist(a, b) * dist(b, c))))) for a, b, c in zip(x, x[1:], x[2:]) if dist(a, b) > 1e-6 and dist(b, c) > 1e-6]
    back = sum(any(dist(x[i], x[j]) < mean / 2 for j in range(i - 1)) for i in range(2, n))
    return (n, mean, sum((j - mean) ** 2 for j in jumps) / len(jumps), sum(jumps) / far if far > 1e-6 else sum(jumps) * 10, sum(angles) / len(angles) if angles else 0, back / max(n - 2, 1))


def test_paths_of_texts(spark):
    r = random.Random(6)
    words = ["sun", "rain", "the", "hill", "and", "but", "SO", "however", "—", "goes", "on,", "now;", "then.", "why?"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 120)))) for i in range(60)]
    rows += [(100, "one two three. " * 40), (101, None), (102, ""), (103, "a b c. d e f. a b c. d e f. g h i."), (104, "no clause"), (None, "x y z. x y z.")]
    got = {x["doc_id"]: tuple(x)[1:] for x in embedding.text_paths(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(plain_path(text), rel=1e-9, abs=1e-9)
    assert got[103][5] > 0 and got[100][0] == 40
    assert embedding.text_paths(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hash_vectors_are_the_documented_ones():
    want = np.random.RandomState(int(hashlib.md5("to be or not".encode()).hexdigest()[:8], 16)).randn(384)
    np.testing.assert_array_equal(embedding.hash_vector("to be or not"), want)


def test_later_tiers_see_what_is_left(spark):
    asked = []

    def tier(name, values, sure):
        def score(df):
            asked.append((name, sorted(r["doc_id"] for r in df.select("doc_id").collect())))
            return df.withColumn("ai", F.coalesce(*(F.when(F.col("doc_id") == k, F.lit(v).cast("double")) for k, v in values.items())))

        return cascade.Tier(name, score, sure)

    docs = spark.createDataFrame([(i, "x") for i in range(5)], "doc_id long, text string")
    tiers = [tier("a", {0: 0.95, 1: 0.5, 2: 0.1, 3: None, 4: 0.8}, 0.85), tier("b", {1: 0.2, 3: 0.6, 4: 0.5}, 0.7), tier("c", {3: 0.49, 4: None}, 0.0)]
    got = {r["doc_id"]: (r["tier"], r["ai"], r["label"]) for r in cascade.cascade(docs, tiers).collect()}
    assert asked == [("a", [0, 1, 2, 3, 4]), ("b", [1, 3, 4]), ("c", [3, 4])]
    assert got == {0: ("a", 0.95, "ai"), 2: ("a", 0.1, "human"), 1: ("b", 0.2, "human"), 3: ("c", 0.49, "human"), 4: ("c", None, None)}


def test_costly_features_stand_above_a_filter(spark):
    plan = growth.QUERIES["text_cascade"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    branch = text[text.rindex("shapes") :] if "shapes" in text else text
    assert text.count("array_distinct") >= 1 and "Filter" in branch
    assert {r["tier"] for r in plan.select("tier").distinct().collect()} == {"commas", "variety", "shapes"}


def test_named_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"), allowMissingColumns=True)
    sizes = {"fast": 7, "medium": 26, "old": 24, "long": 39, "full": 45}
    whole = {r["doc_id"]: r["vector"] for r in registry.view(docs, "full").collect()}
    paths = {r["doc_id"]: tuple(r)[2:] for r in embedding.text_paths(docs).collect()}
    light = {r["doc_id"]: r for r in registry.extract(docs, ["layer_e", "layer_e_compression"]).collect()}
    assert len(whole) == 41
    for i, v in whole.items():
        assert len(v) == 45 and tuple(v[:5]) == paths[i]
        assert v[39] == light[i]["layer_e_sentence_length_cv"] and v[42] == light[i]["layer_e_compression_compression_ratio"]
    for name, size in sizes.items():
        got = {r["doc_id"]: r["vector"] for r in registry.view(docs, name).collect()}
        assert all(len(v) == size for v in got.values())
        assert got == {i: {"fast": v[39:] + [v[2]], "medium": v[39:] + v[:20], "old": v[:5] + v[20:39], "long": v[:39], "full": v}[name] for i, v in whole.items()}
    plan = registry.view(docs, "old")._jdf.queryExecution().optimizedPlan().toString()
    assert "gzip" not in plan


def test_hash_vectors_share_a_generator(monkeypatch):
    """A generator of its own for each clause took ten times the draw; the vectors are those of one."""
    own = {c: np.random.RandomState(int(hashlib.md5(c.encode()).hexdigest()[:8], 16)).randn(7) for c in ("a b c", "", "déjà vu")}

    def refused(*_):
        raise AssertionError("a new generator")

    monkeypatch.setattr(embedding.np.random, "RandomState", refused)
    for _ in range(2):
        assert all((embedding.hash_vector(c, 7) == v).all() for c, v in own.items())
