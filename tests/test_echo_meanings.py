"""Zones' mean vectors and the semantic score, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from lexiprint.operators import echoes

SCHEMA = "doc_id long, pair int, kind string, zone_a array<string>, zone_b array<string>"


def test_zone_vectors_and_scores(spark):
    vectors = {"sun": [1.0, 0.0], "rain": [0.0, 2.0], "anti": [-1.0, 0.0], "zero": [0.0, 0.0]}
    rows = [
        (1, 0, "punctuation", ["sun", "rain", "sun"], ["rain"]),
        (1, 1, "conjunction", ["sun"], ["anti", "unknown"]),
        (2, 0, "transition", ["unknown"], ["sun"]),
        (2, 1, "transition", [], ["sun"]),
        (None, 0, "punctuation", ["sun"], ["sun"]),
        (3, 0, "punctuation", ["zero"], ["sun"]),
    ]
    pairs = spark.createDataFrame(rows, SCHEMA)
    words = spark.createDataFrame(list(vectors.items()), "word string, vec array<double>")
    with_vectors = echoes.zone_vectors(pairs, words)
    assert with_vectors.columns == [*pairs.columns, "vec_a", "vec_b"] and with_vectors.count() == len(rows)
    got = {(r["doc_id"], r["pair"]): r for r in echoes.scored(with_vectors).collect()}
    want = {(1, 1): 0.0, (2, 0): 0.5, (2, 1): 0.0, (None, 0): 1.0, (3, 0): 0.5}
    assert {k: r["semantic"] for k, r in got.items()} == pytest.approx({**want, (1, 0): (1 + (2 / 3 * 2) / (math.hypot(2 / 3, 2 / 3) * 2)) / 2})
    plain = {(r["doc_id"], r["pair"]): r["semantic"] for r in echoes.scored(pairs).collect()}
    assert plain == {(1, 0): 0.5, (1, 1): 0.5, (2, 0): 0.5, (2, 1): 0.0, (None, 0): 0.5, (3, 0): 0.5}


def test_meanings_ask_by_block_and_word(spark):
    vectors = [("sun", [1.0, 0.0]), ("rain", [0.6, 0.8]), ("zero", [0.0, 0.0])]
    rows = [(i, 0, "punctuation", ["sun", "rain", "sun", None][: i % 5], ["rain", "zero", "unknown"][i % 3 :] if i % 7 else None) for i in range(40)]
    pairs, words = spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(vectors, "word string, vec array<double>")
    with_vectors = echoes.zone_vectors(pairs, words)
    by_vectors = {r["doc_id"]: r["m"] for r in with_vectors.select("doc_id", echoes.likeness(F.col("vec_a"), F.col("vec_b")).alias("m")).collect()}
    assert {r["doc_id"]: r["meaning"] for r in echoes.meanings(pairs, words).collect()} == pytest.approx(by_vectors) and len(set(by_vectors.values())) > 3
    first = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "key int, vec array<double>")
    keyed = echoes.zone_vectors(spark.createDataFrame([(1, 0, "punctuation", ["a", "bb", "ccc"], ["dd"])], SCHEMA), first, F.length)
    assert [(r["vec_a"], r["vec_b"]) for r in keyed.collect()] == [([0.5, 1.5], [0.0, 3.0])]
    # of 20,000 pairs each block of rows asks once for each of its words
    many = pairs.drop("doc_id").crossJoin(spark.range(500).withColumnRenamed("id", "doc_id")).select("doc_id", "pair", "kind", "zone_a", "zone_b").coalesce(1)
    plan = echoes.meanings(many, words)
    assert plan.count() == 20000
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "FlatMapGroupsInArrow" in text
