"""Counts of a sorted array, moments of an array, and what they cost."""

import random
from collections import Counter
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import registry


def test_counts_and_moments(spark):
    r = random.Random(3)
    rows = [(i, [r.randint(0, 5) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 40, 300])] + [(99, None)]
    df = T.with_counts(spark.createDataFrame(rows, "id long, a array<int>"), c=F.col("a"))
    got = {x["id"]: x for x in df.select("id", "c", T.mean_of(F.col("a"), 0.5).alias("m"), T.std_of(F.col("a")).alias("s")).collect()}
    for i, a in rows[:-1]:
        assert got[i]["c"] == [n for _, n in sorted(Counter(a).items())]
        assert got[i]["m"] == pytest.approx(fmean(a) if a else 0.5) and got[i]["s"] == pytest.approx(pstdev(a) if len(a) > 1 else 0)
    assert tuple(got[99])[1:] == (None, None, None)


def test_word_counts_sort_hashes_and_no_structs(spark):
    docs = spark.range(8).selectExpr("id as doc_id", "concat('a b c ', id) as text").repartition(8)
    plan = registry.extract(docs, ["lexical"])._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(transform(" in plan and "sort_array(transform(alpha" in plan and "struct(w, xxhash64" not in plan
