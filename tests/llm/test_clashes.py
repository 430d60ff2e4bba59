"""Columns of the user that have the names of columns in between come back untouched."""

import pytest
from data import documents, with_own_names, words
from pyspark.sql import functions as F

from lexiprint.llm import decontaminate, lm, mixing, nearcopies, phrases, runs, sharding, simhash, sstable, toxicity
from lexiprint.llm.common import key_of, unused


@pytest.fixture(scope="module")
def docs(spark):
    return with_own_names(documents(spark, [(3000 + i, words(30, 3000 + i)) for i in range(200)])).cache()


@pytest.fixture(scope="module")
def labels(spark, docs):
    return spark.createDataFrame([(3000 + i, i % 2, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")


def untouched(before, after):
    assert after.columns == before.columns
    rows = {tuple(r) for r in after.collect()}
    assert rows and rows <= {tuple(r) for r in before.collect()}


def test_stages_give_own_columns_back(spark, docs, labels):
    bench = spark.createDataFrame([(1, words(60, 2))], "item_id long, text string")
    for after in (nearcopies.keep_one(docs), simhash.keep_one(docs), mixing.mix(docs, labels), toxicity.drop_toxic(docs, labels), decontaminate.drop_leaks(docs, bench)):
        untouched(docs, after)


def test_queries_take_tables_with_any_columns(spark, docs, labels):
    n = docs.count()
    bench = spark.createDataFrame([(1, words(60, 2))], "item_id long, text string")
    assert mixing.mixing_rates(docs, labels).count() == n
    assert toxicity.toxicity(docs, labels).count() == n
    assert simhash.simhash_digest(docs).count() == n
    assert sstable.token_shards(docs).count() == n
    assert sharding.shard_documents(docs).count() == n
    assert runs.runs_digest(docs).count() == n
    assert lm.document_scores(docs).count() == n
    assert decontaminate.leaks(docs, bench).count() == 3
    assert phrases.collocations(docs, 30).count()


def test_names_and_keys(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (None, None), (1, ""), (11, "a")], "_X int, _x_ string")
    assert unused(frame, "_x", "_y") == ["_x__", "_y"]
    keys = [r[0] for r in frame.select(key_of(F.col("_X"), F.col("_x_"))).collect()]
    assert len(set(map(bytes, keys))) == 6 and all(len(k) == 16 for k in keys)
