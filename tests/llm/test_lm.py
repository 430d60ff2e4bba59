"""Scores held against plain counts of words, the packing against its inverse, the walk against the model's formula."""

import math
import re
import zlib
from collections import Counter

import data
import numpy as np
import pytest

from lexiprint.llm import lm
from lexiprint.llm.queries import QUERIES


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), " "]


def plain(rows):
    """Columns of the query by the row, from whole tables of counts."""
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = [Counter() for _ in range(3)]
    for out, (_, text) in zip(held, rows):
        if not out:
            t = tokens(text)
            for k in range(3):
                counts[k].update(tuple(t[i : i + k + 1]) for i in range(len(t) - k))
    total, distinct = counts[0].total(), len(counts[0])

    def base(w):
        return (counts[0][w,] + 0.1) / (total + 0.1 * (distinct + 1))

    def chance(h, w):
        if not h:
            return base(w)
        return (counts[len(h)][*h, w] + lm.PRIOR * chance(h[1:], w)) / (counts[len(h) - 1][h] + lm.PRIOR)

    for out, (i, text) in zip(held, rows):
        t = tokens(text)
        yield (i, out, len(t), sum(counts[0][w,] > 0 for w in t), total, sum(math.log10(base(w)) for w in t), sum(math.log10(chance(tuple(t[max(0, k - 2) : k]), w)) for k, w in enumerate(t)))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-11, abs=1e-11)


@pytest.mark.parametrize("block", [1 << 14, lm.BLOCK])
def test_scores_against_plain_counts(spark, block):
    extra = [(200 + i, "the cat sat on the mat . the Cat Sat " * (i % 5) + data.words(i, i % 7)) for i in range(60)]
    extra += [(None, "the cat sat"), (None, None), (-3, "THE\xa0cat\x0bsat\ton"), (300, "the " * 3000), (301, "the " * 3000)]
    docs = data.documents(spark, extra)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marked = docs.selectExpr("doc_id", "text", "crc32(cast(doc_id as string)) % 10 <> 0 as learn")
    got = lm.trigram_scores(marked, "learn", block)
    assert got.dtypes == [*zip(COLUMNS, ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"])]
    same([tuple(r) for r in got.collect()], list(plain(rows)))


def test_query_against_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same([tuple(r) for r in QUERIES["op12_backoff_automaton"](spark, sf).select(COLUMNS).collect()], list(plain(rows)))


def test_chances_of_a_context_sum_to_one(spark):
    """Over all known words, the end and one unknown word, after any context.

    Two texts that differ in their last word differ by its chance and that of
    the end behind it, which the score of a text that ends there tells.
    """
    train = ["a b a b c", "a b b", "c a b a", "b c"]
    vocabulary = ["a", "b", "c", "unseen"]
    contexts = ["a", "a b", "b c", "c c", "unseen a", "unseen"]
    counts = [Counter() for _ in range(3)]
    for text in train:
        t = tokens(text)
        for k in range(3):
            counts[k].update(tuple(t[i : i + k + 1]) for i in range(len(t) - k))

    def end_after(h):
        p = (counts[0][" ",] + 0.1) / (counts[0].total() + 0.1 * (len(counts[0]) + 1))
        for k in (1, 2):
            g = h[-k:]
            if len(g) == k:
                p = (counts[k][*g, " "] + lm.PRIOR * p) / (counts[k - 1][g] + lm.PRIOR)
        return p

    asked = {(c, w): f"{c} {w}" for c in contexts for w in vocabulary} | {(c, None): c for c in contexts}
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(asked.values())], "doc_id long, text string, learn boolean")
    score = {r["doc_id"]: 10 ** r["score"] for r in lm.trigram_scores(docs, "learn").collect()}
    of = {k: score[100 + i] for i, k in enumerate(asked)}
    for c in contexts:
        h = tuple(c.split())
        before = of[c, None] / end_after(h)
        chances = [of[c, w] / end_after((*h, w)) / before for w in vocabulary]
        assert sum(chances) + end_after(h) == pytest.approx(1, rel=1e-9)


def test_without_training_text(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, learn boolean")
    rows = {r["doc_id"]: r for r in lm.trigram_scores(docs, "learn").collect()}
    assert rows[1]["score"] == rows[1]["base_score"] == 0 and rows[1]["held_out"] and rows[2]["n_tokens"] == 1 and rows[2]["train_tokens"] == 0


def test_empty_table(spark):
    assert lm.document_scores(data.empty(spark)).count() == 0


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        hashes, marks = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)), r.integers(0, 1 << 32, n, dtype=np.uint32)
        back = lm.unpacked(lm.packed(hashes, marks, hashes))
        assert [x.tolist() for x in back] == [hashes.tolist(), marks.tolist(), hashes.tolist()]


def test_texts_and_requests_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = lm.document_scores(docs)
    scores.collect()
    assert scores._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 3
