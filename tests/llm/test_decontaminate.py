import random
from math import log

import numpy as np
import pytest
from data import documents, empty, wide, words

from lexiprint.llm import decontaminate as dc


def plain_scores(items, windows):
    """BM25 of every window against every item, divided by the item's own score."""
    docs = [dc.words_of(t) for _, t in items]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        w = {}
        for t in set(d):
            f = sum(t in x for x in docs)
            tf = d.count(t)
            w[t] = log(1 + (n - f + 0.5) / (f + 0.5)) * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(d) / mean))
        for k, q in enumerate(windows):
            out[k, i] = sum(x for t, x in w.items() if t in q) / sum(w.values())
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_wand_retrieves_what_exhaustive_scoring_does(threshold):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(150)]
    pick = lambda n: [vocab[int(len(vocab) * r.random() ** 3)] for _ in range(n)]
    items = [(i, " ".join(pick(r.randint(1, 40)))) for i in range(120)]
    df = {t: sum(t in dc.words_of(x) for _, x in items) for t in {t for _, x in items for t in dc.words_of(x)}}
    mean = sum(len(dc.words_of(x)) for _, x in items) / len(items)
    index = dc.build_index(items, df, len(items), mean, threshold=threshold)
    windows = [set(pick(60)) | (set(items[r.randrange(120)][1].split()[: r.randint(0, 40)])) for _ in range(80)]
    pairs = [(k, index.terms[t]) for k, q in enumerate(windows) for t in q if t in index.terms]
    w, e, s = dc.retrieve(index, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), threshold)
    got = {(a, int(index.entry_item[b])): c for a, b, c in zip(w.tolist(), e.tolist(), s.tolist())}
    want = {k: v for k, v in plain_scores(items, windows).items() if v >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_leaks(docs, items):
    """All pairs of a document and an item, shingles only."""
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for d, text in docs:
        w = dc.words_of(text)
        for i, item in items:
            share = []
            for part in dc.question_answer(item):
                p = dc.words_of(part)
                n = min(5, len(p))
                share.append(len(grams(p, n) & grams(w, n)) / len(grams(p, n)) if p else 1.0)
            if dc.words_of(item) and min(share) >= 0.8:
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    r = random.Random(9)
    items = [(i, ". ".join(words(r.randint(3, 25), 1000 + 10 * i + j) for j in range(r.randint(1, 4)))) for i in range(40)]
    items += [(40, words(400, 7) + ". " + words(6, 8)), (41, "what is it? " + words(7, 3)), (42, ""), (43, words(9, 5) + " Answer: yes"), (44, words(9, 5) + " Answer: no")]
    rows = []
    for i, t in items:
        body = words(r.randint(0, 300), 50 + i)
        rows.append((1000 + i, f"{body} {t.upper()} {body}"))  # whole item, other case
        rows.append((2000 + i, f"{body} {t[: len(t) // 2]} {body}"))  # half of it
        w = t.split(" ")
        if len(w) > 20:
            w[len(w) // 2] = "changed"
        rows.append((3000 + i, f"{body}\n{' '.join(w)}%%% end"))
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items] + [(None, "x y z", 1), (99, None, 1)], "item_id long, text string, doc_id int")
    texts = [(x["doc_id"], x["text"]) for x in docs.collect()]
    want = plain_leaks(texts, items)
    got = dc.leaks(docs, bench)
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want and len(want) > 60
    split = dc.leaks(docs, bench, index_chars=2000)
    assert {(x["doc_id"], x["item_id"], round(x["score"], 9)) for x in split.collect()} == {(x["doc_id"], x["item_id"], round(x["score"], 9)) for x in got.collect()}
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(d for d, _ in texts if d not in {p[0] for p in want})


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, words(20, 1))], "item_id long, text string")
    assert dc.leaks(empty(spark), bench).count() == 0
    assert dc.leaks(documents(spark), bench.limit(0)).count() == 0
    assert dc.drop_leaks(documents(spark), bench.limit(0)).count() == documents(spark).count()


def test_items_without_identifier_are_found(spark):
    item = words(40, 7777)
    docs = spark.createDataFrame([(1, f"{words(50, 1)} {item} {words(50, 2)}"), (2, words(90, 3))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (8, words(40, 8))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, benchmark).collect()] == [(1, None)]
    assert [r["doc_id"] for r in dc.drop_leaks(docs, benchmark).collect()] == [2]


def test_wide_identifiers_and_other_columns_come_back(spark):
    item = words(40, 7777)
    docs = wide(spark, [words(30, i) + (f" {item} " if i % 4 == 1 else "") for i in range(20)])
    bench = spark.createDataFrame([(2**53 + 1, item)], "item_id long, text string")
    hit = [r for r in docs.collect() if item in r["text"]]
    assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()))) == sorted(str((r["doc_id"], 2**53 + 1)) for r in hit)
    assert sorted(map(str, dc.drop_leaks(docs, bench).collect())) == sorted(str(r) for r in docs.collect() if item not in r["text"])


def test_a_question_without_its_answer_is_no_leak(spark):
    """However long the question is; an item without an answer is known by its question."""
    question, answer = words(120, 31), words(12, 32)
    items = [(1, f"{question}? {answer}"), (2, words(90, 33)), (3, f"Q. {words(80, 35)}\nanswer: forty two")]
    texts = [(1, f"{words(30, 41)} {question}? {words(40, 42)}"), (2, f"{words(30, 43)} {question}? {words(3, 44)} {answer}"), (3, f"{answer} {words(50, 45)}"), (4, f"x {words(90, 33)} y"), (5, f"{words(80, 35)} forty one"), (6, f"{words(80, 35)} it is forty two")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()}
    assert got == plain_leaks(texts, items) == {(2, 1), (4, 2), (6, 3)}
    assert {r["doc_id"] for r in dc.drop_leaks(docs, bench).collect()} == {1, 3, 5}
