import random
import zlib

import numpy as np
from data import WIDE, documents, empty, wide, words

from lexiprint.llm import toxicity as tox

BAD = ["grubsome", "vilk", "snorbit", "plague"]


def corpus(spark, n=900, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(800)]
    rows = []
    for i in range(n):
        text = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.25
        for _ in range(3 if bad else 0):
            text.insert(r.randrange(len(text) + 1), r.choice(BAD).upper() + "!")
        rows.append((i, " ".join(text), r.choice(["en", "fr"]), int(bad)))
    return rows


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, other int").drop("other")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3) and r["toxic"] == int(r["score"] >= r["lang_threshold"])
    held = [(got[r[0]], r[3]) for r in rows if got[r[0]]["held_out"]]
    assert sum(g["predicted"] == y for g, y in held) > 0.95 * len(held)
    assert sum(g["toxic"] == y for g, y in held) > 0.95 * len(held)
    assert len({r["lang_threshold"] for r in got.values()}) == 2
    kept = {r["doc_id"] for r in tox.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r["toxic"]}


def test_labels_of_held_out_rows_are_never_used(spark):
    rows = corpus(spark, 300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    flip = [(r[0], 1 - r[3] if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[3]) for r in rows]
    a = tox.toxicity(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")).collect()
    b = tox.toxicity(docs, spark.createDataFrame(flip, "doc_id long, toxic int")).collect()
    assert sorted(a) == sorted(b)


def small_model(seed=0):
    r = np.random.default_rng(seed)
    docs = [np.stack([r.integers(1, 50, n)] * tox.PARTS, axis=1).astype("<i4") for n in r.integers(0, 30, 60)]
    y = np.array([int(len(d) > 0 and (d[:, 0] < 5).any()) for d in docs])
    return tox.train(docs, y, np.ones(len(docs), dtype=np.float32), epochs=2), docs


def test_scorer_agrees_with_the_trained_network_piece_by_piece(monkeypatch):
    model, _ = small_model()
    texts = [words(n, n) for n in (1, 2, 3, 40, 700)] + ["", None, "...", words(40, 40)]
    plain = tox._logits(model, [np.array([tox.word_buckets(w) for w in (t or "").split()], dtype="<i4").reshape(-1, tox.PARTS) for t in texts])
    for at_once, kept in ((200_000, 100_000), (16, 20)):
        monkeypatch.setattr(tox, "AT_ONCE", at_once)
        monkeypatch.setattr(tox, "KEPT", kept)
        np.testing.assert_allclose(tox.Scorer(model).score(texts), 1 / (1 + np.exp(-plain)), rtol=1e-4)


def test_awkward_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(100, 160)] + [(None, 1, 1), (3, 0, None), (101, 1, 1)], "doc_id long, quality int, toxic int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(r["score"] is not None for r in got)
    assert tox.toxicity(empty(spark), labels).count() == 0
    none = tox.toxicity(docs, labels.filter("toxic = 0"))
    assert none.count() == docs.count() and none.filter("predicted = 1").count() == 0
    assert tox.drop_toxic(docs, labels).columns == docs.columns


def test_thresholds_cover_all_labels_beyond_the_sample(spark, monkeypatch):
    """With clean labels far beyond the sample, thresholds are those of best F1 over every labelled row not trained on."""
    monkeypatch.setattr(tox, "SAMPLE", {1: 100, 0: 100})
    r = random.Random(8)
    rows = []
    for i, text, lang, bad in corpus(spark, 1500):
        # one clean text in five holds a bad word as well, so scores overlap
        rows.append((i, text + (" " + r.choice(BAD) if not bad and r.random() < 0.2 else ""), lang, bad))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, toxic int")
    _, rest = tox._fit(docs, labels)
    used = {x["_id"] for x in rest.collect()}
    assert len(used) > 800 and not any(zlib.crc32(str(i).encode()) % 4 == tox.HELD_OUT for i in used)
    got = {x["doc_id"]: x for x in tox.toxicity(docs, labels).collect()}
    for lang in ("en", "fr"):
        mine = [(got[i]["score"], bad) for i, _, x, bad in rows if x == lang and i in used]

        def f1(limit):
            hit = sum(y for s, y in mine if s >= limit)
            return 2 * hit / (sum(s >= limit for s, _ in mine) + sum(y for _, y in mine))

        limit = next(got[i]["lang_threshold"] for i, _, x, _ in rows if x == lang)
        assert f1(limit) >= max(f1(s) for s, _ in mine) - 0.01
    model = tox.fit(docs, labels)
    assert all(abs(model.thresholds[x] - next(got[i]["lang_threshold"] for i, _, y, _ in rows if y == x)) < 1e-6 for x in ("en", "fr"))


def test_gradients_match_finite_differences():
    model, docs = small_model()
    r = np.random.default_rng(2)
    model = tox.Model(*(x.astype(np.float64) for x in (model.embedding + r.normal(0, 0.05, model.embedding.shape),)), {w: f.astype(np.float64) for w, f in model.filters.items()}, {w: b.astype(np.float64) + 0.05 for w, b in model.bias.items()}, model.weight.astype(np.float64), model.offset)
    model.embedding[0] = 0
    words_, spans = tox._join(docs[:12], model.padding)
    labels, weights = r.integers(0, 2, 12).astype(float), r.random(12) + 0.5
    g = tox.gradients(model, words_, spans, labels, weights)

    def slope(array, at):
        kept, out = array[at], []
        for step in (1e-6, -1e-6):
            array[at] = kept + step
            out.append(tox.loss(model, words_, spans, labels, weights))
        array[at] = kept
        return (out[0] - out[1]) / 2e-6

    for n, row in enumerate(g.touched[:25]):
        if row:
            np.testing.assert_allclose([slope(model.embedding, (row, j)) for j in range(3)], g.embedding[n, :3], rtol=1e-4, atol=1e-8)
    for w in tox.WIDTHS:
        np.testing.assert_allclose([slope(model.filters[w], (w - 1, 0, j)) for j in range(tox.FILTERS)], g.filters[w][w - 1, 0], rtol=1e-4, atol=1e-8)
        np.testing.assert_allclose([slope(model.bias[w], j) for j in range(tox.FILTERS)], g.bias[w], rtol=1e-4, atol=1e-8)
    np.testing.assert_allclose([slope(model.weight, j) for j in range(8)], g.weight[:8], rtol=1e-4, atol=1e-8)


def test_wide_identifiers_and_other_columns_come_back(spark):
    docs = wide(spark, [words(20, i) + (" vilk snorbit" if i % 5 == 1 else "") for i in range(40)])
    labels = spark.createDataFrame([(i, int(n == 1)) for n, i in enumerate(WIDE) if i is not None], "doc_id long, toxic int")
    assert sorted(map(str, (r["doc_id"] for r in tox.toxicity(docs, labels).collect()))) == sorted(map(str, WIDE * 8))
    assert set(map(str, tox.drop_toxic(docs, labels).collect())) <= set(map(str, docs.collect()))


def test_sample_is_bounded_in_words_and_model_independent_of_partitions(spark, monkeypatch):
    rows = corpus(spark, 300)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(9000, words(50_000, 1), "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(9000, 0)], "doc_id long, toxic int")
    monkeypatch.setattr(tox, "SAMPLE_WORDS", 8000)
    models = [tox._fit(docs.repartition(n), labels) for n in (1, 5)]
    np.testing.assert_array_equal(models[0][0].embedding, models[1][0].embedding)
    left = {r["_id"] for r in models[0][1].collect()}
    assert 9000 in left and 120 < len(left) < 240
