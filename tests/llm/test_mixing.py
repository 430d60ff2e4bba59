import random

import numpy as np
import pytest
from data import WIDE, documents, empty, wide, words

from lexiprint.llm import mixing


def table(spark, n=600, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        poor = r.random() < 0.4
        vocab = ["junk", "spam", "buy", "click"] if poor else ["river", "stone", "cloud", "field"]
        text = " ".join(r.choice(vocab + ["the", "of", "and"]) + ("%%%" if poor and r.random() < 0.3 else "") for _ in range(r.randint(20, 200)))
        rows.append((i, text, int(not poor)))
    return rows


def test_posteriors_separate_held_out_documents_and_totals_meet_targets(spark):
    rows = table(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mixing.mixing_rates(docs, labels, {"good": 0.7, "poor": 0.3}).collect()}
    right = sum((got[i]["p_good"] > 0.5) == bool(q) for i, _, q in rows if i % 2 == 0)
    assert right > 0.95 * len(rows) / 2
    mass = {n: sum(r["rate"] * r["tokens"] * r[f"p_{n}"] for r in got.values()) for n in ("good", "poor")}
    assert abs(mass["good"] / sum(mass.values()) - 0.7) < 0.01
    assert all(mixing.LOWEST <= r["rate"] for r in got.values())
    (shares,) = {(r["share_good"], r["share_poor"], r["met"]) for r in got.values()}
    assert shares[2] and abs(shares[0] - mass["good"] / sum(mass.values())) < 1e-6 and abs(sum(shares[:2]) - 1) < 1e-9
    assert got[0]["tokens"] == len(rows[0][1].split())


@pytest.mark.parametrize("lowest,targets", [(1.0, {"a": 0.5, "b": 0.3, "c": 0.2}), (0.0, {"a": 0.2, "b": 0.2, "c": 0.6}), (0.0, {"a": 0.05, "b": 0.9, "c": 0.05})])
def test_rates_match_plain_projected_gradient(spark, lowest, targets):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = r.integers(1, 500, 400)
    frame = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p)], "tokens long, p_a double, p_b double, p_c double")
    plan = mixing.fit_rates(frame, targets, lowest=lowest)
    t = np.array(list(targets.values()))
    natural = tokens @ p / tokens.sum()
    wanted = t * max(1.0, lowest * (natural / t).max())
    rate = np.ones(len(p))
    for _ in range(20_000):
        rate = np.maximum(rate - 0.5 * (p @ (((tokens * rate) @ p / tokens.sum() - wanted) / natural)), lowest)
    best = (tokens * rate) @ p / tokens.sum()
    reached = (tokens * plan.rates(p)) @ p / tokens.sum()
    np.testing.assert_allclose(reached, best, atol=5e-3)
    assert plan.rates(p).min() >= lowest and plan.met == (np.abs(best / best.sum() - t).max() <= mixing.MISS)
    if not lowest and not plan.met:
        pytest.fail("these targets are within reach")


@pytest.mark.parametrize("good", [0.5, 0.2, 0.6])
def test_targets_far_from_the_natural_mix(spark, good):
    """Nine tokens in ten are good ones; rates fall to zero and rise as far as the targets ask."""
    r = np.random.default_rng(6)
    is_good = r.random(2000) < 0.92
    p = np.where(is_good, r.beta(15, 1, 2000), r.beta(1, 15, 2000))
    tokens = r.integers(20, 500, 2000)
    frame = spark.createDataFrame([(int(t), float(q), float(1 - q)) for t, q in zip(tokens, p)], "tokens long, p_good double, p_poor double")
    plan = mixing.meet_targets(frame, {"good": good, "poor": 1 - good})
    both = np.stack([p, 1 - p], axis=1)
    mass = (tokens * plan.rates(both)) @ both
    assert plan.met and abs(mass[0] / mass.sum() - good) < 0.01
    assert abs(mass.sum() / tokens.sum() - 1) < 0.01 and plan.rates(both).min() >= 0 and plan.rates(both).max() > 2


def test_mix_keeps_every_document_and_repeats_by_rate(spark):
    rows = table(spark)
    docs = spark.createDataFrame([(i, t, "en", None) for i, t, _ in rows], "doc_id long, text string, lang string, rate string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    targets = {"good": 0.7, "poor": 0.3}
    rate = {r["doc_id"]: r["rate"] for r in mixing.mixing_rates(docs, labels, targets, mixing.KEEPING).collect()}
    mixed = mixing.mix(docs, labels, targets)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times.keys() == rate.keys()
    assert all(int(rate[i]) <= n <= int(rate[i]) + 1 for i, n in times.items())
    assert abs(sum(times.values()) - sum(rate.values())) < 40


@pytest.mark.parametrize("labelled", [True, False])
def test_awkward_documents(spark, labelled):
    docs = documents(spark)
    labels = spark.createDataFrame([(100 + i, i % 2 if labelled else 1, None) for i in range(60)] + [(None, 1, 1), (3, None, 0), (101, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, labels)
    assert got.count() == docs.count() and got.filter("rate is null").count() == 0
    assert mixing.mix(docs, labels).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert mixing.mixing_rates(empty(spark), labels).count() == 0 and mixing.mix(empty(spark), labels).count() == 0


def test_default_targets_are_met_with_a_third_poor(spark):
    """Soft posteriors, and documents of a corpus whose poor source holds a third of the tokens."""
    r = np.random.default_rng(4)
    good = r.random(1500) < 2 / 3
    p = np.where(good, r.beta(20, 1, 1500), r.beta(1, 20, 1500))
    tokens = r.integers(20, 500, 1500)
    frame = spark.createDataFrame([(int(t), float(q), float(1 - q)) for t, q in zip(tokens, p)], "tokens long, p_good double, p_poor double")
    plan = mixing.meet_targets(frame, mixing.KEEPING_TARGETS, mixing.KEEPING)
    both = np.stack([p, 1 - p], axis=1)
    mass = (tokens * plan.rates(both)) @ both
    np.testing.assert_allclose(mass / mass.sum(), plan.shares, rtol=1e-9)
    assert plan.met and plan.rates(both).min() >= mixing.KEEPING

    rows = table(spark)
    poor = sum(len(t.split()) for _, t, q in rows if not q) / sum(len(t.split()) for _, t, _ in rows)
    assert poor > 0.31
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, labels, mixing.KEEPING_TARGETS, mixing.KEEPING).collect()
    mass = {n: sum(g["rate"] * g["tokens"] * g[f"p_{n}"] for g in got) for n in mixing.KEEPING_TARGETS}
    assert abs(mass["good"] / sum(mass.values()) - 0.9) <= mixing.MISS


def test_targets_out_of_reach_are_said(spark, caplog):
    frame = spark.createDataFrame([(10, 0.6, 0.4), (30, 0.2, 0.8)], "tokens long, p_good double, p_poor double")
    plan = mixing.meet_targets(frame, mixing.KEEPING_TARGETS)
    assert plan.miss > 0.2 and not plan.met
    assert "target 0.9" in caplog.text


def test_wide_identifiers_and_other_columns_come_back(spark):
    docs = wide(spark, [words(30, i) for i in range(20)])
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(WIDE) if i is not None], "doc_id long, quality int")
    got = mixing.mixing_rates(docs, labels)
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, WIDE * 4))
    assert set(map(str, mixing.mix(docs, labels).collect())) == set(map(str, docs.collect()))


def test_model_does_not_depend_on_partitions(spark):
    rows = table(spark, 200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    domains = mixing.domain_of(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    models = [mixing.fit(docs.repartition(n), domains, ["good", "poor"]) for n in (1, 5)]
    np.testing.assert_array_equal(models[0].words, models[1].words)
