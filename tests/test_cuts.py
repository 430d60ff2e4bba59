"""Sentences, clauses and stance of flattened texts and of texts without cues, against plain Python by the patterns as documented."""

import random
import re
from statistics import fmean

import pytest

from lexiprint.operators import registry, stance

CUT = r"(?<=[,;:])\s+|\s*[—–]\s*|\s+(?:but|and|or|yet|so|because|although|while|if|when|since|unless)\s+"
MORE = ["yes and no", "so and so. And then\r\n\r\nMr. and Mrs. X, — or Dr.\tWho: it — e.g. this", "", None, " \n ", "a and and b. etc. c", "Prof.\nA\x0bB\x0cC. and D", "one\u00a0two, three\x01. four – five", "vs. it", "x" * 40]


def texts():
    r = random.Random(8)
    parts = ["Mr.", "Dr.\n", "e.g.", "etc.", "and", "But", "—", "–", "word", "other", "it,", "so;", "end.", "why?", "no!", "\n\n", "\t", "  ", "i.e.", "amr.", "perhaps", "could", "is", "éte"]
    return [*MORE, *("".join(r.choice(parts) + r.choice([" ", "", " ", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(150))]


def sentences(text, titles):
    space = r"[ \t\n\x0b\f\r]"
    for names in titles:
        text = re.sub(rf"(?<![^\W])({names})\.{space}", "\\1\x01 ", text)
    return [s for s in (p.replace("\x01", ".").strip(" \t\n\x0b\f\r") for p in re.split(rf"(?<=[.!?]){space}+", text)) if s]


def words(s):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", s) if w]


def test_sentences_and_clauses(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in registry.extract(docs, ["layer_d", "layer_e"]).collect()}
    for i, text in enumerate(texts()):
        text, lengths = text or "", []
        said = sentences(text, ["Mr|Mrs|Ms|Dr|Prof|Sr|Jr", r"e\.g|i\.e|etc"])
        for s in said:
            n = [len(words(c)) for c in re.split(CUT.replace(r"\s", r"[ \t\n\x0b\f\r]"), s, flags=re.IGNORECASE)]
            lengths += [k for k in n if k >= 2] or [len(words(s))]
        want = fmean(lengths) if len(words(text)) >= 10 and lengths else 0
        assert got[i]["layer_d_clause_length_mean"] == pytest.approx(want), repr(text)
        assert got[i]["layer_d_sentence_complexity"] == pytest.approx(len(lengths) / max(len(said), 1) if len(words(text)) >= 10 and lengths else 0)
        light = sentences(text, ["Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Jr|Sr|vs"])
        assert got[i]["layer_e_question_ratio"] == pytest.approx(text.count("?") / len(light) if len(light) >= 2 else 0)


def test_confidence_of_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in registry.extract(docs, ["layer_c1"]).collect()}
    count = lambda s, sets: sum(len(re.findall(stance.pattern(v), s)) for v in sets)
    for i, text in enumerate(texts()):
        scores = []
        for s in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", re.sub("[é]", "_", (text or "").lower())):
            a, b, c = (count(s, [stance.CONFIDENCE[k]]) for k in ("high", "medium", "low"))
            h = count(s, stance.HEDGES.values())
            n = a + b + c + h
            scores += [min(max((a + 0.6 * b + 0.3 * c - 0.3 * h) / n, 0), 1) if n else 0.5] if s.strip(" \t\n\x0b\f\r") else []
        assert got[i]["layer_c1_confidence_mean"] == pytest.approx(fmean(scores) if len(words(text or "")) >= 5 and scores else 0.5), repr(text)


def test_parts_of_sentences_are_cut_at_letters(spark):
    docs = spark.range(8).selectExpr("id as doc_id", "concat('a b c ', id) as text").repartition(8)
    plan = registry.extract(docs, ["layer_d"])._jdf.queryExecution().optimizedPlan().toString()
    assert r"\s+, -1" not in plan and "size(array_remove(split(lambda" in plan
