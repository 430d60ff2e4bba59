"""Patterns are looked for only in texts that hold one of their cues, with the same matches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L
from lexiprint.operators import registry, style

ODD = ["unethics on one handful, on another hand", "wwww so,, like, goin' on... what!? w/ b/c it's", "ok  ok éthics caféas aś as", "trade-off tradeoffs trade offs", "", None]


def texts():
    r = random.Random(4)
    words = sorted({w for p in style.PATTERNS for w in re.findall("[a-z]+", p)})
    said = [t.strip("\n\0") for p in style.PATTERNS for t in T._texts(T._parser.parse(p))[:40]]
    filler = ["lorem", "it's", "the", "a", "--", "(x)", "été", "9"]
    rows = [" ".join(r.choice(r.choice([words, said, filler, filler])) for _ in range(r.randint(1, 40))) + r.choice([".", "!", "..", " ?"]) for _ in range(300)]
    return [*rows, *ODD, *(" ".join(filler) + f" {t} lorem ipsum" for t in said[::3])]


def test_cues_are_necessary():
    for p in style.PATTERNS:
        words, parts = T.cues(p)
        for t in texts():
            for m in re.finditer(p, t or ""):
                found = re.findall(r"(?<![^\W])[a-z]+(?![^\W])", t)
                assert not words | parts or words & set(found) or any(x in m[0] for x in parts), (p, m[0])
    assert T.cues(r"\b(it (depends|varies))\b") == ({"depends", "varies"}, set())
    assert T.cues(r"\.{3,}") == (set(), {"..."}) and T.cues(r"\b\w+\b") == (set(), set())
    assert T.cues(r"\b(some (argue|think).*while others)\b")[0] == {"others"}


@pytest.mark.parametrize("patterns", [style.PATTERNS, [r"\b\w*([a-z])\1{3,}\w*\b"]])
def test_same_matches_with_and_without_cues(spark, patterns):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    df = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    df = df.withColumn("plain", F.regexp_replace("text", r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")).withColumn("found", T.alpha_words(F.col("text")))
    wrong = df.filter(F.array(*(T.matches(F.col("plain"), [p], F.col("found")) for p in patterns)) != F.array(*(T.matches(F.col("plain"), [p]) for p in patterns)))
    assert wrong.count() == 0 and df.filter(T.matches(F.col("plain"), patterns, F.col("found")) > 0).count() > 0


def test_last_quarter_that_begins_inside_a_word(spark):
    text = "above all " + "x " * 29 + "unethics" + " y" * 9
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tail = text[int(len(text) * 0.75) :]
    got = registry.extract(docs, ["alignment"]).first()["alignment_moralizing_coda"]
    assert tail.startswith("ethics")
    moral = lambda t: sum(len(re.findall(p, t)) for p in L.MORALIZING_PATTERNS)
    assert got == pytest.approx(0.4 * min(moral(text), 1) + 0.6 * (moral(tail) / moral(text) if moral(text) else 0))


def test_alignment_counts_each_pattern_once(spark):
    docs = spark.range(8).selectExpr("id as doc_id", "concat('a b c ', id) as text").repartition(8)
    plan = registry.extract(docs, ["alignment"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\b(to begin with)\b") == 1 and plan.count(r"\b(it follows that)\b") == 1
