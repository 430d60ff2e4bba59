import math

from pyspark.sql import functions as F

from lexiprint.operators import corpus, formatting, naming, tagging


def test_tag_features_of_a_small_text(spark):
    tags = "DET ADJ NOUN VERB ADV PUNCT CCONJ NOUN AUX VERB ADP DET PROPN".split()
    rows = [(1, [*tags, None, ""]), (2, None), (3, []), (4, ["NOUN"])]
    got = {r["doc_id"]: r for r in tagging.tag_features(spark.createDataFrame(rows, "doc_id long, tags array<string>")).collect()}
    one = got[1]
    assert one["pos_noun_ratio"] == 3 / 13 and one["pos_verb_ratio"] == 3 / 13 and one["pos_noun_verb_ratio"] == 1
    assert one["pos_content_function_ratio"] == 8 / 4 and abs(one["bigram_aux_verb_rate"] - 100 / 12) < 1e-9
    assert abs(one["bigram_entropy_norm"] - 1) < 1e-9  # all twelve pairs differ
    assert all(v == 0 for i in (2, 3) for k, v in got[i].asDict().items() if k != "doc_id")
    assert got[4]["pos_noun_ratio"] == 1 and got[4]["bigram_entropy_norm"] == 0 and not any(math.isnan(v) for v in got[4])


def test_layouts(spark):
    def one(text, domain, subdomain=None, title=None, url=None, case_name=None, court=None, date=None):
        cols = [F.lit(x).cast("string") for x in (text, domain, subdomain, title, url, case_name, court, date)]
        return spark.range(1).select(formatting.formatted(*cols)).first()[0]

    assert one("# Head #\nbody\n", "journalistic") == "# Head\n\nbody"
    assert one("body", "journalistic", title="T", url="u") == "# T\n\n*Source: u*\n\nbody"
    assert one("body", "academic", "essays", "T") == "T\n\nbody" and one(" body ", "academic") == "body"
    assert one("def f(): 1", "technical") == "```python\ndef f(): 1\n```" and one(" text ", "technical") == "text"
    assert one("body", "legal", case_name="A v. B", date="1999") == "**Case:** A v. B\n**Date:** 1999\n\n---\n\nbody" and one("body", "legal") == "body"
    assert one(None, "journalistic") == "" and one(None, None) == ""


def test_who_wrote_it(spark):
    rows = [(True, "gpt", "m", True), (False, "human", None, False), (None, "A HUMAN", "m", True), (None, "machine made", None, False), (None, "web", "m", False), (None, "web", "", True), (None, None, None, True)]
    df = spark.createDataFrame(rows, "is_original boolean, source string, model string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", formatting.written_by_human(df)).collect())
    assert spark.range(1).select(formatting.written_by_human(spark.range(1))).first()[0] is True


def test_merged_names(spark):
    names = {"Claude-3-Opus": ("anthropic", "claude-opus"), "gemini-1.5-pro": ("google", "gemini-1.5"), "llama-3-70b": ("meta", "llama-70b"), "Odd One": ("unknown", "odd one"), None: ("unknown", "")}
    df = spark.createDataFrame([(n,) for n in names], "m string")
    assert {r["m"]: tuple(r["n"]) for r in df.select("m", naming.merged_name(F.col("m")).alias("n")).collect()} == names


def test_one_row_of_each_text_whatever_the_identifiers(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "c"), (None, "d"), (2, "d"), (None, None), (3, "")]
    got = corpus.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a"), (1, "b"), (None, "c"), (2, "d"), (3, "")]))
