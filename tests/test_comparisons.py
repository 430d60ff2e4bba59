import math

from lexiprint.operators import comparisons as K
from lexiprint.operators import judging as J
from lexiprint.operators import naming as N
from pyspark.sql import functions as F


def test_names_and_kinds_take_the_first_rule(spark):
    rows = [(1, " Claude-3.5 "), (2, "GPT-4-1106-preview"), (3, "gpt-4o"), (4, "LLAMA-3-70b"), (5, "Own"), (6, None)]
    df = spark.createDataFrame(rows, "id int, model string").select("id", N.model_name(F.col("model")).alias("m"))
    got = {r["id"]: tuple(r["m"]) for r in df.collect()}
    assert got == {1: ("anthropic", "claude", "unknown"), 2: ("openai", "gpt-4", "dated"), 3: ("openai", "gpt-4o", ""), 4: ("meta", "llama3-70b", ""), 5: ("unknown", "own", ""), 6: ("unknown", "", "")}
    texts = ["Actor dies at 90?", "Photo of it?", "Why?", "An editorial", "", None, "REPLY to motion for stay", "the answer"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", N.category(F.col("t")).alias("c"), N.document_kind(F.col("t")).alias("k")).orderBy("id")
    got = df.collect()
    assert [r["c"] for r in got] == ["obituary", "media", "analysis", "opinion", "news", "news", "news", "news"]
    assert [r["k"] for r in got][5:] == ["OTHER", "MOTION", "RESPONSE"]


def test_judgements_by_hand_and_without_features(spark):
    df = spark.createDataFrame([(1, 0.72, 0.56), (2, 0.45, 0.56)], "doc_id long, sentence_length_cv double, type_token_ratio double")
    got = {r["doc_id"]: r for r in J.likelihood(df).collect()}
    human = 1.47 + 1.07 / (1 + 0.12 / 0.12)
    ai = 1.47 / (1 + 0.27 / 0.15) + 1.07
    assert math.isclose(got[1]["human"], human / (human + ai)) and got[1]["label"] == "human" and got[2]["label"] == "ai"
    votes = {r["doc_id"]: (r["human_votes"], r["ai_votes"], r["label"], r["confidence"]) for r in J.votes(df).collect()}
    assert votes == {1: (1, 1, "ai", 0.5), 2: (0, 2, "ai", 1.0)}
    heuristic = {r["doc_id"]: r["ai_share"] for r in J.heuristic(df).collect()}
    want = (0.267 * (0.822 - 0.72) / 0.4 + 0.085 * (0.596 - 0.56) / 0.115) / (0.267 + 0.085)
    assert math.isclose(heuristic[1], want)
    shares = [r["share"] for r in J.model_shares(df).filter("doc_id = 1").collect()]
    assert len(shares) == 7 and math.isclose(sum(shares), 1)
    bare = df.select("doc_id")
    assert J.likelihood(bare).first()["human"] == 0.5 and J.votes(bare).first()["label"] == "unknown" and J.heuristic(bare).first()["label"] == "UNCERTAIN" and J.model_shares(bare).count() == 0


def test_deformation_with_missing_modes_and_baselines(spark):
    zero, one = [0.0] * 39, [0.0] * 38 + [2.0]
    rows = [("a", "neutral", zero), ("a", "critique", one), ("a", "extract", zero), ("a", "other", one), ("b", "critique", one), ("c", "neutral", None)]
    df = spark.createDataFrame(rows, "model string, mode string, vec array<double>")
    got = {(r["model"], r["mode"]): (r["size"], r["syntactic"], r["trajectory"], r["rank"]) for r in K.deformations(df).collect()}
    assert got == {("a", "critique"): (2.0, 2.0, 0.0, 1), ("a", "extract"): (0.0, 0.0, 0.0, 2)}
    (signature,) = (r["signature"] for r in K.deformation_signature(df).collect())
    assert len(signature) == 195 and signature[38] == 1.0 and sum(signature) == 1.0
    assert K.distinctive_modes(K.deformations(df)).count() == 0


def test_plain_effects_deviations_and_empty_tables(spark):
    df = spark.createDataFrame([(True, [0.0, 1.0]), (True, [2.0, 1.0]), (False, [4.0, 1.0]), (False, [6.0, 1.0]), (None, [9.0, 9.0])], "is_human boolean, vec array<double>")
    got = {r["dim"]: (r["d"], r["zero_human"], r["zero_ai"]) for r in K.plain_effects(df).collect()}
    assert got == {0: (4.0, 0.5, 0.0), 1: (0.0, 0.0, 0.0)}
    v = spark.createDataFrame([("h", [10.0, 0.0]), ("m", [13.0, 1.0])], "model string, vec array<double>")
    assert [(r["dim"], r["percent"], r["band"]) for r in K.deviations(v, "h").collect()] == [(0, 30.0, "MODERATE")]
    assert K.separation(v.limit(0)).count() == 0 and K.deviations(v.limit(0), "h").count() == 0 and K.plain_effects(df.limit(0)).count() == 0


def test_trust_keeps_little_of_a_false_claim(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.95, True), (2, "b", "a", 0.4, False), (3, None, "a", 0.0, False)], "id int, claim string, found string, claimed_confidence double, matched boolean")
    got = {r["id"]: (r["trust_score"], r["value"], r["alert"]) for r in K.trust_evidence(df).collect()}
    assert got == {1: (1.0, 0.95, None), 2: (0.4 * 0.3, 0.3, "claims b, matches a"), 3: (0.0, 0.3, "claims nothing, matches a")}
