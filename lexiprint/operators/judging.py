"""Judgements of feature rows by fixed reference values: likelihoods, votes, the heuristic score and shares of models.

Each takes a row per document with whatever of the named features it has; the
rest are left out of sums and weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T

# Mean and deviation of human text, of machine text, and weight.
LIKELIHOOD = {
    "sentence_length_cv": (0.72, 0.22, 0.45, 0.15, 1.47),
    "paragraph_length_cv": (0.65, 0.25, 0.38, 0.20, 1.10),
    "type_token_ratio": (0.68, 0.12, 0.56, 0.10, 1.07),
    "compression_ratio": (0.42, 0.08, 0.35, 0.06, 0.99),
    "list_marker_rate": (0.002, 0.01, 0.025, 0.04, 0.93),
    "hapax_legomena_ratio": (0.52, 0.12, 0.43, 0.10, 0.75),
}
# Mean and deviation of human text and of machine text.
VOTES = {
    "sentence_length_cv": (0.89, 0.15, 0.35, 0.10),
    "paragraph_length_cv": (0.65, 0.20, 0.30, 0.12),
    "type_token_ratio": (0.72, 0.08, 0.58, 0.10),
    "compression_ratio": (0.71, 0.05, 0.64, 0.04),
    "list_marker_rate": (0.001, 0.003, 0.015, 0.02),
    "hapax_legomena_ratio": (0.52, 0.08, 0.38, 0.10),
}
# Mean of human text, of machine text, and weight.
HEURISTIC = {
    "compression_ratio": (0.564, 0.473, 0.188),
    "sentence_length_cv": (0.822, 0.422, 0.267),
    "paragraph_length_cv": (0.847, 0.493, 0.119),
    "list_marker_rate": (0.010, 0.107, 0.110),
    "type_token_ratio": (0.596, 0.481, 0.085),
    "punctuation_entropy": (1.590, 1.982, 0.068),
    "hapax_rate": (0.417, 0.355, 0.049),
    "sentence_initial_entropy": (0.860, 0.777, 0.059),
    "function_word_cv": (1.420, 1.217, 0.027),
    "em_dash_rate": (0.283, 0.091, 0.029),
}
# sentence_length_cv, compression_ratio and list_marker_rate of each model.
MODELS = {
    "HUMAN": (0.822, 0.564, 0.010),
    "GPT_4-o": (0.507, 0.481, 0.214),
    "gemma-2-9b": (0.462, 0.504, 0.158),
    "mistral-7B": (0.408, 0.462, 0.022),
    "qwen-2-72B": (0.385, 0.459, 0.013),
    "llama-8B": (0.372, 0.462, 0.126),
    "yi-large": (0.394, 0.469, 0.108),
}
MODEL_FEATURES = ["sentence_length_cv", "compression_ratio", "list_marker_rate"]


def _distance(name: str, mean: float, sd: float) -> Column:
    return F.abs(F.col(name) - mean) / sd


def likelihood(features: DataFrame) -> DataFrame:
    """``doc_id, human, ai, label``: weighted closeness to both kinds of text, in deviations; one half each without features."""
    known = {k: v for k, v in LIKELIHOOD.items() if k in features.columns}
    human = T.total([w / (1 + _distance(k, m, s)) for k, (m, s, _, _, w) in known.items()] or [F.lit(1.0)])
    ai = T.total([w / (1 + _distance(k, m, s)) for k, (_, _, m, s, w) in known.items()] or [F.lit(1.0)])
    out = features.select("doc_id", human.alias("h"), ai.alias("a"))
    out = out.select("doc_id", (F.col("h") / (F.col("h") + F.col("a"))).alias("human"), (F.col("a") / (F.col("h") + F.col("a"))).alias("ai"))
    return out.withColumn("label", F.when(F.col("human") > F.col("ai"), "human").otherwise("ai"))


def votes(features: DataFrame) -> DataFrame:
    """``doc_id, human_votes, ai_votes, label, confidence``: each feature votes for the kind it is nearer to, machine on a tie."""
    known = {k: v for k, v in VOTES.items() if k in features.columns}
    if not known:
        return features.select("doc_id", F.lit(0).alias("human_votes"), F.lit(0).alias("ai_votes"), F.lit("unknown").alias("label"), F.lit(0.5).alias("confidence"))
    human = T.total([F.when(_distance(k, hm, hs) < _distance(k, am, s), 1).otherwise(0) for k, (hm, hs, am, s) in known.items()])
    out = features.select("doc_id", human.alias("human_votes")).withColumn("ai_votes", F.lit(len(known)) - F.col("human_votes"))
    return out.withColumns({"label": F.when(F.col("human_votes") > F.col("ai_votes"), "human").otherwise("ai"), "confidence": F.greatest("human_votes", "ai_votes") / len(known)})


def heuristic(features: DataFrame) -> DataFrame:
    """``doc_id, ai_share, label, confidence``: weighted place of each feature between the two means, within 0 and 1.

    Above .6 the label is AI, below .4 HUMAN, else UNCERTAIN.
    """
    known = {k: v for k, v in HEURISTIC.items() if k in features.columns}
    weight = sum(w for _, _, w in known.values())
    score = T.total([T.clamp((F.col(k) - h) / (a - h), 0.0, 1.0) * w for k, (h, a, w) in known.items()]) / weight if known else F.lit(0.5)
    out = features.select("doc_id", score.alias("ai_share"))
    return out.withColumns({"label": F.when(F.col("ai_share") > 0.6, "AI").when(F.col("ai_share") < 0.4, "HUMAN").otherwise("UNCERTAIN"), "confidence": F.abs(F.col("ai_share") - 0.5) * 2})


def model_shares(features: DataFrame) -> DataFrame:
    """``doc_id, model, share``: closeness 1 - 2 * (mean absolute difference), 0 at least, by its sum over the models.

    All shares are 0 where no model is close.
    """
    at = [n for n, k in enumerate(MODEL_FEATURES) if k in features.columns]
    if not at:
        return features.select("doc_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("share")).limit(0)
    close = F.array(*(F.struct(F.lit(m).alias("model"), F.greatest(F.lit(0.0), 1 - 2 * T.total([F.abs(F.col(MODEL_FEATURES[n]) - v[n]) for n in at]) / len(at)).alias("c")) for m, v in MODELS.items()))
    out = features.select("doc_id", close.alias("close")).withColumn("total", T.sum_of(F.transform("close", lambda x: x["c"])))
    share = F.when(F.col("total") > 0, F.col("m.c") / F.col("total")).otherwise(0.0)
    return out.select("doc_id", "total", F.explode("close").alias("m")).select("doc_id", F.col("m.model").alias("model"), share.alias("share"))
