"""Comparisons of vectors under pressure: stress, attacks, separation, plain effects, deviation and trust evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.operators.profiles import components, long_form

# The modes in which a model is stressed, and the layers' components (first, and first behind).
MODES = ["critique", "creative", "synthesize", "extract", "explain"]
LAYERS = {"trajectory": (0, 5), "echo": (5, 20), "epistemic": (20, 26), "transitions": (26, 32), "syntactic": (32, 39)}
WIDTH = 39


def _shifts(vectors: DataFrame) -> DataFrame:
    """``model, mode, dim, shift``: mean of each mode less the mean of the neutral mode (``model, mode, vec``)."""
    means = long_form(vectors, "model", "mode").filter(F.col("dim") < WIDTH).groupBy("model", "mode", "dim").agg(F.avg("x").alias("x"))
    neutral = F.max(F.when(F.col("mode") == "neutral", F.col("x"))).over(Window.partitionBy("model", "dim"))
    return means.withColumn("shift", F.col("x") - neutral).filter(F.col("mode").isin(MODES) & F.col("shift").isNotNull()).drop("x")


def deformations(vectors: DataFrame) -> DataFrame:
    """``model, mode, size, <layer>..., rank``: how far each mode moves a model, whole and by layer; rank 1 moves most.

    Ties go to the name.  Models without neutral vectors have no rows.
    """
    norm = lambda a, b: F.sqrt(F.coalesce(F.sum(F.when((F.col("dim") >= a) & (F.col("dim") < b), F.col("shift") * F.col("shift"))), F.lit(0.0)))
    got = _shifts(vectors).groupBy("model", "mode").agg(norm(0, WIDTH).alias("size"), *(norm(a, b).alias(k) for k, (a, b) in LAYERS.items()))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("size"), "mode")))


def deformation_signature(vectors: DataFrame) -> DataFrame:
    """``model, signature``: the modes' shifts, each of length 1, behind each other; zeros for a mode that is missing."""
    unit = F.try_divide(F.col("shift"), F.sqrt(F.sum(F.col("shift") * F.col("shift")).over(Window.partitionBy("model", "mode"))))
    place = F.array_position(F.array(*map(F.lit, MODES)), F.col("mode")) - 1
    rows = _shifts(vectors).select("model", (place * WIDTH + F.col("dim")).cast("int").alias("at"), F.coalesce(unit, F.lit(0.0)).alias("u"))
    entries = rows.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("at", "u"))).alias("m"))
    return entries.select("model", F.transform(F.sequence(F.lit(0), F.lit(WIDTH * len(MODES) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("signature"))


def distinctive_modes(deformed: DataFrame) -> DataFrame:
    """``mode, variance, range, rank``: spread of the models' sizes in each mode; rank 1 tells models apart best."""
    got = deformed.groupBy("mode").agg(F.var_pop("size").alias("variance"), (F.max("size") - F.min("size")).alias("range"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "mode")))  # five rows at most


def against_baseline(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """``attack, category, n, distance, correlation, cosine, rank``: means over an attack's samples; rank 1 moves most.

    ``samples`` has ``sample, attack, category, vec``; ``baseline`` one row with ``vec``.
    """
    base = F.broadcast(long_form(baseline.limit(1), "vec").select("dim", F.col("x").alias("b")))
    each = long_form(samples, "sample", "attack", "category").join(base, "dim").groupBy("sample", "attack", "category")
    parts = each.agg(F.sqrt(F.sum((F.col("x") - F.col("b")) * (F.col("x") - F.col("b")))).alias("distance"), F.corr("x", "b").alias("correlation"), (F.sum(F.col("x") * F.col("b")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))), F.lit(0.0))).alias("cosine"))
    got = parts.groupBy("attack", "category").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("distance", "correlation", "cosine")))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("distance"), "attack")))  # a row an attack


def separation(vectors: DataFrame) -> DataFrame:
    """``a, b, distance, correlation, rank, similar_rank``: every two models' means, most different first.

    ``rank`` and ``similar_rank`` up to 3 are the three most different and most similar pairs.
    """
    means = components(vectors).select("model", "dim", "mean")
    left, right = means.select(F.col("model").alias("a"), "dim", F.col("mean").alias("x")), means.select(F.col("model").alias("b"), "dim", F.col("mean").alias("y"))
    pairs = left.join(right, "dim").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"), F.corr("x", "y").alias("correlation"))
    # a row for every two models
    return pairs.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("distance"), "a", "b")), "similar_rank": F.row_number().over(Window.orderBy("distance", F.desc("a"), F.desc("b")))})


def plain_effects(vectors: DataFrame, zero: float = 0.0) -> DataFrame:
    """``dim, human, ai, d, zero_human, zero_ai`` of ``is_human, vec``: AI less human by the plain mean of both population variances.

    The zero rates count components of at most ``zero`` in size; d is 0 without spread.
    """
    of = lambda f, human: f(F.when(F.col("is_human") == human, F.col("x")))
    rate = lambda human: F.avg(F.when(F.col("is_human") == human, (F.abs("x") <= zero).cast("int")))
    got = long_form(vectors, "is_human").groupBy("dim").agg(of(F.avg, True).alias("human"), of(F.avg, False).alias("ai"), of(F.var_pop, True).alias("_h"), of(F.var_pop, False).alias("_a"), rate(True).alias("zero_human"), rate(False).alias("zero_ai"))
    spread = F.sqrt((F.col("_h") + F.col("_a")) / 2)
    return got.select("dim", "human", "ai", F.when(spread > 0, (F.col("ai") - F.col("human")) / spread).otherwise(0.0).alias("d"), "zero_human", "zero_ai")


def deviation(percent: Column) -> Column:
    size = F.abs(percent)
    return F.when(size < 10, "NEAR").when(size < 25, "MINOR").when(size < 50, "MODERATE").otherwise("MAJOR")


def deviations(vectors: DataFrame, base: str) -> DataFrame:
    """``model, dim, percent, band``: each model's means against those of the model ``base``; components with base 0 are left out."""
    means = components(vectors).select("model", "dim", "mean")
    own = F.broadcast(means.filter(F.col("model") == base).select("dim", F.col("mean").alias("b")))
    percent = (F.col("mean") - F.col("b")) / F.abs("b") * 100
    return means.filter(F.col("model") != base).join(own, "dim").filter("b <> 0").select("model", "dim", percent.alias("percent"), deviation(percent).alias("band"))


def trust_evidence(verified: DataFrame) -> DataFrame:
    """``id, trust_score, verified, value, alert`` of ``profiles.verify``: a true claim is raised by a tenth, a false one keeps 0.3 of it."""
    share = F.col("claimed_confidence")
    score = F.when(F.col("matched"), F.least(F.lit(1.0), share * 1.1)).otherwise(share * 0.3)
    alert = F.when(~F.col("matched"), F.concat(F.lit("claims "), F.coalesce("claim", F.lit("nothing")), F.lit(", matches "), F.col("found")))
    return verified.select("id", score.alias("trust_score"), F.col("matched").alias("verified"), F.when(F.col("matched"), share).otherwise(0.3).alias("value"), alert.alias("alert"))
