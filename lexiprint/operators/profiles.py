"""Model profiles over feature vectors: centroids, spread, identification and claim checks.

Vectors come as ``model, vec`` (array of doubles).  Profiles are one row per
model; everything that compares a vector with all profiles carries the profile
set as one array in one row, so no row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import moments as M
from lexiprint.operators.sequences import dot, following

#: Profiles that may be held in one row (an array of centroids) at most.
MOST_PROFILES = 10_000
#: Trust by softmax confidence, and its temperature.
HIGH, MEDIUM, LOW = 0.85, 0.70, 0.50
TEMPERATURE = 0.5
#: Samples a model needs before its covariance counts.
LEAST_SAMPLES = 10


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(T.sum_of(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def long_form(vectors: DataFrame, *keys: str) -> DataFrame:
    """``keys..., dim, x``: one row a component; null vectors have none."""
    return vectors.select(*keys, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def components(vectors: DataFrame) -> DataFrame:
    """``model, dim, n, mean, sd``: sample standard deviation, partial sums before the one shuffle."""
    return long_form(vectors, "model").groupBy("model", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))


def centroids(vectors: DataFrame) -> DataFrame:
    """``model, n, centroid``."""
    parts = components(vectors).groupBy("model").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("parts"))
    return parts.select("model", "n", F.transform("parts", lambda p: p["mean"]).alias("centroid"))


def covariance(vectors: DataFrame) -> DataFrame:
    """``model, i, j, cov`` (i <= j) of models with ``LEAST_SAMPLES`` vectors, from one matrix a task and model."""
    return M.covariances(M.moments(vectors), least=LEAST_SAMPLES)


def family(model: Column, rules: list[tuple[str, str]]) -> Column:
    """Family of the first rule whose part is in the lower-case name, or 'unknown'."""
    out = F.lit("unknown")
    for part, name in reversed(rules):
        out = F.when(F.contains(F.lower(model), F.lit(part)), name).otherwise(out)
    return out


def _profile_row(profiles: DataFrame) -> DataFrame:
    if profiles.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    return F.broadcast(profiles.agg(F.sort_array(F.collect_list(F.struct("model", "centroid"))).alias("profiles")))


def distances(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """``id, near``: for each vector (``id, vec``) the models by distance, nearest first, ties by name."""
    near = F.sort_array(F.transform("profiles", lambda p: F.struct(distance(F.col("vec"), p["centroid"]).alias("distance"), p["model"].alias("model"))))
    return vectors.select("id", "vec").crossJoin(_profile_row(profiles)).select("id", near.alias("near"))


def identify(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """``id, model, distance, confidence, trust, minmax``: the nearest model with softmax and min-max confidence.

    The min-max confidence of the nearest is 1, and 0.5 if several models are
    all equally far.
    """
    near = distances(vectors, profiles)
    d = F.transform("near", lambda x: x["distance"])
    shifted = F.transform(F.col("d"), lambda x: F.exp((F.get("d", F.lit(0)) - x) / TEMPERATURE))
    confidence = 1 / T.sum_of(shifted)
    far, close = F.array_max("d"), F.get("d", F.lit(0))
    minmax = F.when((F.size("d") > 1) & (far == close), 0.5).otherwise(1.0)
    out = near.withColumn("d", d).select("id", F.get("near", F.lit(0))["model"].alias("model"), close.alias("distance"), confidence.alias("confidence"), minmax.alias("minmax"))
    return out.withColumn("trust", trust(F.col("confidence")))


def trust(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").when(confidence >= LOW, "low").otherwise("reject")


def verify(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """``id, claim, found, claimed_confidence, matched, trust``: is a vector (``id, claim, vec``) by whom it is said to be?

    The confidence is the claimed model's softmax share; a claim other than
    the nearest model lowers high and medium trust to low.  An unknown claim
    has confidence 0.
    """
    near = distances(vectors, profiles).join(vectors.select("id", "claim"), "id")
    shares = F.transform("near", lambda x: F.struct(x["model"].alias("model"), F.exp((F.get("near", F.lit(0))["distance"] - x["distance"]) / TEMPERATURE).alias("e")))
    out = near.withColumn("shares", shares)
    total = T.sum_of(F.transform("shares", lambda s: s["e"]))
    mine = F.coalesce(F.get(F.filter("shares", lambda s: s["model"] == F.col("claim")), F.lit(0))["e"], F.lit(0.0))
    out = out.select("id", "claim", F.get("near", F.lit(0))["model"].alias("found"), (mine / total).alias("claimed_confidence"))
    out = out.withColumn("matched", F.coalesce(F.col("claim") == F.col("found"), F.lit(False)))
    level = trust(F.col("claimed_confidence"))
    return out.withColumn("trust", F.when(~F.col("matched") & level.isin("high", "medium"), "low").otherwise(level))


def new_only(fingerprints: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``fingerprints`` (``model, text, ...``) whose text the store does not hold for the model; repeats once.

    Texts are compared by the first 16 digits of their SHA-256.
    """
    hashed = fingerprints.withColumn("text_hash", F.substring(F.sha2(T.text_of("text"), 256), 1, 16)).dropDuplicates(["model", "text_hash"])
    return hashed.join(store.select("model", "text_hash"), ["model", "text_hash"], "left_anti")


# -- evaluation ---------------------------------------------------------------


def effect_band(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a >= 1.0, "very large").when(a >= 0.8, "large").when(a >= 0.5, "medium").when(a >= 0.2, "small").otherwise("negligible")


def effect_sizes(vectors: DataFrame, least: int = 10) -> DataFrame:
    """``dim, human, ai, d, band``: Cohen's d of each component, human less AI, with the pooled sample deviation.

    ``vectors`` has ``is_human`` and ``vec``; a component needs ``least``
    values on both sides; without spread d is 0.
    """
    side = lambda f, cond: f(F.when(cond, F.col("x")))
    h = F.col("is_human")
    agg = long_form(vectors, "is_human").groupBy("dim").agg(side(F.count, h).alias("nh"), side(F.count, ~h).alias("na"), side(F.avg, h).alias("human"), side(F.avg, ~h).alias("ai"), side(F.var_samp, h).alias("vh"), side(F.var_samp, ~h).alias("va")).filter((F.col("nh") >= least) & (F.col("na") >= least))
    pooled = F.sqrt(((F.col("nh") - 1) * F.col("vh") + (F.col("na") - 1) * F.col("va")) / (F.col("nh") + F.col("na") - 2))
    d = F.when(pooled > 0, (F.col("human") - F.col("ai")) / pooled).otherwise(F.lit(0.0))
    return agg.select("dim", "human", "ai", d.alias("d")).withColumn("band", effect_band(F.col("d")))


def effect_summary(effects: DataFrame, width: int = 8) -> DataFrame:
    """``part, mean_d, max_d, best``: absolute effects of each run of ``width`` components and the strongest one."""
    part = F.floor(F.col("dim") / width).cast("int")
    return effects.groupBy(part.alias("part")).agg(F.avg(F.abs("d")).alias("mean_d"), F.max(F.abs("d")).alias("max_d"), F.max_by("dim", F.struct(F.abs("d"), -F.col("dim"))).alias("best"))


def separability(vectors: DataFrame) -> DataFrame:
    """``a, b, distance, spread_a, spread_b``: centroid distances of every two models and mean variances within them.

    Every two models meet once; models are few and checked to be.
    """
    within = components(vectors).groupBy("model").agg(F.avg(F.when(F.col("n") > 0, F.col("sd") * F.col("sd") * (F.col("n") - 1) / F.col("n"))).alias("spread"))
    own = centroids(vectors).join(within, "model").select("model", "centroid", "spread")
    if own.limit(MOST_PROFILES + 1).count() > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} models")
    others = F.broadcast(own.agg(F.sort_array(F.collect_list(F.struct("model", "centroid", "spread"))).alias("others")))
    pairs = own.crossJoin(others).select("model", "centroid", "spread", F.explode(F.filter("others", lambda o: o["model"] > F.col("model"))).alias("o"))
    return pairs.select(F.col("model").alias("a"), F.col("o.model").alias("b"), distance(F.col("centroid"), F.col("o.centroid")).alias("distance"), F.col("spread").alias("spread_a"), F.col("o.spread").alias("spread_b"))


def stability(vectors: DataFrame) -> DataFrame:
    """``model, r, stable``: Pearson correlation of a model's mean vectors under two styles (``style`` 0 and 1)."""
    means = long_form(vectors, "model", "style").groupBy("model", "dim").agg(F.avg(F.when(F.col("style") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("style") == 1, F.col("x"))).alias("b"))
    return means.groupBy("model").agg(F.corr("a", "b").alias("r")).withColumn("stable", F.coalesce(F.col("r") > 0.7, F.lit(False)))


def differentiators(vectors: DataFrame, top: int = 10) -> DataFrame:
    """``dim, variance, rank``: components of largest sample variance of the models' means."""
    got = components(vectors).groupBy("dim").agg(F.var_samp("mean").alias("variance"))
    return got.orderBy(F.desc("variance"), "dim").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "dim")))


def confusion(predictions: DataFrame) -> DataFrame:
    """``tp, fp, fn, tn, accuracy, precision, recall, f1, human_recognition`` of ``is_ai, predicted_ai``."""
    n = lambda c: F.count_if(c)
    y, p = F.col("is_ai"), F.col("predicted_ai")
    out = predictions.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "human_recognition": share(tn, tn + fp)})


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, accuracy, balanced``: of ``is_ai, score`` (score at or above means AI), in one aggregate."""
    y = F.col("is_ai")
    cells = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        cells += [F.count_if(y & hit).alias(f"tp{i}"), F.count_if(~y & ~hit).alias(f"tn{i}")]
    got = scores.agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"), *cells)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), ((F.col(f"tp{i}") + F.col(f"tn{i}")) / (F.col("p") + F.col("n"))).alias("accuracy"), ((F.col(f"tp{i}") / F.col("p") + F.col(f"tn{i}") / F.col("n")) / 2).alias("balanced")) for i, t in enumerate(thresholds)))
    return got.select(F.explode(rows).alias("r")).select("r.*")


# -- sequences ----------------------------------------------------------------


def trajectory(points: DataFrame) -> DataFrame:
    """``path, n, jump_mean, jump_variance, tortuosity, turning`` of ``path, pos, vec`` in order of ``pos``.

    A point and the two behind it (``following``) are all that its steps need.
    Fewer than three points give 0s and a tortuosity of 1.
    """
    after = following(points.select("path", "pos", "vec"), 2)
    steps = after.withColumns({"next": F.get("after", F.lit(0)), "after": F.get("after", F.lit(1))})
    delta = lambda a, b: F.zip_with(b, a, lambda x, y: (x - y).cast("double"))
    steps = steps.withColumns({"s1": delta(F.col("vec"), F.col("next")), "s2": delta(F.col("next"), F.col("after"))})
    steps = steps.withColumns({"jump": F.sqrt(dot(F.col("s1"), F.col("s1"))), "jump2": F.sqrt(dot(F.col("s2"), F.col("s2")))})
    angle = F.acos(T.clamp(dot(F.col("s1"), F.col("s2")) / F.greatest(F.col("jump") * F.col("jump2"), F.lit(1e-12)), -1.0, 1.0))
    got = steps.withColumn("angle", F.when(F.col("after").isNotNull(), angle)).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg("jump").alias("jm"), F.var_pop("jump").alias("jv"), F.sum("jump").alias("length"), F.avg("angle").alias("turn"), F.min_by("vec", "pos").alias("first"), F.max_by("vec", "pos").alias("last"))
    enough = F.col("n") >= 3
    return got.select("path", "n", T.zero_unless(enough, F.col("jm")).alias("jump_mean"), T.zero_unless(enough, F.col("jv")).alias("jump_variance"), F.when(enough, F.col("length") / F.greatest(distance(F.col("first"), F.col("last")), F.lit(0.001))).otherwise(1.0).alias("tortuosity"), T.zero_unless(enough, F.col("turn")).alias("turning"))


def drift(samples: DataFrame, base: str = "first") -> DataFrame:
    """``model, ts, drift, level, change``: distance of each sample mean from the model's ``base``, and jumps of it.

    ``samples`` has ``model, ts, vec``; the base is the first sample, or the
    last one after a reset.  Levels begin at .05, .10, .15 and .25; a change
    of more than .10 from the sample before is a change point.
    """
    chosen = F.min_by if base == "first" else F.max_by
    bases = samples.groupBy("model").agg(chosen("vec", "ts").alias("base"))
    far = samples.join(bases, "model").select(F.col("model").alias("path"), (-F.col("ts")).alias("pos"), "ts", distance(F.col("vec"), F.col("base")).alias("drift"))
    got = following(far, 1, value="drift")
    d = F.col("drift")
    level = F.when(d >= 0.25, "critical").when(d >= 0.15, "high").when(d >= 0.10, "medium").when(d >= 0.05, "low").otherwise("none")
    return got.select(F.col("path").alias("model"), "ts", "drift", level.alias("level"), F.coalesce(F.abs(d - F.get("after", F.lit(0))) > 0.10, F.lit(False)).alias("change"))


def drift_summary(drifts: DataFrame) -> DataFrame:
    """``model, n, max_drift, mean_drift, changes, trend``: increasing if the last drift exceeds the first."""
    got = drifts.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("drift").alias("max_drift"), F.avg("drift").alias("mean_drift"), F.count_if("change").alias("changes"), F.min_by("drift", "ts").alias("a"), F.max_by("drift", "ts").alias("b"))
    return got.select("model", "n", "max_drift", "mean_drift", "changes", F.when(F.col("b") > F.col("a"), "increasing").otherwise("stable").alias("trend"))
