"""Reports on predictions, profiles and drift: quartiles, classes, pairs, claims, alerts, empty features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.operators import profiles as P

#: Levels of drift from the least to the greatest.
LEVELS = ["none", "low", "medium", "high", "critical"]
#: Claims of more confidence than this stand though another model is nearer.
CLAIM = 0.7
ALTERNATIVES = 5


def quartiles(values: DataFrame, *keys: str) -> DataFrame:
    """``keys, p25, median, p75, iqr`` of ``x``, by linear interpolation; nulls count for nothing."""
    got = values.groupBy(*keys).agg(*(F.percentile("x", F.lit(p)).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))))
    return got.withColumn("iqr", F.col("p75") - F.col("p25"))


def class_report(predictions: DataFrame) -> DataFrame:
    """``model, n, hits, accuracy, precision``: of ``model, predicted``, for each model and, with a null model, for all.

    A model that is never predicted has precision 0; over all, precision is
    accuracy.
    """
    hit = (F.col("model") == F.col("predicted")).cast("long")
    own = predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    said = predictions.groupBy(F.col("predicted").alias("model")).agg(F.count(F.lit(1)).alias("said"))
    each = own.join(said, "model", "left").select("model", "n", "hits", (F.col("hits") / F.col("n")).alias("accuracy"), F.coalesce(F.col("hits") / F.col("said"), F.lit(0.0)).alias("precision"))
    total = own.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter("n is not null")
    share = F.col("hits") / F.col("n")
    return each.unionByName(total.select(F.lit(None).cast("string").alias("model"), "n", "hits", share.alias("accuracy"), share.alias("precision")))


def human_pairs(vectors: DataFrame, profiles: DataFrame, human: str) -> DataFrame:
    """``model, n, accuracy, human_recognition``: people against each model alone, by the nearer of the two centroids.

    ``vectors`` has ``id, model, vec``; a tie goes to the human.
    """
    near = P.distances(vectors, profiles).join(vectors.select("id", "model"), "id")
    far = lambda name: F.get(F.filter("near", lambda x: x["model"] == name), F.lit(0))["distance"]
    # profiles are few, so a human's row becomes a few rows
    mine = near.withColumn("people", far(F.lit(human))).withColumn("other", F.explode(F.filter("near", lambda x: x["model"] != human)))
    pairs = mine.filter((F.col("model") == human) | (F.col("model") == F.col("other.model")))
    is_human, said_human = F.col("model") == human, F.col("people") <= F.col("other.distance")
    return pairs.groupBy(F.col("other.model").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg((is_human == said_human).cast("double")).alias("accuracy"), F.coalesce(F.avg(F.when(is_human, said_human.cast("double"))), F.lit(0.0)).alias("human_recognition"))


def _range_confidence(distance: Column) -> Column:
    """1 for the nearest of ``near`` down to 0 for the farthest; 0.5 where all are equally far."""
    close, far = F.get("near", F.lit(0))["distance"], F.element_at("near", -1)["distance"]
    return F.when(far == close, F.when(F.size("near") > 1, 0.5).otherwise(1.0)).otherwise(F.greatest(1 - (distance - close) / (far - close), F.lit(0.0)))


def alternatives(vectors: DataFrame, profiles: DataFrame, top: int = ALTERNATIVES) -> DataFrame:
    """``id, rank, model, distance, confidence``: the ``top`` nearest models of each vector."""
    near = P.distances(vectors, profiles)
    rows = near.select("id", "near", F.posexplode(F.slice("near", 1, top)).alias("at", "x"))
    return rows.select("id", (F.col("at") + 1).alias("rank"), F.col("x.model").alias("model"), F.col("x.distance").alias("distance"), _range_confidence(F.col("x.distance")).alias("confidence"))


def check_claims(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """``id, claim, found, claim_confidence, verified, alert`` of ``id, claim, vec``.

    A claim is verified if its name and the nearest model's are equal but for
    case or one holds the other, or if its confidence exceeds ``CLAIM``.  An
    unknown claim has confidence 0; the alert is null where a claim stands.
    """
    near = P.distances(vectors, profiles).join(vectors.select("id", "claim"), "id")
    claimed = F.get(F.filter("near", lambda x: x["model"] == F.col("claim")), F.lit(0))["distance"]
    out = near.select("id", "claim", F.get("near", F.lit(0))["model"].alias("found"), F.coalesce(_range_confidence(claimed), F.lit(0.0)).alias("claim_confidence"), claimed.isNull().alias("unknown"))
    out = out.withColumn("claim_confidence", F.when(F.col("unknown"), 0.0).otherwise(F.col("claim_confidence"))).drop("unknown")
    a, b = F.lower("claim"), F.lower("found")
    verified = F.coalesce(F.contains(b, a) | F.contains(a, b), F.lit(False)) | (F.col("claim_confidence") > CLAIM)
    return out.withColumn("verified", verified).withColumn("alert", F.when(~F.col("verified"), F.concat(F.lit("Claimed "), "claim", F.lit(" but fingerprint matches "), "found")))


def alerts(drifts: DataFrame, since: object = None, least: str = "low") -> DataFrame:
    """Rows of ``drifts`` (``model, ts, drift, level``) of at least a level, from a time on, with a message."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    kept = drifts.filter(level > LEVELS.index(least))
    kept = kept if since is None else kept.filter(F.col("ts") >= F.lit(since))
    return kept.select("model", "ts", "drift", "level", F.concat(F.upper("level"), F.lit(" drift of "), "model").alias("message"))


def zero_counts(features: DataFrame, layers: list[str]) -> DataFrame:
    """``doc_id`` and ``<layer>_zeros``: features of each layer (columns ``<layer>_...``) that are 0."""
    names = {x: [c for c in features.columns if c.startswith(f"{x}_")] for x in layers}
    count = lambda cs: sum(((F.col(c) == 0).cast("int") for c in cs), F.lit(0))
    return features.select("doc_id", *(count(cs).cast("int").alias(f"{x}_zeros") for x, cs in names.items()))
