"""Trained classifiers and unsupervised views over feature columns, by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.operators import profiles as P

SEED = 42
#: Confidence from which a tier's answer stands.
FIRST, SECOND = 0.75, 0.85


def forest(train: DataFrame, columns: list[str], label: str, trees: int = 100) -> PipelineModel:
    """Scaled features and a random forest; ``label`` is 0 or 1."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), RandomForestClassifier(featuresCol="_scaled", labelCol=label, numTrees=trees, seed=SEED)]
    return Pipeline(stages=stages).fit(train)


def probability(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep..., ai``: probability of label 1."""
    return model.transform(df).select(*keep, F.get(vector_to_array("probability"), F.lit(1)).alias("ai"))


def importances(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """``df`` with ``fold`` by a hash of the key, so a row stays in its fold however the input is split."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(k)).cast("int"))


def cross_validated(df: DataFrame, columns: list[str], label: str, key: str, k: int = 5, trees: int = 20) -> DataFrame:
    """``key, label, ai, fold``: each row scored by the forest of the other folds."""
    parts, out = folds(df, key, k), None
    for i in range(k):
        got = probability(forest(parts.filter(F.col("fold") != i), columns, label, trees), parts.filter(F.col("fold") == i), [key, label, "fold"])
        out = got if out is None else out.unionByName(got)
    return out


def tiered(light: DataFrame, medium: PipelineModel | None, deep: PipelineModel | None, features: DataFrame) -> DataFrame:
    """``doc_id, ai, tier``: the light answer where it is sure, else the second tier's, else the third's.

    ``light`` has ``doc_id, human, ai``; later tiers see only the rows that are
    left, and a tier that is not fitted leaves the answer as it is.
    """
    answer = light.select("doc_id", "ai", F.lit(1).alias("tier"))
    for model, least, tier in ((medium, FIRST, 2), (deep, SECOND, 3)):
        if model is None:
            continue
        sure = answer.filter(F.greatest("ai", 1 - F.col("ai")) >= least)
        open_rows = answer.filter(F.greatest("ai", 1 - F.col("ai")) < least).select("doc_id")
        answer = sure.unionByName(probability(model, features.join(open_rows, "doc_id"), ["doc_id"]).withColumn("tier", F.lit(tier)))
    return answer


def clusters(vectors: DataFrame, k: int) -> DataFrame:
    """``id, cluster`` by k-means of ``id, vec``."""
    df = vectors.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=SEED).fit(df).transform(df).select("id", F.col("prediction").alias("cluster"))


def projected(vectors: DataFrame, dims: int = 2) -> DataFrame:
    """``id, point``: principal components of ``id, vec``."""
    df = vectors.select("id", array_to_vector("vec").alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="p").fit(df).transform(df).select("id", vector_to_array("p").alias("point"))


def coverage(vectors: DataFrame, profiles: DataFrame, top: int = 3) -> DataFrame:
    """``model, id, cosine, rank``: the vectors most like each centroid, cut to ``top`` before the shuffle."""
    row = P._profile_row(profiles)
    near = vectors.select("id", "vec").crossJoin(row).select("id", F.explode(F.transform("profiles", lambda p: F.struct(p["model"].alias("model"), P.cosine(F.col("vec"), p["centroid"]).alias("cosine")))).alias("n"))
    w = Window.partitionBy("model").orderBy(F.desc("cosine"), "id")
    return near.select("id", "n.*").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
