"""Classification in tiers: each tier's features are worked out only for rows that the tiers before left unsure."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T

#: Certainty from which the first two tiers are believed.
FIRST, SECOND = 0.85, 0.70


class Tier(NamedTuple):
    """``score`` adds a column ``ai``, a probability, to the rows it is given; ``sure`` is the certainty from which it is believed."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    sure: float


def cascade(docs: DataFrame, tiers: list[Tier]) -> DataFrame:
    """``doc_id, tier, ai, label``: the answer of the first tier that is sure of a row, or else of the last.

    Rows that a tier is sure of leave before the next tier's features, so these
    stand above a filter in the plan, and a costly tier costs in proportion to
    what is left.  A score that is null is not sure; the last tier's answer
    then is null.  Every row comes back once.
    """
    left, out = docs, []
    for n, tier in enumerate(tiers):
        scored = tier.score(left)
        certain = F.coalesce(F.greatest("ai", 1 - F.col("ai")) >= tier.sure, F.lit(False))
        done = scored if n + 1 == len(tiers) else scored.filter(certain)
        out.append(done.select("doc_id", F.lit(tier.name).alias("tier"), "ai"))
        left = scored.filter(~certain).select(*(F.col(f"`{c}`") for c in docs.columns))
    return reduce(DataFrame.union, out).withColumn("label", F.when(F.col("ai") >= 0.5, "ai").when(F.col("ai") < 0.5, "human"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def text_tiers() -> list[Tier]:
    """By commas, which a scan of the characters tells; by the share of distinct words; by clauses' lengths and the words' together."""
    text = T.text_of("text")

    def commas(df: DataFrame) -> DataFrame:
        per_hundred = T.count_of(text, ",") * 100 / F.greatest(F.length(text), F.lit(1))
        return df.withColumn("ai", logistic((per_hundred - 1.2) * 4))

    def variety(df: DataFrame) -> DataFrame:
        words = T.ws_words(F.lower(text))
        return df.withColumn("_w", words).withColumn("ai", logistic((0.6 - F.size(F.array_distinct("_w")) / F.greatest(F.size("_w"), F.lit(1))) * 5)).drop("_w")

    def shapes(df: DataFrame) -> DataFrame:
        sizes = F.transform(T.pieces(text, "[,;.!?]+"), lambda p: F.size(T.ws_words(p)).cast("double"))
        long_words = F.size(F.filter(T.ws_words(text), lambda w: F.length(w) > 8)) / F.greatest(F.size(T.ws_words(text)), F.lit(1))
        return df.withColumn("_s", sizes).withColumn("ai", logistic((0.7 - T.cv_of(F.col("_s"))) * 3 + (long_words - 0.15) * 5)).drop("_s")

    return [Tier("commas", commas, FIRST), Tier("variety", variety, SECOND), Tier("shapes", shapes, 0.0)]
