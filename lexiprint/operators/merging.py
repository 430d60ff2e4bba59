"""Corpora of unlike schema made one: fields by name and type, exact duplicates with their origin, counts in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators.naming import merged_name

# Fields of a merged sample, the names they go by, their types and what stands for a missing one.
FIELDS = {
    "sample_id": (["sample_id"], "string", None),
    "seed_id": (["seed_id"], "string", "unknown"),
    "domain": (["domain"], "string", "unknown"),
    "model_id": (["model_id", "model"], "string", "unknown"),
    "model_family": (["model_family"], "string", None),
    "model_name": (["model_name"], "string", None),
    "prompt_style": (["prompt_style"], "string", "neutral"),
    "temperature": (["temperature"], "double", 0.7),
    "text": (["text"], "string", ""),
    "word_count": (["word_count"], "long", None),
    "timestamp": (["timestamp"], "string", None),
}
#: Fields that samples are counted by, each on its own.
COUNTED = ["model_name", "model_family", "domain", "prompt_style"]


def _field(df: DataFrame, names: list[str], kind: str, other) -> Column:
    """The first of ``names`` that is there and not null, as ``kind``; what cannot be read as that is missing."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`").cast("string").try_cast(kind) for n in names if n in have]
    if kind == "string":
        found = [F.when(c != "", c) for c in found] if other is not None else found
    return F.coalesce(*found, F.lit(other).cast(kind))


def sample(df: DataFrame, source: str, place: int = 0) -> DataFrame:
    """``df`` in the merged schema, with ``char_count``, ``sentence_count``, ``source`` and its ``place`` among the sources."""
    out = df.select(*(_field(df, names, kind, other).alias(f) for f, (names, kind, other) in FIELDS.items()))
    name = merged_name(F.col("model_id"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return out.withColumns({
        "sample_id": F.coalesce(F.when(F.col("sample_id") != "", F.col("sample_id")), F.concat(F.lit("sample_"), F.substring(digest, 1, 12))),
        "model_family": F.coalesce("model_family", name["family"]), "model_name": F.coalesce("model_name", name["name"]),
        "word_count": F.coalesce("word_count", F.size(T.ws_words(F.col("text"))).cast("long")),
        "char_count": F.length("text").cast("long"), "sentence_count": F.size(T.sentences(F.col("text"))).cast("long"),
        "source": F.lit(source), "place": F.lit(place),
    })


def merge(sources: dict[str, DataFrame], deduplicate: bool = True) -> DataFrame:
    """One sample of each text of all ``sources``, with ``sources``: the names of those that hold it, and ``copies`` in all.

    Fields are found by name in any case and read by type; missing ones get
    their defaults.  Of equal texts the sample of the first source stays, and in
    it that of the least ``sample_id``; of samples equal in both it is the one of
    least values.  Null texts are ''.  Texts are told apart by their SHA-256.
    """
    rows = reduce(DataFrame.unionByName, (sample(df, name, i) for i, (name, df) in enumerate(sources.items())))
    if not deduplicate:
        return rows.drop("place").withColumns({"sources": F.array("source"), "copies": F.lit(1).cast("long")})
    keyed = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    first = F.min(F.struct("place", "sample_id", *(c for c in rows.columns if c not in ("place", "sample_id")))).alias("x")
    # partial minima and at most one name a source travel, so a text that stands everywhere is no burden
    each = keyed.groupBy("digest").agg(first, F.sort_array(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("copies"))
    return each.select(*(f"x.{c}" for c in rows.columns if c != "place"), "sources", "copies")


def statistics(merged: DataFrame) -> DataFrame:
    """``kind, value, samples, copies, words``: of all samples, by each of ``COUNTED`` and by source, in one pass of grouping sets.

    A sample counts for the source it was taken from; ``copies`` counts all rows that were merged into the samples.
    """
    keys = [*COUNTED, "source"]
    got = merged.groupingSets([[], *([F.col(k)] for k in keys)], *(F.col(k) for k in keys)).agg(F.count(F.lit(1)).alias("samples"), F.sum("copies").alias("copies"), F.sum("word_count").alias("words"), *(F.grouping(k).alias(f"_{k}") for k in keys))
    kind = F.coalesce(*(F.when(F.col(f"_{k}") == 0, k) for k in keys), F.lit("all"))
    return got.select(kind.alias("kind"), F.coalesce(*(F.when(F.col(f"_{k}") == 0, F.col(k)) for k in keys)).alias("value"), "samples", "copies", "words")
