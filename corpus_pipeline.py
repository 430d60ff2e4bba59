"""From raw documents to token shards: the pipeline's stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiprint.llm import decontaminate, mixing, nearcopies, sstable, toxicity
from lexiprint.llm.common import fresh_dir, remove_dir


#: Bytes of the encoder's cache, of which a worker keeps two, and of text encoded at once.
ENCODER_BYTES, ENCODED_BYTES = 32 << 20, 4 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxic for their language go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles of similarity 0.8, stays."""
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that expected domain totals match the targets; none goes."""
    return mixing.mix(docs, _table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture, and the digest read back from them; with little memory, as the stages before have filled the heap."""
    return sstable.token_shards(docs, cache=ENCODER_BYTES, at_once=ENCODED_BYTES)


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("token_output", token_output)]

#: Training and tokenizing have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again, and goes when the next is written.

    The last stage writes its shards before it returns; they stay.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    result = STAGES[-1][1](spark, docs, sf_dir)
    if before:
        remove_dir(spark, before)
    return result
