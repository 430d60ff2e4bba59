"""Writers of corpora, fingerprints and audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(df: DataFrame, path: str) -> None:
    """Flat columns as Parquet with snappy."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def flattened(df: DataFrame, column: str) -> DataFrame:
    """Fields of a struct as columns ``<column>_<field>`` in its place."""
    fields = [F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in df.schema[column].dataType.names]
    return df.select(*(c for c in df.columns if c != column), *fields)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprints(df: DataFrame, path: str) -> None:
    """Appended, a folder for each model, so that reading one model opens its files only."""
    df.write.mode("append").partitionBy("model").parquet(path)


def audit(df: DataFrame, path: str, action: str) -> None:
    """One appended record for each row's model: what was done, to how many, and when."""
    df.groupBy("model").agg(F.count(F.lit(1)).alias("rows")).select("model", "rows", F.lit(action).alias("action"), F.current_timestamp().alias("at")).write.mode("append").json(path)
