"""Readers of corpora in the shapes they come in; all give DataFrames and leave pruning to Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a merged sample and their types; missing ones are null.
MERGED = "sample_id string, seed_id string, domain string, model_id string, model_family string, model_name string, prompt_style string, temperature double, text string, word_count long, char_count long, prompt string, source string, timestamp string"


def texts(spark: SparkSession, path: str, least_chars: int = 0) -> DataFrame:
    """``path, text``: one row a file."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return df.filter(F.length("text") >= least_chars) if least_chars else df


def samples(spark: SparkSession, path: str, schema: str = MERGED) -> DataFrame:
    """Samples of JSON files that hold an array or an object with ``samples``."""
    raw = spark.read.text(path, wholetext=True)
    item = f"array<struct<{_fields(schema)}>>"
    listed = F.from_json("value", item)
    held = F.from_json("value", f"struct<samples:{item}>")["samples"]
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(held)).alias("s")).select("s.*")


def _fields(schema: str) -> str:
    return ",".join(":".join(f.strip().rsplit(" ", 1)) for f in schema.split(","))


def lines(spark: SparkSession, path: str, schema: str = MERGED) -> DataFrame:
    """One JSON object a line, plain or compressed; broken lines give nulls."""
    return spark.read.schema(schema).json(path)


def table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header; ``sep`` is a tab for TSV."""
    return spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"')


def rows_of_xml(spark: SparkSession, path: str, tag: str = "row") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).load(path)


def archive(spark: SparkSession, path: str, first: str, last: str, schema: str) -> DataFrame:
    """JSON lines of archive files whose names hold a month (yyyy-mm) from ``first`` to ``last``.

    Files outside the range are listed but never opened.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    months = {f.getPath().toString(): f.getPath().getName() for f in found}
    chosen = sorted(p for p, n in months.items() if (m := _month(n)) and first <= m <= last)
    return spark.read.schema(schema).json(chosen) if chosen else spark.createDataFrame([], schema)


def _month(name: str) -> str | None:
    m = re.search(r"\d{4}-\d{2}", name)
    return m[0] if m else None


def first_of(*names: str) -> Column:
    """The first field that is there, for corpora whose fields go by several names."""
    return F.coalesce(*(F.col(n) for n in names))
