"""Queries that read feeds page by page, and their SQL.

The tables hold no feeds; Spark writes one from ``documents``, fifty entries a
page in the order of identifiers, an hour from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.sources.paged import register
from lexiprint.sources.shared import fresh_dir

PAGE = 50
START = "2024-01-01 00:00:00"
#: Entries of the first days only.
UNTIL = "2024-01-11 00:00:00"
#: Characters that XML cannot hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def entries(docs: DataFrame) -> DataFrame:
    """``page, id, title, summary, published`` for each document."""
    clean = F.regexp_replace(T.text_of("text"), CONTROL, " ")
    return docs.filter("doc_id >= 0").select(
        F.floor(F.col("doc_id") / PAGE).cast("int").alias("page"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Entry <"), F.col("doc_id").cast("string"), F.lit("> & more")).alias("title"),
        clean.alias("summary"), (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("published"),
    )


def _atom(c: str) -> Column:
    out = F.col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def written(spark: SparkSession, rows: DataFrame, kind: str) -> str:
    """A feed of ``entries``: a page is one task's row of at most ``PAGE`` entries, so rows of equal identifiers make it longer."""
    path = fresh_dir(spark, "feed")
    time = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind == "atom":
        tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
        entry = tag("entry", F.concat(tag("id", F.col("id")), tag("title", _atom("title")), tag("summary", _atom("summary")), tag("published", time)))
        page = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join("entries", ""), F.lit("</feed>"))
    else:
        entry = F.to_json(F.struct("id", "title", "summary", time.alias("published")))
        page = F.concat(F.lit('{"entries": ['), F.array_join("entries", ", "), F.lit("]}"))
    pages = rows.select("page", "published", entry.alias("entry")).groupBy("page").agg(F.collect_list("entry").alias("entries"), F.min("published").alias("first"), F.max("published").alias("last"))
    pages.select("page", page.alias("value")).write.partitionBy("page").text(path)
    spans = rows.groupBy("page").agg(F.min("published").alias("first"), F.max("published").alias("last"))
    spans.select("page", *(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) for c in ("first", "last"))).write.json(f"{path}/index")
    return path


def feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    register(spark)
    return spark.read.format("pagedfeed").option("kind", kind).load(path)


def _read(kind: str, until: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = entries(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        found = feed(spark, written(spark, rows, kind), kind)
        found = found.filter(F.col("published") < F.lit(until).cast("timestamp")) if until else found
        return found.select("id", "title", F.sha2(F.col("summary").cast("binary"), 256).alias("summary_sha256"), "published", "page")

    return run


QUERIES = {"feed_atom": _read("atom"), "feed_json": _read("json"), "feed_first_pages": _read("atom", UNTIL)}
_SQL = rf"""select doc_id::varchar as id, 'Entry <' || doc_id || '> & more' as title, sha256(regexp_replace(coalesce(text, ''), '{CONTROL}', ' ', 'g')) as summary_sha256,
    timestamp '{START}' + to_hours(doc_id::int) as published, (doc_id // {PAGE})::int as page from documents where doc_id >= 0"""
ORACLES = {"feed_atom": _SQL, "feed_json": _SQL, "feed_first_pages": f"select * from ({_SQL}) where published < timestamp '{UNTIL}'"}
