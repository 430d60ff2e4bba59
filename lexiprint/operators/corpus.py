"""Corpus preparation: derived fields, validation, deduplication, quotas, splits, cleaning and conversation samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.functions import text as T

#: Hash buckets by which ranks in a group of any size are counted.
BUCKETS = 4096


def content_hash(text: Column) -> Column:
    """First 16 digits of the SHA-256 of the lower-case words joined by spaces."""
    return F.substring(F.sha2(F.array_join(T.ws_words(F.lower(text)), " "), 256), 1, 16)


def pseudonym(author: Column) -> Column:
    return F.substring(F.sha2(author.cast("string"), 256), 1, 12)


def repetition(words: Column) -> Column:
    """Share of word trigrams that repeat an earlier one; 0 below three words.  ``words`` must be a column."""
    grams = T.ngram_hashes(words, 3)
    return F.when(F.size(words) >= 3, 1 - F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)


def derived(docs: DataFrame) -> DataFrame:
    """``doc_id, words, ends, chars, content_hash, repetition``; null texts are empty."""
    df = docs.select("doc_id", T.text_of("text").alias("text")).withColumn("w", T.ws_words(F.lower("text")))
    return df.select("doc_id", F.size("w").cast("long").alias("words"), F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("ends"), F.length("text").cast("long").alias("chars"), content_hash(F.col("text")).alias("content_hash"), repetition(F.col("w")).alias("repetition"))


def validate(docs: DataFrame, least_chars: int = 100, most_chars: int = 50_000, least_words: int = 20, most_repetition: float = 0.3) -> DataFrame:
    """``doc_id, reason``: why a document is turned down, the first that holds, or null."""
    d = derived(docs)
    reason = F.when(F.col("chars") < least_chars, "short").when(F.col("chars") > most_chars, "long").when(F.col("words") < least_words, "few words").when(F.col("repetition") > most_repetition, "repetitive")
    return d.select("doc_id", reason.alias("reason"))


def first_of_each(docs: DataFrame, key: Column) -> DataFrame:
    """One row of each key, that of the least doc_id, null last, and of several such rows the one of least hash.

    Partial minima, then a semi join on key, identifier and hash, so no group
    meets in a task; rows equal in all columns count once.  A null key is a key.
    """
    keyed = docs.withColumns({"_key": key, "_hash": F.xxhash64(*(F.col(c).cast("string") for c in docs.columns))})
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash")
    kept = keyed.groupBy("_key").agg(F.min(row).alias("r")).select(F.col("_key").alias("_k"), F.col("r.doc_id").alias("_id"), F.col("r._hash").alias("_h"))
    same = keyed["_key"].eqNullSafe(F.col("_k")) & keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_hash"] == F.col("_h"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_key", "_hash"]).select(*docs.columns)


def exact_dedup(docs: DataFrame) -> DataFrame:
    return first_of_each(docs, content_hash(T.text_of("text")))


def quota(docs: DataFrame, group: str, most: int) -> DataFrame:
    """The ``most`` least identifiers of each group; rows beyond are cut before the shuffle."""
    w = Window.partitionBy(group).orderBy("doc_id")
    return docs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def ranked(docs: DataFrame, group: str) -> DataFrame:
    """``docs`` with ``rank`` (from 0) and ``size`` in the group, in the order of the MD5 of ``doc_id``.

    Ranks are counted in buckets of the hash, and the rows of earlier buckets
    from one row a bucket, so no task sorts a whole group.
    """
    hashed = docs.withColumn("_h", F.md5(F.col("doc_id").cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_k"), F.expr(f"sum(_c) over (partition by {group} order by _b) - _c").alias("_before"), F.expr(f"sum(_c) over (partition by {group})").alias("size"))
    inner = hashed.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", "doc_id")))
    joined = inner.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_k")))
    return joined.withColumn("rank", F.col("_before") + F.col("_n") - 1).drop("_h", "_b", "_g", "_k", "_before", "_n")


def split(docs: DataFrame, group: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """``docs`` with ``split``: shares of each group, cut down to whole rows, in a hashed order; the rest is test."""
    r = ranked(docs, group)
    cut = F.floor(F.col("size") * train)
    return r.withColumn("split", F.when(F.col("rank") < cut, "train").when(F.col("rank") < cut + F.floor(F.col("size") * val), "val").otherwise("test")).drop("rank", "size")


def counts_by(docs: DataFrame, *keys: str) -> DataFrame:
    """``kind, value, n``: counts by each key on its own, in one pass of grouping sets."""
    got = docs.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(k).alias(f"_{k}") for k in keys))
    held = lambda k: F.col(f"_{k}") == 0
    return got.select(F.coalesce(*(F.when(held(k), k) for k in keys)).alias("kind"), F.coalesce(*(F.when(held(k), F.col(k).cast("string")) for k in keys)).alias("value"), "n")


def answers(conversations: DataFrame, least: int = 50, most: int = 2000) -> DataFrame:
    """``conv_id, prompt, answer, last_answer, words``: first user turn and first and last assistant turns of fitting length."""
    role = lambda r: F.when(F.col("role") == r, F.col("turn"))
    got = conversations.groupBy("conv_id").agg(F.min_by("text", role("user")).alias("prompt"), F.min_by("text", role("assistant")).alias("answer"), F.max_by("text", role("assistant")).alias("last_answer"))
    return got.filter(F.length("answer").between(least, most)).withColumn("words", F.size(T.ws_words(F.col("answer"))).cast("long"))


# Patterns of the cleaners, applied in this order.
MARKDOWN = [(r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^>.*$", ""), (r"&gt;", ">"), (r"&lt;", "<"), (r"&amp;", "&"), (r"\n{3,}", "\n\n")]
BBCODE = [(r"(?is)\[quote[^\]]*\].*?\[/quote\]", ""), (r"\[/?[a-zA-Z*][^\]]*\]", "")]
HTML = [(r"(?is)<(?:script|style)\b.*?</(?:script|style)>", ""), (r"(?is)<(?:pre|code)\b.*?</(?:pre|code)>", "[CODE]"), (r"<[^>]+>", " ")]


def cleaned(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return T.strip(text)


def expand(samples: DataFrame) -> DataFrame:
    """``sample_id, author, is_human, text`` of ``sample_id, human, ai_variants`` (a map): the human text and every variant."""
    both = F.concat(F.array(F.struct(F.lit("human").alias("author"), F.lit(True).alias("is_human"), F.col("human").alias("text"))), F.transform(F.map_entries("ai_variants"), lambda e: F.struct(e["key"].alias("author"), F.lit(False).alias("is_human"), e["value"].alias("text"))))
    return samples.select("sample_id", F.explode(both).alias("r")).select("sample_id", "r.*").filter("text is not null")


def parsed_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyy")) -> Column:
    """Date by the first format that fits, or null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))
