"""Information-theoretic and vocabulary features of the words of a document."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L


@F.pandas_udf(DoubleType())
def gzip_ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Size of the gzipped text over the size of the text; 0 for an empty text."""
    for texts in batches:
        raw = [t.encode("utf-8") for t in texts]
        yield pd.Series([len(gzip.compress(b, 9)) / len(b) if b else 0.0 for b in raw])


@F.pandas_udf(DoubleType())
def zlib_ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Size of the deflated text over the size of the text; 0 for an empty text."""
    for texts in batches:
        raw = [t.encode("utf-8") for t in texts]
        yield pd.Series([len(zlib.compress(b)) / len(b) if b else 0.0 for b in raw])


def with_word_counts(df: DataFrame) -> DataFrame:
    """``wc``: counts of the distinct words."""
    df = T.with_counts(df, wc=T.hashes(F.col("alpha")))
    return df.withColumns({"V": F.size("wc"), "N": F.col("n_alpha"), "n1": F.size(F.filter("wc", lambda c: c == 1)), "n2": F.size(F.filter("wc", lambda c: c == 2))})


def prepare(df: DataFrame) -> DataFrame:
    df = with_word_counts(df).withColumn("places", F.sort_array(F.transform("alpha", lambda w, i: F.struct(F.xxhash64(w).alias("w"), i.alias("i")))))
    df = T.with_counts(df, cc=F.transform(F.array_remove(F.split("low", ""), ""), F.ascii), bc=T.ngram_hashes(F.col("alpha"), 2), tc=T.ngram_hashes(F.col("alpha"), 3))
    gap = lambda i: F.when(F.get("places", i)["w"] == F.get("places", i - 1)["w"], F.get("places", i)["i"] - F.get("places", i - 1)["i"])
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.col("N") - 1, F.lit(1))), gap), lambda g: g.isNotNull())
    df = df.withColumns({"gaps": F.when(F.col("N") > 1, gaps).otherwise(F.array().cast("array<int>")), "top": F.slice(F.sort_array("wc", asc=False), 1, 100), "h_word": T.entropy(F.col("wc"))})
    return df.withColumns({"ln_rank": F.transform("top", lambda _, i: F.log((i + 1).cast("double"))), "ln_freq": F.transform("top", lambda c: F.log(c.cast("double")))})


def features() -> dict[str, Column]:
    N, V, n1, n2 = (F.col(c).cast("double") for c in ("N", "V", "n1", "n2"))
    h = F.col("h_word")
    tri = F.greatest(F.col("N") - 2, F.lit(1))
    squares = F.aggregate("wc", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    out = {
        "entropy_char": T.entropy(F.col("cc")),
        "entropy_word": h,
        "entropy_bigram": T.entropy(F.col("bc")),
        "perplexity_approx": F.when(h > 0, F.pow(F.lit(2.0), h)).otherwise(0.0),
        "redundancy_rate": F.when(V > 1, 1 - h / F.log2(V)).otherwise(0.0),
        "repetition_rate": F.size(F.filter("tc", lambda c: c > 1)) / tri,
        "burstiness_words": T.cv_of(F.col("gaps")),
        "zipf_coefficient": F.when(V >= 10, F.abs(T.slope(F.col("ln_rank"), F.col("ln_freq")))).otherwise(0.0),
        "yule_k": 10000 * (squares - N) / (N * N),
        "simpson_d": F.when(N > 1, (squares - N) / (N * (N - 1))).otherwise(0.0),
        "honore_r": F.when((n1 > 0) & (n1 < V), 100 * F.log(N) / (1 - n1 / V)).otherwise(0.0),
        "sichel_s": n2 / V,
        "brunet_w": F.pow(N, F.pow(V, F.lit(-0.165))),
    }
    return {k: T.zero_unless(F.col("n_alpha") >= 10, v) for k, v in out.items()}


def compression() -> dict[str, Column]:
    """The one feature of the group that no built-in function gives; an Arrow UDF."""
    return {"compression_ratio": T.zero_unless(F.col("n_alpha") >= 10, gzip_ratio("text"))}


ABSTRACT = "(tion|ness|ity|ism|ment|ence|ance)$"


def syllables(word: Column) -> Column:
    """Vowel groups, less one for a final e, plus one for a consonant before a final le, one at least."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    # n is not below 0, since a final e is in a group; mentioned once, as each mention counts the groups again
    n = groups - word.endswith("e").cast("int") + (word.endswith("le") & word.rlike("[^aeiouy]le$")).cast("int")
    return F.when(word.isNotNull(), F.greatest(n, F.lit(1)))


def lexical() -> dict[str, Column]:
    N, V, n1, n2 = (F.col(c).cast("double") for c in ("N", "V", "n1", "n2"))
    mean = F.col("len_mean")
    share = lambda test: F.size(F.filter("alpha", test)) / N
    long, abstract = share(lambda w: F.length(w) > 6), share(lambda w: w.rlike(ABSTRACT))
    out = {
        "type_token_ratio": V / N,
        "hapax_legomena_ratio": n1 / N,
        "dis_legomena_ratio": n2 / N,
        "avg_word_length": mean,
        "word_length_std": T.std_of(F.col("alpha_len")),
        "word_length_cv": T.cv_of(F.col("alpha_len")),
        "syllable_ratio": T.sum_of(F.transform("alpha", syllables)) / N,
        "long_word_ratio": long,
        "rare_word_ratio": 1 - T.among(F.col("alpha"), L.COMMON) / N,
        "concrete_ratio": 1 - abstract,
        "abstract_ratio": abstract,
        "formality_score": 0.3 * (mean / 10) + 0.3 * long + 0.4 * abstract,
    }
    return {k: T.zero_unless(F.col("n_alpha") >= 10, v) for k, v in out.items()}
