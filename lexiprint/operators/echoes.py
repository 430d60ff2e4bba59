"""Echoes between neighbouring clauses: pairs, zones, scores and a verdict, without a parser.

Clauses end at sentence marks, commas, semicolons, colons and dashes. Every
word that is no function word is a content word; its sound is its spelling in
capitals, as for words that no pronunciation dictionary has. The semantic score
is taken from word vectors where these are given; without them, and where a
zone has none, it stands at its neutral 0.5.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L
from lexiprint.operators.sequences import dot
from lexiprint.operators.statistical import syllables

ZONE = 3
WEIGHTS = (0.33, 0.33, 0.34)
STRONG = [";", ":", "—"]
#: Neighbouring rows in a block that asks for vectors, as a power of two, and rows whose words' vectors are laid out at once.
BLOCK_BITS, AT_ONCE = 14, 1024


def clauses(docs: DataFrame) -> DataFrame:
    """``doc_id, clauses``: array of ``words, content, strong`` (whether a strong mark ends the clause); one-word clauses are left out."""
    df = docs.select("doc_id", T.text_of("text").alias("text")).withColumn("cut", F.split("text", r"(?<=[.!?,;:—])"))
    one = lambda c: F.struct(T.alpha_words(c).alias("words"), F.right(c, F.lit(1)).isin(STRONG).alias("strong"))
    df = df.withColumn("parts", F.filter(F.transform("cut", one), lambda c: F.size(c["words"]) >= 2))
    full = lambda c: F.struct(c["words"].alias("words"), F.filter(c["words"], lambda w: ~w.isin(L.FUNCTION_WORDS)).alias("content"), c["strong"].alias("strong"))
    return df.select("doc_id", F.transform("parts", full).alias("clauses"))


def pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, pair, kind, zone_a, zone_b`` of neighbouring clauses.

    The kind is punctuation if a strong mark stands between, else conjunction
    if and, but or or is in either clause, else transition if the second begins
    with however, therefore or thus; other neighbours are no pair.
    """
    n = F.size("clauses")
    # of each clause only what its pairs need, and neighbours in one array: an exploded index would copy all clauses of the document into each row
    last = lambda c: F.slice(c, F.greatest(F.size(c) - ZONE, F.lit(0)) + 1, F.lit(ZONE))
    joins = lambda c: F.exists(c["words"], lambda w: w.isin("and", "but", "or"))
    opens = lambda c: F.get(c["words"], F.lit(0)).isin("however", "therefore", "thus")
    small = F.transform("clauses", lambda c: F.struct(c["strong"].alias("strong"), joins(c).alias("joins"), opens(c).alias("opens"), last(c["content"]).alias("last"), F.slice(c["content"], 1, ZONE).alias("first")))
    neighbours = F.when(n > 1, F.zip_with(F.slice("clauses", F.lit(1), n - 1), F.slice("clauses", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    df = clauses(docs).select("doc_id", small.alias("clauses")).select("doc_id", F.posexplode(neighbours).alias("pair", "x"))
    kind = F.when(F.col("x.a.strong"), "punctuation").when(F.col("x.a.joins") | F.col("x.b.joins"), "conjunction").when(F.col("x.b.opens"), "transition")
    return df.select("doc_id", "pair", kind.alias("kind"), F.col("x.a.last").alias("zone_a"), F.col("x.b.first").alias("zone_b")).filter("kind is not null")


def _zone_words(rows: pa.Table) -> pa.Table:
    """The distinct words of a block's zones."""
    words = pc.unique(pa.concat_arrays([pc.list_flatten(rows[f"zone_{k}"].combine_chunks()) for k in "ab"])).drop_null()
    return pa.table({"_block": pa.array(np.full(len(words), rows["_block"][0].as_py()), pa.int64()), "word": words})


def _means(zone: pa.Array, words: pa.Array, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which zones hold words that have vectors, and the means of these zones."""
    at = pc.index_in(pc.list_flatten(zone), value_set=words, skip_nulls=True)
    row = pc.list_parent_indices(zone).to_numpy().astype(np.int64)[at.is_valid().to_numpy(zero_copy_only=False)]
    at = at.drop_null().to_numpy()
    counts = np.bincount(row, minlength=len(zone))
    has = counts > 0
    n = counts[has]
    starts = np.cumsum(n) - n
    means = np.empty((len(n), matrix.shape[1]))
    for i in range(0, len(n), AT_ONCE):
        some = starts[i : i + AT_ONCE]
        means[i : i + AT_ONCE] = np.add.reduceat(matrix[at[some[0] : some[-1] + n[i : i + AT_ONCE][-1]]], some - some[0])
    return has, means / n[:, None]


def _sides(rows: pa.Table, found: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    words, vecs = found["word"].combine_chunks(), found["vec"].combine_chunks()
    matrix = pc.list_flatten(vecs).to_numpy(zero_copy_only=False).reshape(len(vecs), -1) if len(vecs) else np.empty((0, 0))
    return {k: _means(rows[f"zone_{k}"].combine_chunks(), words, matrix) for k in "ab"}


def _zone_means(rows: pa.Table, found: pa.Table) -> pa.Table:
    """A block's rows without their block, and the mean vectors of their zones."""
    kept = rows.drop_columns("_block")
    for k, (has, means) in _sides(rows, found).items():
        ends = np.append(0, np.cumsum(has * means.shape[1])).astype(np.int32)
        kept = kept.append_column(f"vec_{k}", pa.ListArray.from_arrays(pa.array(ends), pa.array(means.ravel(), pa.float64()), mask=pa.array(~has)))
    return kept


def _zone_likeness(rows: pa.Table, found: pa.Table) -> pa.Table:
    """A block's rows without their block, and ``likeness`` of the mean vectors of their zones."""
    (has_a, a), (has_b, b) = _sides(rows, found).values()
    both = has_a & has_b
    a, b = a[both[has_a]], b[both[has_b]]
    size = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    out = np.full(rows.num_rows, 0.5)
    out[np.flatnonzero(both)[size > 0]] = np.clip((1 + (a * b).sum(1)[size > 0] / size[size > 0]) / 2, 0.0, 1.0)
    return rows.drop_columns("_block").append_column("meaning", pa.array(out))


def _asking(pair_rows: DataFrame, vectors: DataFrame, key: Callable[[Column], Column] | None, run, more: list[StructField]) -> DataFrame:
    """``run`` on each block of neighbouring rows and the vectors of its words, for which it asks once each."""
    # both uses read this exchange
    dealt = pair_rows.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)).repartition("_block").groupBy("_block")
    asked = dealt.applyInArrow(_zone_words, "_block long, word string")
    by = "key" if key else "word"
    given = (asked.withColumn("key", key(F.col("word"))) if key else asked).join(vectors.select(by, F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null"), by)
    return dealt.cogroup(given.select("_block", "word", "vec").groupBy("_block")).applyInArrow(run, StructType([*pair_rows.schema.fields, *more]))


def zone_vectors(pair_rows: DataFrame, vectors: DataFrame, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pair_rows`` with ``vec_a, vec_b``: the means of the zones' word vectors (``word, vec``), null where no word has one.

    With ``key`` a word's vector is the one whose column ``key`` equals
    ``key(word)``.  Vectors travel by block of rows and word, not by
    occurrence; repeated words count each time, and vectors have one length.
    """
    return _asking(pair_rows, vectors, key, _zone_means, [StructField(f"vec_{k}", ArrayType(DoubleType())) for k in "ab"])


def meanings(pair_rows: DataFrame, vectors: DataFrame, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pair_rows`` with ``meaning``: the ``likeness`` of the vectors that ``zone_vectors`` gives, which stay where they are worked out."""
    return _asking(pair_rows, vectors, key, _zone_likeness, [StructField("meaning", DoubleType())])


def likeness(a: Column, b: Column) -> Column:
    """Cosine on a scale from 0 to 1; 0.5 where a vector is missing or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, T.clamp((1 + dot(a, b) / size) / 2, 0.0, 1.0)), F.lit(0.5))


def scored(pair_rows: DataFrame) -> DataFrame:
    """``doc_id, pair, kind, phonetic, structural, semantic, combined``; the semantic score by ``meaning`` or else ``vec_a, vec_b`` if the rows have them."""
    # columns of their own: inside the scores each mention would work them out again
    sounds = lambda z: F.transform(z, lambda w: F.struct(F.upper(w).alias("w"), F.length(w).alias("n")))
    beats = lambda z: F.coalesce(T.sum_of(F.transform(z, syllables)), F.lit(0.0))
    pair_rows = pair_rows.withColumns({f"_{part}_{k}": of(f"zone_{k}") for part, of in (("sounds", sounds), ("beats", beats)) for k in "ab"})
    like = lambda x, y: 1 - F.levenshtein(x["w"], y["w"]) / F.greatest(x["n"], y["n"])
    best = F.transform("_sounds_a", lambda x: F.array_max(F.transform("_sounds_b", lambda y: like(x, y))))
    sound = T.mean_of(F.filter(best, lambda s: s > 0))
    a, b = F.col("_beats_a"), F.col("_beats_b")
    shape = 0.5 * (F.size("zone_a") == F.size("zone_b")).cast("int") + 0.5 * F.when(F.greatest(a, b) > 0, 1 - F.abs(a - b) / F.greatest(a, b)).otherwise(0.0)
    empty = (F.size("zone_a") == 0) | (F.size("zone_b") == 0)
    zero = lambda c: F.when(empty, 0.0).otherwise(c)
    by_vectors = likeness(F.col("vec_a"), F.col("vec_b")) if {"vec_a", "vec_b"} <= set(pair_rows.columns) else F.lit(0.5)
    meaning = F.col("meaning") if "meaning" in pair_rows.columns else by_vectors
    out = pair_rows.select("doc_id", "pair", "kind", zero(sound).alias("phonetic"), zero(shape).alias("structural"), zero(meaning).alias("semantic"))
    return out.withColumn("combined", combined(F.col("phonetic"), F.col("structural"), F.col("semantic")))


def combined(*scores: Column) -> Column:
    """Weighted sum within 0 and 1; a score that is not a number counts 0."""
    return T.clamp(T.total([F.coalesce(F.nanvl(s, F.lit(0.0)), F.lit(0.0)) * w for s, w in zip(scores, WEIGHTS)]), 0.0, 1.0)


def document_scores(pair_scores: DataFrame, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """``doc_id, pairs, score, median, low, high, sd, z, verdict`` against the mean and deviation of human scores."""
    got = pair_scores.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.avg("combined").alias("score"), F.percentile("combined", F.lit(0.5)).alias("median"), F.min("combined").alias("low"), F.max("combined").alias("high"), F.coalesce(F.stddev_samp("combined"), F.lit(0.0)).alias("sd"))
    z = (F.col("score") - mean) / sd
    verdict = F.when(z > 3, "very high").when(z > 2, "high").when(z > 1, "moderate").otherwise("low")
    return got.withColumn("z", z).withColumn("verdict", verdict)


def kinds(pair_rows: DataFrame) -> DataFrame:
    """``doc_id, punctuation, conjunction, transition``: shares of the kinds of pairs."""
    share = lambda k: (F.count_if(F.col("kind") == k) / F.count(F.lit(1))).alias(k)
    return pair_rows.groupBy("doc_id").agg(share("punctuation"), share("conjunction"), share("transition"))
