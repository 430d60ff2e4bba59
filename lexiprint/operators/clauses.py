"""Clauses, their pairs and features, from given parses.

``tokens`` is an array as in ``operators.tokens``.  No row leaves its place:
subtree extents come from doubling pointers to the governing tokens, log2(m)
rounds for a sentence of m tokens, over all sentences of an Arrow batch at
once.  A token's governor lies in its own sentence; one that does not counts as
a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lexiprint.functions import text as T

# Relations that open a clause with their kinds, marks that part clauses, and words that pair them.
ANCHORS = {"ROOT": "main", "conj": "coordinate", "advcl": "subordinate", "ccomp": "subordinate"}
ORDER = {"main": 0, "coordinate": 1, "subordinate": 2}
STRONG = [";", ":", "—"]
MARKS = [";", ":", "—", ",", ".", "?", "!"]
PAIR_MARKS = [";", ":", "—", "–", "--"]
CONJUNCTIONS = ["but", "and", "or"]
TRANSITIONS = ["However", "Therefore", "Thus"]
CONTENT = ["NOUN", "PROPN", "VERB", "ADJ", "ADV"]
ZONE = 3


@F.arrow_udf(ArrayType(StructType([StructField("low", IntegerType()), StructField("high", IntegerType())])))
def extents(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The first and last place of what each token governs, itself included, by the governors' places and the sentences' first places, all in the document."""
    for heads, borders in batches:
        n = heads.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(n) - n
        place = np.arange(n.sum())
        up = heads.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(first, n)
        starts = borders.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(first, borders.value_lengths().to_numpy(zero_copy_only=False))
        size = np.diff(np.append(starts, len(place)))
        low = np.repeat(starts, size)
        up = np.where((up >= low) & (up < low + np.repeat(size, size)), up, place)
        low, high = place.copy(), place.copy()
        for _ in range(int(np.ceil(np.log2(max(size.max(initial=2), 2))))):
            least, most = low.copy(), high.copy()
            np.minimum.at(least, up, low)
            np.maximum.at(most, up, high)
            low, high, up = least, most, up[up]
        back = np.repeat(first, n)
        spans = pa.StructArray.from_arrays([pa.array(x - back, pa.int32()) for x in (low, high)], names=["low", "high"])
        yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), spans)


@F.arrow_udf(ArrayType(LongType()))
def depths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Steps from each token to its root, by the governors' places; one outside the array, or null, is a root's."""
    for heads in batches:
        n = heads.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        place, first = np.arange(n.sum()), np.repeat(ends - n, n)
        up = heads.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        up = np.where((up >= 0) & (up < np.repeat(n, n)), up + first, place)
        d = (up != place).astype(np.int64)
        # as many rounds as the text's own length takes, so that a ring of governors ends alike in any batch
        rounds = np.repeat(np.ceil(np.log2(np.maximum(n, 2))), n)
        for k in range(int(rounds.max(initial=0))):
            more = np.where(rounds > k, d[up], 0)
            if not more.any():
                break
            d, up = d + more, np.where(rounds > k, up[up], up)
        yield pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(d, pa.int64()), mask=heads.is_null() if heads.null_count else None)


def _stretch(first: Column, last: Column) -> Column:
    """The tokens from ``first`` to ``last``; picked by place, as a slice would walk over the whole array."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.get("tokens", i)))


def _holds(first: Column, last: Column, test) -> Column:
    """Whether a token from ``first`` to ``last`` passes ``test``."""
    return F.coalesce(F.when(last >= first, F.exists(F.sequence(first, last), lambda i: test(F.get("tokens", i)["text"]))), F.lit(False))


def _sentence_clauses(s: Column) -> Column:
    """Clauses of one sentence, an array of tokens with their places ``i``, in order and cut so that none overlaps the next."""
    base = F.get(s, F.lit(0))["i"]
    kind = lambda dep: F.coalesce(*(F.when(dep == d, k) for d, k in ANCHORS.items()))
    order = lambda dep: F.coalesce(*(F.when(dep == d, ORDER[k]) for d, k in ANCHORS.items()))
    hung = F.transform(F.filter(s, lambda t: (t["dep"] == "punct") & t["text"].isin(PAIR_MARKS)), lambda t: t["head"])
    # only a sentence's few openers become clauses
    openers = F.filter(s, lambda t: t["dep"].isin(list(ANCHORS)))
    found = F.sort_array(F.transform(openers, lambda t: F.struct((t["low"] - base).alias("start"), order(t["dep"]).alias("order"), (t["i"] - base).alias("head"), (t["high"] - base).alias("end"), kind(t["dep"]).alias("kind"))))

    def parted(c):
        """Where the clause before and the one after are cut, if both overlap."""

        def between(a, b):
            first, last = b["start"], F.least(a["end"], b["end"])
            at = lambda marks: F.get(F.filter(F.sequence(first, last), lambda i: F.get(s, i)["text"].isin(marks)), F.lit(0))
            mark = F.coalesce(at(STRONG), at(MARKS))
            middle = F.floor((first + last) / 2).cast("int")
            return F.when(a["end"] >= b["start"], F.struct(F.coalesce(mark - 1, middle).alias("end"), F.coalesce(mark + 1, middle + 1).alias("start")))

        return F.transform(c, lambda b, k: F.when(k > 0, between(F.get(c, k - 1), b)))

    def trimmed(c, cuts, hung):
        starts = F.zip_with(c, cuts, lambda x, cut: F.when(cut["start"] <= x["end"], cut["start"]).otherwise(x["start"]))
        ended = lambda starts: F.transform(
            c,
            lambda x, k: F.struct(
                (base + F.get(starts, k)).cast("int").alias("start"),
                (base + F.when(F.get(cuts, k + 1)["end"] >= F.get(starts, k), F.get(cuts, k + 1)["end"]).otherwise(x["end"])).cast("int").alias("end"),
                (base + x["head"]).cast("int").alias("head"), x["kind"].alias("kind"), F.array_contains(hung, base + x["head"]).alias("marked"),
            ),
        )
        return T.let(starts, ended)

    return T.let(found, lambda c: T.let(hung, lambda h: T.let(parted(c), lambda cuts: trimmed(c, cuts, h))))


def with_clauses(docs: DataFrame) -> DataFrame:
    """``doc_id, tokens, clauses``: clauses as ``start, end, head, kind, marked`` by place in the document, both ends inclusive.

    A clause is opened by a root, a coordinated or a subordinate token and
    spans what that governs.  Of two neighbours that overlap, the first strong
    mark in the overlap, else the first mark, else its middle parts them; a cut
    that would empty a clause is left out.  ``marked``: a strong mark hangs on
    the head.  No tokens give no clauses.
    """
    kept = F.coalesce("tokens", F.array().cast(docs.schema["tokens"].dataType))
    df = docs.select("doc_id", kept.alias("tokens"))
    df = df.withColumns({"sents": F.transform("tokens", lambda t: t["sent"]), "heads": F.transform("tokens", lambda t: F.coalesce(t["head"], F.lit(-1)).cast("int"))})
    n = F.size("tokens")
    borders = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | ~F.get("sents", i).eqNullSafe(F.get("sents", i - 1)))
    df = df.withColumn("borders", F.when(n > 0, borders).otherwise(F.array().cast("array<int>"))).withColumn("spans", extents("heads", "borders"))
    placed = F.zip_with("tokens", "spans", lambda t, x: F.struct(*(t[c].alias(c) for c in ("text", "pos", "dep", "head", "sent")), x["low"].alias("low"), x["high"].alias("high")))
    df = df.withColumn("tokens", F.transform(placed, lambda t, i: F.struct(i.alias("i"), *(t[c].alias(c) for c in ("text", "pos", "dep", "head", "sent", "low", "high")))))
    parts = F.transform("borders", lambda a, k: _stretch(a, F.coalesce(F.get("borders", k + 1), F.size("tokens")) - 1))
    return df.withColumn("parts", parts).select("doc_id", "tokens", F.size("borders").alias("sentences"), F.flatten(F.transform("parts", _sentence_clauses)).alias("clauses"))


def clauses(docs: DataFrame) -> DataFrame:
    """``doc_id, clause, start, end, head, kind, words``: a row for each clause, by ``clause`` in the document."""
    # the words are picked before rows are made, or each row would carry the document
    named = F.transform("clauses", lambda c: F.struct(*(c[k].alias(k) for k in ("start", "end", "head", "kind")), F.transform(_stretch(c["start"], c["end"]), lambda t: t["text"]).alias("words")))
    rows = with_clauses(docs).select("doc_id", F.posexplode(named).alias("clause", "c"))
    return rows.select("doc_id", "clause", "c.*")


def _pairs(df: DataFrame) -> DataFrame:
    """``df`` of ``with_clauses`` and ``pairs``: those that a rule joins, each once under its first rule."""
    pair = lambda a, b, kind, rule: F.struct(a["start"].alias("a_start"), a["end"].alias("a_end"), b["start"].alias("b_start"), b["end"].alias("b_end"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"))
    none = F.lit(None)

    def by_head(x, k):
        """Neighbours by their heads with a strong mark between these or on either."""
        y = F.get("by_head", k + 1)["c"]
        x = x["c"]
        between = x["marked"] | y["marked"] | _holds(x["head"] + 1, y["head"] - 1, lambda w: w.isin(PAIR_MARKS))
        return F.when(between, F.when(x["start"] > y["start"], pair(y, x, "punctuation", 1)).otherwise(pair(x, y, "punctuation", 1)))

    def joined(x, k):
        y = F.get("clauses", k + 1)
        joins = lambda first, last: _holds(first, last, lambda w: F.lower(w).isin(CONJUNCTIONS))
        return F.when(joins(x["start"], x["end"]) | joins(y["start"], y["end"]) | joins(x["end"] + 1, y["start"] - 1), pair(x, y, "conjunction", 2)).otherwise(none)

    def turned(x, k):
        y = F.get("clauses", k + 1)
        first, second = (F.get("tokens", y["start"] + i)["text"] for i in (0, 1))
        opens = (y["end"] > y["start"]) & (first.isin([f"{w}," for w in TRANSITIONS]) | (first.isin(TRANSITIONS) & (second == ",")))
        return F.when(opens, pair(x, y, "transition", 3)).otherwise(none)

    df = df.withColumn("by_head", F.sort_array(F.transform("clauses", lambda c: F.struct(c["head"].alias("h"), c.alias("c")))))
    ahead = lambda array, rule: F.filter(F.transform(F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0))), rule), lambda p: p.isNotNull())
    df = df.withColumn("all_pairs", F.sort_array(F.concat(ahead("by_head", by_head), ahead("clauses", joined), ahead("clauses", turned))))
    same = lambda x, y: (x["a_start"] == y["a_start"]) & (x["a_end"] == y["a_end"]) & (x["b_start"] == y["b_start"]) & (x["b_end"] == y["b_end"])
    return df.withColumn("pairs", F.filter("all_pairs", lambda p, k: (k == 0) | ~same(F.get("all_pairs", k - 1), p))).drop("by_head", "all_pairs")


def pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, a_start, a_end, b_start, b_end, kind, zone_a, zone_b``: joined clauses and the content words on both sides of the joint.

    Neighbours by their heads are joined by a strong mark between the heads or
    on one; neighbours by place by and, but or or in either or between; or if
    the second begins with However, Therefore or Thus and a comma.  A pair that
    several rules join has the kind of the first.
    """
    content = lambda a, b: F.transform(F.filter(_stretch(a, b), lambda t: t["pos"].isin(CONTENT)), lambda t: t["text"])
    last = lambda z: F.slice(z, F.greatest(F.size(z) - ZONE, F.lit(0)) + 1, F.lit(ZONE))
    keys = ("a_start", "a_end", "b_start", "b_end", "kind")
    # the words are picked before rows are made, or each row would carry the document
    zoned = F.transform("pairs", lambda p: F.struct(*(p[k].alias(k) for k in keys), T.let(content(p["a_start"], p["a_end"]), last).alias("zone_a"), F.slice(content(p["b_start"], p["b_end"]), 1, ZONE).alias("zone_b")))
    rows = _pairs(with_clauses(docs)).select("doc_id", F.explode(zoned).alias("p"))
    return rows.select("doc_id", *(f"p.{k}" for k in (*keys, "zone_a", "zone_b")))


def structure(docs: DataFrame) -> DataFrame:
    """``doc_id, clause_<...>, pair_<...>``: kinds and lengths of clauses, shares of the kinds of pairs and their number a sentence."""
    df = _pairs(with_clauses(docs)).withColumn("lengths", F.transform("clauses", lambda c: (c["end"] - c["start"] + 1).cast("double")))
    n, p = F.size("clauses"), F.size("pairs")
    of = lambda kind: F.size(F.filter("clauses", lambda c: c["kind"] == kind))
    joint = lambda kind: F.size(F.filter("pairs", lambda x: x["kind"] == kind))
    one = F.greatest("sentences", F.lit(1))
    kinds = ("punctuation", "conjunction", "transition")
    out = {
        "clause_count": n,
        "clause_main_ratio": of("main") / F.greatest(n, F.lit(1)),
        "clause_subordinate_ratio": of("subordinate") / F.greatest(n, F.lit(1)),
        "clause_main_subordinate_ratio": of("main") / (of("subordinate") + 1),
        "clause_length_mean": T.mean_of(F.col("lengths")),
        "clause_length_std": T.std_of(F.col("lengths")),
        "clause_length_cv": T.cv_of(F.col("lengths")),
        "clause_length_max": F.coalesce(F.array_max("lengths"), F.lit(0.0)),
        "clause_length_min": F.coalesce(F.array_min("lengths"), F.lit(0.0)),
    }
    out |= {f"pair_{k}_rate": joint(k) / F.greatest(p, F.lit(1)) for k in kinds}
    out |= {"pairs_per_sentence": p / one} | {f"{k}_pairs_per_sentence": joint(k) / one for k in kinds}
    return df.select("doc_id", *(v.cast("double").alias(k) for k, v in out.items()))
