"""Shares and neighbours of part-of-speech tags, from whatever tagger made them: ``tags`` is an array of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T

# What counts as what, and the pairs of tags that are followed.
KINDS = {"noun": ["NOUN", "PROPN"], "verb": ["VERB", "AUX"], "adj": ["ADJ"], "adv": ["ADV"], "prep": ["ADP"], "det": ["DET"], "pron": ["PRON"], "cconj": ["CCONJ"], "sconj": ["SCONJ"]}
RATIOS = {"noun_verb": ("noun", "verb"), "adj_noun": ("adj", "noun"), "adv_verb": ("adv", "verb"), "pron_noun": ("pron", "noun")}
NO_WORDS = ["PUNCT", "SPACE", "SYM"]
PAIRS = {
    "adj_noun": "ADJ NOUN",
    "adv_verb": "ADV VERB",
    "verb_adv": "VERB ADV",
    "adv_adj": "ADV ADJ",
    "det_noun": "DET NOUN",
    "det_adj": "DET ADJ",
    "noun_noun": "NOUN NOUN",
    "noun_verb": "NOUN VERB",
    "verb_noun": "VERB NOUN",
    "aux_verb": "AUX VERB",
    "prep_noun": "ADP NOUN",
    "prep_det": "ADP DET",
    "verb_prep": "VERB ADP",
    "cconj_noun": "CCONJ NOUN",
    "cconj_verb": "CCONJ VERB",
    "cconj_det": "CCONJ DET",
}


def _count(tags: list[str]) -> Column:
    return F.size(F.filter("tags", lambda t: t.isin(tags)))


def tag_features(docs: DataFrame) -> DataFrame:
    """``doc_id, pos_<...>, bigram_<...>`` of ``doc_id, tags``; null and empty tags do not count, no tags give 0s."""
    kept = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    df = docs.select("doc_id", kept.alias("tags"))
    df = df.withColumns({f"k_{k}": _count(v) for k, v in KINDS.items()} | {"n": F.size("tags"), "pairs": F.filter(F.transform("tags", lambda t, i: F.concat_ws(" ", t, F.get(F.col("tags"), i + 1))), lambda p: F.contains(p, F.lit(" ")))})
    df = T.with_counts(df, pair_counts=F.col("pairs"))
    k = lambda name: F.col(f"k_{name}")
    one = lambda c: F.greatest(c, F.lit(1))
    out = {f"pos_{name}_ratio": k(name) / F.col("n") for name in KINDS}
    out |= {f"pos_{name}_ratio": k(a) / one(k(b)) for name, (a, b) in RATIOS.items()}
    out["pos_content_function_ratio"] = (k("noun") + k("verb") + k("adj") + k("adv")) / (k("det") + k("prep") + k("pron") + 1)
    words = one(F.col("n") - _count(NO_WORDS))
    held = lambda pair: F.size(F.filter("pairs", lambda p: p == pair))
    out |= {f"bigram_{name}_rate": held(pair) / words * 100 for name, pair in PAIRS.items()}
    out["bigram_entropy_norm"] = F.when(F.size("pairs") > 1, T.entropy(F.col("pair_counts")) / F.log2(F.size("pairs").cast("double"))).otherwise(0.0)
    return df.select("doc_id", *(T.zero_unless(F.col("n") > 0, v).cast("double").alias(name) for name, v in out.items()))
