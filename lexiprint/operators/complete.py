"""The complete extractor's variants: no guards, and other denominators and marks than the registry's groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L
from lexiprint.operators import stance, structure
from lexiprint.operators.statistical import syllables

# Fixed values.
COORDINATORS = "and but or nor for yet so".split()
SUBORDINATORS = ["because", "although", "while", "if", "when", "unless", "since", "before", "after", "whereas", "though", "until", "whenever", "wherever", "whether", "as if", "even though", "so that"]
HEDGES = ["maybe", "perhaps", "possibly", "probably", "might", "could", "may", "seemingly", "apparently", "somewhat", "rather", "quite", "fairly", "kind of", "sort of", "a bit", "a little", "to some extent", "it seems", "it appears", "i think", "i believe", "i suppose", "in my opinion", "arguably", "presumably", "allegedly"]
TRANSITIONS = {
    "additive": ["moreover", "furthermore", "additionally", "also", "besides", "in addition"],
    "contrastive": ["however", "nevertheless", "nonetheless", "although", "though", "yet", "but"],
    "causal": ["therefore", "thus", "hence", "consequently", "because", "since", "as a result"],
    "temporal": ["then", "next", "afterward", "meanwhile", "subsequently", "finally", "later"],
    "exemplifying": ["for example", "for instance", "such as", "specifically", "namely"],
    "reformulating": ["in other words", "that is", "i.e.", "namely", "to put it differently"],
}
ABSTRACT = r"(?:tion|ness|ity|ism|ment)$"
MARKS = r"[.!?,;:\-()\[\]\"'…—]"


def prepare(df: DataFrame) -> DataFrame:
    clauses = F.transform(T.pieces(F.col("text"), "[,;]"), lambda c: F.size(T.ws_words(c)).cast("double"))
    last = F.transform("sent_words", lambda w: F.xxhash64(F.lower(F.element_at(w, -1))))
    return T.with_counts(df.withColumn("c_clauses", clauses), c_last=last, c_first=T.hashes(F.col("first_raw")), c_marks=F.regexp_extract_all("text", F.lit(MARKS), F.lit(0)))


def _of(*parts: str) -> Column:
    return T.total([T.count_of(F.col("text"), p) for p in parts])


def _words(phrases: list[str]) -> Column:
    """Single words among the word runs; phrases, and words with marks, between word boundaries of the plain text."""
    many = [rf"\b{p.replace('.', '[.]')}\b" for p in phrases if not p.isalpha()]
    return T.among(F.col("word_runs"), [p for p in phrases if p.isalpha()]) + T.matches(F.col("plain"), many)


def punctuation() -> dict[str, Column]:
    s, w = F.col("per_sent"), F.greatest(F.col("n_ws"), F.lit(1))
    return {
        "question_rate": _of("?") / s,
        "exclamation_rate": _of("!") / s,
        "em_dash_rate": _of("—", "--", " - ") / w,
        "semicolon_rate": _of(";") / s,
        "colon_rate": _of(":") / s,
        "parenthetical_rate": _of("(", ")") / 2 / s,
        "ellipsis_rate": _of("...", "…") / s,
        "entropy": T.entropy(F.col("c_marks")),
    }


def structural() -> dict[str, Column]:
    """The registry's formulas without their guard, words at the ends of sentences as they stand."""
    free = structure.structural_free()
    free["sentence_initial_entropy"], free["sentence_final_entropy"] = T.entropy(F.col("c_first")), T.entropy(F.col("c_last"))
    free["paragraph_count_norm"] = F.size("paras") / (F.greatest(F.col("n_ws"), F.lit(1)) / 1000)
    return free


def connectors() -> dict[str, Column]:
    s = F.col("per_sent")
    coord, sub = _words(COORDINATORS), _words(SUBORDINATORS)
    out = {"coord_subord_ratio": coord / F.greatest(sub, F.lit(1)), "and_but_ratio": _words(["and"]) / F.greatest(_words(["but"]), F.lit(1)), "coord_conj_rate": coord / s, "subord_conj_rate": sub / s}
    return out | {f"{w}_rate": _words([w]) / s for w in ("however", "therefore", "moreover", "furthermore")}


def rhythm() -> dict[str, Column]:
    c, s = F.col("c_clauses"), F.col("per_sent")
    return {
        "clause_length_mean": T.mean_of(c),
        "clause_length_std": T.std_of(c),
        "autocorr": T.autocorr(c),
        "sentence_complexity": F.size(c) / s,
        "comma_density": _of(",") / (F.greatest(F.col("n_ws"), F.lit(1)) / 100),
        "semicolon_rate": _of(";") / s,
        "parenthetical_rate": _of("(", ")") / 2 / s,
    }


def lexical() -> dict[str, Column]:
    """The registry's formulas without their guard, with five endings of abstract words and a constant formality."""
    n = F.col("N").cast("double")
    share = lambda test: F.size(F.filter("alpha", test)) / n
    abstract = share(lambda w: w.rlike(ABSTRACT))
    out = {
        "type_token_ratio": F.col("V") / n,
        "hapax_legomena_ratio": F.col("n1") / n,
        "dis_legomena_ratio": F.col("n2") / n,
        "avg_word_length": F.col("len_mean"),
        "word_length_std": T.std_of(F.col("alpha_len")),
        "word_length_cv": T.cv_of(F.col("alpha_len")),
        "syllable_ratio": T.sum_of(F.transform("alpha", syllables)) / n,
        "long_word_ratio": share(lambda w: F.length(w) > 6),
        "rare_word_ratio": 1 - T.among(F.col("alpha"), L.COMMON) / n,
        "abstract_ratio": abstract,
        "concrete_ratio": 1 - abstract,
        "formality_score": F.lit(0.5),
    }
    return {k: T.zero_unless(F.col("n_alpha") > 0, v) for k, v in out.items()}


def prepare_epistemic(df: DataFrame) -> DataFrame:
    """Places of hedges, as shares of the text; no two of them can overlap, so one pattern finds all."""
    places = stance._positions(F.col("plain"), T.led(stance.pattern(HEDGES)))
    return df.withColumn("c_hedged", F.array_sort(F.transform(places, lambda p: p / F.length("text"))))


def epistemic() -> dict[str, Column]:
    """Hedges a sentence, the Gini coefficient and mean of their places, and confidence as their absence."""
    h = F.col("c_hedged")
    n, all_places = F.size(h), T.sum_of(F.col("c_hedged"))
    weighted = T.sum_of(F.transform(h, lambda p, i: p * (i + 1)))
    density = n / F.col("per_sent")
    return {
        "hedge_density": density,
        "hedge_clustering": F.when((n > 1) & (all_places > 0), 2 * weighted / (n * all_places) - (n + 1) / n).otherwise(0.0),
        "hedge_position_bias": T.mean_of(h),
        "confidence_mean": 1 - F.least(density, F.lit(1.0)),
        "confidence_variance": F.lit(0.0),
        "confidence_arc": F.lit(0.0),
    }


def transitions() -> dict[str, Column]:
    """Words and phrases of each category a sentence, whether or not another category claims them too."""
    return {f"{name}_rate": _words(phrases) / F.col("per_sent") for name, phrases in TRANSITIONS.items()}
