"""Where and how firmly a text commits itself, and how it moves from thought to thought (layers C1 and C2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T

# Markers by category, in the order in which categories claim a place.
HEDGES = {
    "uncertainty": ["perhaps", "maybe", "might", "could", "possibly", "likely", "unlikely", "probably", "presumably", "apparently", "seemingly", "arguably", "conceivably", "potentially", "plausibly"],
    "softening": ["somewhat", "relatively", "fairly", "rather", "quite", "slightly", "moderately", "reasonably", "partially", "largely", "mostly", "generally", "typically", "usually", "often", "sometimes"],
    "attribution": ["seems", "appears", "suggests", "indicates", "implies", "tends", "looks like", "sounds like", "feels like"],
    "perspective": ["i think", "i believe", "in my view", "in my opinion", "i would say", "i suspect", "i imagine", "i suppose", "i assume", "i gather", "one could say", "one might argue", "it could be argued"],
    "qualification": ["to some extent", "in a sense", "in some ways", "to a degree", "up to a point", "more or less", "kind of", "sort of", "in general", "for the most part", "by and large"],
}
CONFIDENCE = {
    "high": ["certainly", "definitely", "absolutely", "clearly", "obviously", "undoubtedly", "unquestionably", "surely", "indeed", "of course", "without doubt", "no doubt", "must", "will", "always", "never", "proven", "established", "demonstrates", "proves", "confirms"],
    "medium": ["should", "would", "can", "does", "is", "are", "shows", "indicates", "suggests", "supports", "evidence", "research shows", "studies show"],
    "low": ["might", "may", "could", "possibly", "perhaps", "maybe", "it's possible", "there's a chance", "potentially"],
}
TRANSITIONS = {
    "additive": ["also", "too", "as well", "in addition", "additionally", "moreover", "furthermore", "besides", "what's more", "not only", "along with", "coupled with", "similarly", "likewise", "in the same way", "equally", "correspondingly", "by the same token"],
    "contrastive": ["however", "but", "yet", "although", "though", "even though", "nevertheless", "nonetheless", "still", "despite", "in spite of", "whereas", "while", "whilst", "on the other hand", "on the contrary", "conversely", "in contrast", "that said", "having said that", "then again", "admittedly", "granted", "of course", "certainly"],
    "causal": ["because", "since", "as", "due to", "owing to", "on account of", "given that", "seeing that", "therefore", "thus", "hence", "so", "consequently", "as a result", "accordingly", "for this reason", "that's why", "which is why"],
    "temporal": ["first", "second", "third", "finally", "lastly", "then", "next", "afterward", "afterwards", "subsequently", "previously", "before", "after", "meanwhile", "simultaneously", "initially", "originally", "eventually", "ultimately", "in the end", "at last"],
    "exemplifying": ["for example", "for instance", "such as", "like", "including", "especially", "particularly", "notably", "specifically", "in particular", "to illustrate", "as an illustration", "e.g.", "i.e.", "in this case", "in that case", "take the case of"],
    "reformulating": ["in other words", "that is", "that is to say", "namely", "specifically", "more precisely", "to put it another way", "put differently", "what i mean is", "essentially", "basically", "in short", "in brief", "in summary", "to summarize", "in conclusion", "to conclude", "overall", "all in all"],
}
BINS = 10


def pattern(phrases: list[str], longest_first: bool = False) -> str:
    """Any of the phrases between word boundaries, for texts without letters beyond ASCII."""
    ordered = sorted(phrases, key=len, reverse=True) if longest_first else phrases
    return r"\b(?:" + "|".join(p.replace(".", r"\.") for p in ordered) + r")\b"


def _code(k: int) -> str:
    """A private character that stands for a marker of the k-th category."""
    return chr(0xE000 + k)


def _positions(text: Column, regex: str) -> Column:
    """Where the matches begin, in characters: the pieces and matches before each are added up."""
    pieces, hits = F.split(text, regex), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda s, z: F.when(z["h"].isNull(), s).otherwise(F.struct((s["at"] + F.length(z["p"]) + F.length(z["h"])).alias("at"), F.concat(s["all"], F.array(s["at"] + F.length(z["p"]))).alias("all")))
    return F.aggregate(F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h"))), start, step, lambda s: s["all"])


PATTERNS = [pattern(v) for sets in (HEDGES, CONFIDENCE, TRANSITIONS) for v in sets.values()]


def _cued(phrases: list[str]) -> Column:
    """Whether a text has a cue of the phrases; texts hold few, so most lists are not looked for."""
    words, parts = T.cues(pattern(phrases))
    return F.arrays_overlap("stance_cues", F.array(*map(F.lit, sorted(words)))) if words and not parts else F.lit(True)


def prepare(df: DataFrame) -> DataFrame:
    df = df.withColumn("stance_cues", F.array_distinct(F.filter("alpha", lambda x: x.isin(sorted(T.cue_words(PATTERNS))))))
    none = F.array().cast("array<int>")
    places = F.concat(*(F.when(_cued(v), _positions(F.col("plain"), T.led(pattern(v)))).otherwise(none) for v in HEDGES.values()))
    df = df.withColumn("hedged", F.transform(places, lambda p: p / F.length("text")))
    df = T.with_counts(df, hedge_bins=F.transform("hedged", lambda p: F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int")))
    lists = {f"cued_{k}": v for k, v in enumerate([*CONFIDENCE.values(), *HEDGES.values()])}
    sure = sorted(set().union(*(T.cues(pattern(v))[0] for v in lists.values())))
    df = df.withColumns({"sure_cues": F.filter("stance_cues", lambda w: w.isin(sure)), **{c: _cued(v) for c, v in lists.items()}})

    def score(s: Column) -> Column:
        high, medium, low, *hedges = (F.when(F.col(c), F.regexp_count(s, F.lit(T.led(pattern(v))))).otherwise(0) for c, v in lists.items())
        parts = F.struct(high.alias("a"), medium.alias("b"), low.alias("c"), T.total(hedges).alias("h"))
        return T.let(parts, lambda x: T.let(x["a"] + x["b"] + x["c"] + x["h"], lambda n: F.when(n > 0, T.clamp((x["a"] + 0.6 * x["b"] + 0.3 * x["c"] - 0.3 * x["h"]) / n, 0.0, 1.0)).otherwise(0.5)))

    # a sentence without any cue of its text is neutral; a text without cues needs no sentences, since an empty series has the neutral mean, spread and arc
    some = lambda s: F.when(F.exists("sure_cues", lambda w: F.contains(s, w)), score(s)).otherwise(0.5)
    sentences = F.array_remove(F.split(T.strip(F.col("plain")), r"(?=\s)(?<=[.!?])\s+"), "")
    df = df.withColumn("confident", F.when(F.size("sure_cues") > 0, F.transform(sentences, some)).otherwise(F.array().cast("array<double>")))
    df = df.withColumn("moved", F.col("plain"))
    for k, phrases in enumerate(TRANSITIONS.values()):
        df = df.withColumn("moved", F.when(_cued(phrases), F.regexp_replace("moved", T.led(pattern(phrases, longest_first=True)), _code(k))).otherwise(F.col("moved")))
    codes = F.regexp_extract_all("moved", F.lit(f"[{_code(0)}-{_code(len(TRANSITIONS) - 1)}]"), F.lit(0))
    df = df.withColumn("moves", F.when(F.octet_length("moved") > F.length("moved"), codes).otherwise(F.array().cast("array<string>")))
    return T.with_counts(df, move_pairs=T.ngrams(F.col("moves"), 2))


def layer_c1() -> dict[str, Column]:
    n, scores = F.size("hedged"), F.col("confident")
    squares = F.aggregate("hedge_bins", F.lit(0.0), lambda s, c: s + c * c.cast("double"))
    index = F.transform(scores, lambda _, i: i.cast("double"))
    neutral = {"hedge_position_bias": 0.5, "confidence_mean": 0.5}
    out = {
        "hedge_density": n / F.col("n_ws") * 100,
        "hedge_clustering": F.when(n >= 2, F.least((BINS * squares / n - n) / (n * (BINS - 1)), F.lit(1.0))).otherwise(0.0),
        "hedge_position_bias": T.mean_of(F.col("hedged"), 0.5),
        "confidence_mean": T.mean_of(scores, 0.5),
        "confidence_variance": T.var_of(scores),
        "confidence_arc": F.when(F.size(scores) >= 3, T.clamp(T.slope(index, scores) * F.size(scores) / 2, -1.0, 1.0)).otherwise(0.0),
    }
    return {k: F.when(F.col("n_ws") >= 5, v).otherwise(neutral.get(k, 0.0)) for k, v in out.items()}


def layer_c2() -> dict[str, Column]:
    n = F.size("moves")
    out = {f"{name}_rate": T.ratio(_count_code(k), n) for k, name in enumerate(TRANSITIONS)}
    out["transition_density"] = n / F.col("n_ws") * 100
    out["flow_entropy"] = T.entropy(F.col("move_pairs"))
    return {k: T.zero_unless(F.col("n_ws") >= 10, v) for k, v in out.items()}


def _count_code(k: int) -> Column:
    code = _code(k)
    return F.size(F.filter("moves", lambda m: m == code))


def dominant(features: DataFrame) -> DataFrame:
    """``doc_id, dominant``: the transition category of the largest rate, the first of equals."""
    names = list(TRANSITIONS)
    rates = F.array(*(F.col(f"{n}_rate") for n in names))
    return features.select("doc_id", F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(rates, F.array_max(rates)).cast("int")).alias("dominant"))
