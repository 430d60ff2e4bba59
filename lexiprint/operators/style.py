"""Features of learned politeness, of noise and imperfection, of echoes between sentences, and of tokenizer artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L

#: Words that count as common for the noise features; a caller with a longer list sets its own.
COMMON = sorted({*L.COMMON, *L.FUNCTION_WORDS})


PATTERNS = [*L.HEDGE_PATTERNS, *L.BENEVOLENT_PATTERNS, *L.SYCOPHANCY_PATTERNS, *L.MORALIZING_PATTERNS, *L.NEUTRALITY_PATTERNS, *L.PREMISE_PATTERNS, *L.CONCLUSION_PATTERNS, *L.HUMAN_PATTERNS, *L.TYPO_PATTERNS]


def _hits(plain: Column, patterns: list[str], found: str = "cues") -> Column:
    """Matches in a lower-case text whose letters and digits beyond ASCII are underscores.

    The patterns are ASCII; an underscore is a word character like the letter
    it stands for, so word boundaries are where they were.  ``found`` names the
    cues among the text's words: texts hold few, so most patterns are not looked for.
    """
    return T.matches(plain, patterns, F.col(found))


def prepare_alignment(df: DataFrame) -> DataFrame:
    """Listed words, cues of the patterns, and what several features mention; the text's last quarter may begin inside a word, which then is a cue of its own."""
    df = df.withColumn("listed", F.filter("alpha", lambda x: x.isin(sorted(T.cue_words(PATTERNS).union(L.TELLS_STRONG, L.TELLS_MEDIUM)))))
    df = df.withColumns({"cues": F.array_distinct("listed"), "coda": F.expr("substring(plain, cast(floor(length(text) * 0.75) as int) + 1)")})
    df = df.withColumn("coda_cues", F.array_append("cues", F.regexp_extract("coda", "^[a-z]+", 0)))
    low = F.col("plain")
    return df.withColumns({"moral": _hits(low, L.MORALIZING_PATTERNS), "moral_end": _hits(F.col("coda"), L.MORALIZING_PATTERNS, "coda_cues"), "premise": _hits(low, L.PREMISE_PATTERNS), "conclusion": _hits(low, L.CONCLUSION_PATTERNS)})


def alignment() -> dict[str, Column]:
    low, n, s = F.col("plain"), F.col("n_alpha"), F.col("per_sent")
    moral, moral_end, premise, conclusion = map(F.col, ("moral", "moral_end", "premise", "conclusion"))
    tells = T.among(F.col("listed"), L.TELLS_STRONG) * 2.0 + T.among(F.col("listed"), L.TELLS_MEDIUM) * 0.5
    starts = F.size("first_raw_c") / F.col("n_sents")
    even = 0.5 * F.greatest(F.lit(0.0), 1 - T.cv_of(F.col("sent_len"))) + 0.2 * F.greatest(F.lit(0.0), 1 - 2 * T.cv_of(F.col("alpha_len"))) + 0.3 * (1 - starts)
    flaws = _hits(low, L.HUMAN_PATTERNS) + _hits(low, L.TYPO_PATTERNS)
    out = {
        "benevolence_score": F.least((_hits(low, L.BENEVOLENT_PATTERNS) + 0.3 * _hits(low, L.HEDGE_PATTERNS)) / s, F.lit(2.0)),
        "neutrality_bias": F.least(100 * _hits(low, L.NEUTRALITY_PATTERNS) / n, F.lit(5.0)),
        "moralizing_coda": 0.4 * F.least(moral / s, F.lit(1.0)) + 0.6 * T.ratio(moral_end, moral),
        "syllogism_stability": F.when((premise > 0) & (conclusion > 0), F.least(premise, conclusion) / F.greatest(premise, conclusion) * F.least((premise + conclusion) / s, F.lit(1.0))).otherwise(0.0),
        "sycophancy_index": F.least(_hits(low, L.SYCOPHANCY_PATTERNS) / s, F.lit(2.0)),
        "lexical_tellscore": F.least(100 * tells / n, F.lit(10.0)),
        "uniformity_score": F.when(F.col("n_sents") < 3, 0.5).otherwise(even),
        "imperfection_absence": T.clamp(1 - 100 * flaws / n / 5, 0.0, 1.0),
    }
    return {k: T.zero_unless((F.length("text") >= 50) & (n >= 10), v) for k, v in out.items()}


def composite(features: DataFrame, domain: str = "general") -> DataFrame:
    """``doc_id, score, flagged``: weighted alignment features against the domain's threshold; unknown domains are general."""
    domain = domain if domain in L.ALIGNMENT_WEIGHTS else "general"
    parts = [F.least(F.col(k) / L.ALIGNMENT_NORMS[k], F.lit(1.0)) * w for k, w in L.ALIGNMENT_WEIGHTS[domain].items()]
    score = F.least(T.total(parts), F.lit(1.0))
    return features.select("doc_id", score.alias("score"), (score >= L.ALIGNMENT_THRESHOLDS[domain]).alias("flagged"))


def prepare(df: DataFrame) -> DataFrame:
    """Runs of white space, punctuation and sentence ends, and named and content words."""
    capital = lambda w: F.substring(w, 1, 1)
    names = F.flatten(F.transform(F.filter("sent_words", lambda s: F.size(s) > 1), lambda s: F.transform(F.slice(s, 2, F.size(s)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))))
    names = F.transform(F.filter(names, lambda w: (F.length(w) > 1) & (capital(w) == F.upper(capital(w))) & (capital(w) != F.lower(capital(w)))), F.lower)
    content = F.filter("alpha", lambda w: (F.length(w) >= 4) & ~w.isin(COMMON))
    return T.with_counts(
        df,
        gap_c=F.transform(F.regexp_extract_all("text", F.lit(r"[ \t]+"), F.lit(0)), F.length),
        mark_c=F.regexp_extract_all("text", F.lit(r"[.,;:!?'\"()\[\]{}]+"), F.lit(0)),
        end_c=F.regexp_extract_all("text", F.lit(r"[.!?]+"), F.lit(0)),
        name_c=T.hashes(names),
        content_c=T.hashes(content),
    )


def noise() -> dict[str, Column]:
    n, text = F.col("n_alpha"), F.col("text")
    rare = F.size(F.filter("alpha", lambda w: (F.length(w) > 2) & ~w.isin(COMMON)))
    odd = F.size(F.filter("alpha", lambda w: F.length(w) > 15)) + F.size(F.filter("alpha", lambda w: w.rlike(r"q[^u]|[^aeiou]{5,}|(.)\1{2,}")))
    single, double = F.contains(text, F.lit("'")).cast("int"), F.contains(text, F.lit('"')).cast("int")
    once = lambda c: T.ratio(F.size(F.filter(c, lambda x: x == 1)), F.size(c))
    share = lambda c, top: F.least(T.entropy(F.col(c)) / top, F.lit(1.0))
    out = {
        "idiosyncrasy_rate": 0.7 * rare / n + 0.3 * odd / n,
        "formatting_entropy": 0.3 * share("gap_c", 2.0) + 0.3 * share("mark_c", 3.0) + 0.2 * (single + 2 * double) / 3 + 0.2 * share("end_c", 1.5),
        "dead_end_rate": 0.6 * once("name_c") + 0.4 * once("content_c"),
    }
    return {k: T.zero_unless((F.length("text") >= 100) & (n >= 20), v) for k, v in out.items()}


def tokenization() -> dict[str, Column]:
    """Without a tokenizer three features stand at their neutral 0.5."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?![\p{L}\p{N}_])"), F.lit(0)))
    found = T.total([F.contains("low", F.lit(g.lower())).cast("int") for g in L.GLITCHES])
    out = {"token_fragmentation": F.lit(0.5), "strange_token_split": F.lit(0.5), "whitespace_token_bias": F.lit(0.5), "glitch_token_sensitivity": F.greatest(F.lit(0.0), 1 - 0.2 * found)}
    return {k: T.zero_unless((F.length("text") >= 50) & (words >= 10), v) for k, v in out.items()}


def prepare_echo(df: DataFrame) -> DataFrame:
    """Likeness of neighbouring sentences: of word endings and of lengths."""
    df = df.withColumn("endings", F.transform("sents", lambda s: F.array_distinct(F.transform(F.filter(T.alpha_words(s), lambda w: F.length(w) >= 3), lambda w: F.right(w, F.lit(3))))))
    steps = F.when(F.col("n_sents") > 1, F.sequence(F.lit(0), F.greatest(F.col("n_sents") - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    pair = lambda i: (F.get("endings", i), F.get("endings", i + 1))
    both = F.filter(steps, lambda i: (F.size(pair(i)[0]) > 0) & (F.size(pair(i)[1]) > 0))
    df = df.withColumn("phonetic", F.transform(both, lambda i: F.size(F.array_intersect(*pair(i))) / F.size(F.array_union(*pair(i)))))
    a, b = (lambda i: F.get("sent_len", i)), (lambda i: F.get("sent_len", i + 1))
    df = df.withColumn("lengths", F.transform(steps, lambda i: 1 - F.abs(a(i) - b(i)) / F.greatest(a(i) + b(i), F.lit(1.0))))
    df = df.withColumn("echoes", F.concat("phonetic", "lengths"))
    return df.withColumns({f"{c}_mean": T.mean_of(F.col(c)) for c in ("phonetic", "lengths", "echoes")})


def echo() -> dict[str, Column]:
    """Without sentence vectors the semantic scores take no part."""
    out = {}
    for name, c in (("phonetic", "phonetic"), ("structural", "lengths"), ("overall", "echoes")):
        a, mean = F.col(c), F.col(f"{c}_mean")
        out |= {f"{name}_mean": mean, f"{name}_std": T.std_of(a), f"{name}_max": F.coalesce(F.array_max(a), F.lit(0.0))}
    logs = F.transform("echoes", lambda s: F.log(F.greatest(s, F.lit(1e-8))))
    out["geometric_mean"] = F.when(F.size("echoes") > 0, F.exp(T.mean_of(logs))).otherwise(0.0)
    out["echo_burstiness"] = T.ratio(out["overall_std"], out["overall_mean"])
    return out
