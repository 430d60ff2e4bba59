"""Features of the layered fingerprints: light structure (E), echo fallback (B), clause rhythm (D), second version (V), micro features (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T

from lexiprint.operators.statistical import gzip_ratio, with_word_counts

# Means of human and machine text by which the light features are judged, and the features' weights.
REFERENCE = {
    "sentence_length_cv": (0.72, 0.45, 1.47),
    "paragraph_length_cv": (0.65, 0.38, 1.10),
    "type_token_ratio": (0.68, 0.56, 1.07),
    "compression_ratio": (0.42, 0.35, 0.99),
    "list_marker_rate": (0.002, 0.025, 0.93),
    "hapax_legomena_ratio": (0.52, 0.43, 0.75),
    "sentence_initial_entropy": (3.8, 3.2, 0.72),
    "avg_word_length": (4.8, 5.2, 0.68),
    "punctuation_diversity": (0.72, 0.58, 0.65),
    "question_ratio": (0.08, 0.04, 0.54),
}
MARKS = ".,;:!?-'\"()[]{}"
V_FUNCTION_WORDS = "the of and to a in that is was for on with as it be at by this from or".split()
V_MARKS = r"[.,;:!?\-()\[\]\"'…—–]"
#: What parts clauses in a ``flat`` text; it begins with its letters, so that most places are given up at once.
CLAUSE_CUT = r"(?i)[ —–](?:(?<=[,;:] )|(?<= )[—–] ?|(?<= )(?:but|and|or|yet|so|because|although|while|if|when|since|unless) |(?<=[—–]) ?)"


def _lines(titles: str) -> Column:
    """The ``flat`` text with a line for each sentence, ended by a mark and white space; a full stop after a title ends none."""
    return F.regexp_replace("flat", rf" (?<=[.!?] )(?<!(?<![\p{{L}}\p{{N}}_])(?:{titles})\. )", "\n")


def prepare_e(df: DataFrame) -> DataFrame:
    df = with_word_counts(df)
    words = F.transform(F.split(_lines("Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Jr|Sr|vs"), "\n"), T.flat_words)
    df = df.withColumns({"e_sents": F.filter(words, lambda w: F.size(w) > 0), "e_paras": F.transform(T.pieces(F.col("text"), r"\n(?:\s*\n|\n+)"), lambda p: F.size(T.ws_words(p)))})
    df = df.withColumns({"e_len": F.transform("e_sents", lambda w: F.size(w)), "e_first": F.transform("e_sents", lambda w: F.lower(F.replace(F.get(w, F.lit(0)), F.lit("\x01"), F.lit("."))))})
    return T.with_counts(df, e_first_c=T.hashes(F.col("e_first")))


def _distinct_of(marks: str) -> Column:
    return T.total([F.contains("text", F.lit(m)).cast("int") for m in marks])


def layer_e() -> dict[str, Column]:
    n, s, V = F.col("n_alpha"), F.size("e_sents"), F.col("V")
    out = {
        "sentence_length_cv": T.cv_of(F.col("e_len")),
        "paragraph_length_cv": T.cv_of(F.col("e_paras")),
        "type_token_ratio": T.ratio(V, n),
        "list_marker_rate": F.regexp_count("text", F.lit(r"(?m)^(?:[\s]*[-*•]\s|\s*\d+\.\s)")) / F.size(F.split("text", "\n")),
        "hapax_legomena_ratio": T.ratio(F.col("n1"), V),
        "sentence_initial_entropy": T.entropy(F.col("e_first_c")),
        "avg_word_length": F.col("len_mean"),
        "punctuation_diversity": _distinct_of(MARKS) / len(MARKS),
        "question_ratio": T.count_of(F.col("text"), "?") / s,
    }
    return {k: T.zero_unless(s >= 2, v) for k, v in out.items()}


def layer_e_compression() -> dict[str, Column]:
    return {"compression_ratio": T.zero_unless(F.size("e_sents") >= 2, gzip_ratio("text"))}


def _place(name: str, h: float, a: float) -> Column:
    """How far a feature lies from the human mean to the machine's; their distance is the decimal one, so values on a threshold are on it."""
    return (F.col(name) - h) / round(a - h, 9)


def classify_light(features: DataFrame) -> DataFrame:
    """``doc_id, human, ai, label, confidence`` of the light features (``layer_e`` with compression).

    Where a feature stands between its two means gives a weighted signal to
    one side; the label is human only if its share is the larger.
    """
    human = ai = F.lit(0.0)
    for name, (h, a, weight) in REFERENCE.items():
        position = T.clamp(_place(name, h, a), -1.0, 2.0)
        human = human + F.when(position < 0.5, weight * (0.5 - position) * 2).otherwise(0.0)
        ai = ai + F.when(position >= 0.5, weight * (position - 0.5) * 2).otherwise(0.0)
    out = features.select("doc_id", human.alias("h"), ai.alias("a"))
    share = lambda c: F.when(F.col("h") + F.col("a") > 0, F.col(c) / (F.col("h") + F.col("a"))).otherwise(0.5)
    out = out.select("doc_id", share("h").alias("human"), share("a").alias("ai"))
    return out.withColumns({"label": F.when(F.col("human") > F.col("ai"), "human").otherwise("ai"), "confidence": F.greatest("human", "ai")})


def signals(features: DataFrame) -> DataFrame:
    """``doc_id, feature, value, signal``: human below .3 of the way between the means, ai above .7, else neutral."""
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("value"), _place(k, h, a).alias("p")) for k, (h, a, _) in REFERENCE.items() if k in features.columns))
    out = features.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    return out.select("doc_id", "feature", "value", F.when(F.col("p") < 0.3, "human").when(F.col("p") > 0.7, "ai").otherwise("neutral").alias("signal"))


def _beats(word: Column) -> Column:
    return F.greatest(F.regexp_count(F.lower(word), F.lit("[aeiou]+")), F.lit(1))


def prepare_b(df: DataFrame) -> DataFrame:
    """Scores of neighbouring sentences: beats at the seam, lengths, shared words."""
    df = df.withColumns({"b_end": F.transform("sent_words", lambda w: _beats(F.element_at(w, -1)).cast("double")), "b_start": F.transform("sent_words", lambda w: _beats(F.get(w, F.lit(0))).cast("double")), "b_set": F.transform("sent_words", lambda w: F.array_distinct(F.transform(w, F.lower)))})
    steps = F.when(F.col("n_sents") > 1, F.sequence(F.lit(0), F.greatest(F.col("n_sents") - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    at = lambda c, i: F.get(c, i)
    beat = lambda i: 1 - F.abs(at("b_end", i) - at("b_start", i + 1)) / F.greatest(at("b_end", i), at("b_start", i + 1))
    length = lambda i: F.least(at("sent_len", i), at("sent_len", i + 1)) / F.greatest(at("sent_len", i), at("sent_len", i + 1))
    shared = lambda i: T.let(F.size(F.array_intersect(at("b_set", i), at("b_set", i + 1))), lambda n: n / (F.size(at("b_set", i)) + F.size(at("b_set", i + 1)) - n))
    df = df.withColumns({"b_phonetic": F.transform(steps, beat), "b_structural": F.transform(steps, length), "b_semantic": F.transform(steps, shared)})
    df = df.withColumn("b_all", F.transform(F.arrays_zip("b_phonetic", "b_structural", "b_semantic"), lambda z: F.struct(((z["b_phonetic"] + z["b_structural"] + z["b_semantic"]) / 3).alias("mean"), F.pow(F.greatest(z["b_phonetic"] * z["b_structural"] * z["b_semantic"], F.lit(0.001)), F.lit(1 / 3)).alias("geo"))))
    return df.withColumn("b_mean", F.transform("b_all", lambda z: z["mean"]))


def layer_b() -> dict[str, Column]:
    out = {}
    for name, c in (("phonetic", "b_phonetic"), ("structural", "b_structural"), ("semantic", "b_semantic"), ("overall", "b_mean")):
        out |= {f"{name}_mean": T.mean_of(F.col(c)), f"{name}_std": T.std_of(F.col(c)), f"{name}_max": F.coalesce(F.array_max(c), F.lit(0.0))}
    out["geometric_mean"] = T.mean_of(F.transform("b_all", lambda z: z["geo"]))
    out["cooccurrence_rate"] = F.lit(0.0)
    out["burstiness"] = T.cv_of(F.col("b_mean"))
    return {k: T.zero_unless(F.col("n_sents") >= 2, v) for k, v in out.items()}


def prepare_d(df: DataFrame) -> DataFrame:
    # what parts two clauses stands between carriage returns, of which a flat text has none
    df = df.withColumn("d_sents", F.array_remove(F.split(F.regexp_replace(_lines(r"Mr|Mrs|Ms|Dr|Prof|Sr|Jr|e\.g|i\.e|etc"), CLAUSE_CUT, "\r$0\r"), "\n"), ""))
    cut = lambda s: F.filter(F.transform(F.split(s, "\r"), lambda c, i: F.when(i % 2 == 0, F.size(T.flat_words(c)))), lambda n: n >= 2)
    whole = lambda s: F.array(F.size(T.flat_words(F.replace(s, F.lit("\r"), F.lit("")))))
    return df.withColumn("d_clauses", F.flatten(F.transform("d_sents", lambda s: T.let(cut(s), lambda c: F.when(F.size(c) > 0, c).otherwise(whole(s))))))


def layer_d() -> dict[str, Column]:
    c, s = F.col("d_clauses"), F.greatest(F.size("d_sents"), F.lit(1))
    out = {
        "clause_length_mean": T.mean_of(c),
        "clause_length_std": T.std_of(c),
        "clause_rhythm_autocorr": T.autocorr(c, plain=True),
        "sentence_complexity": F.size(c) / s,
        "comma_density": T.count_of(F.col("text"), ",") / F.col("n_ws") * 100,
        "semicolon_rate": T.count_of(F.col("text"), ";") / s,
        "parenthetical_rate": T.total([T.count_of(F.col("text"), p) for p in ("(", "—", "–")]) / s,
    }
    return {k: T.zero_unless((F.col("n_ws") >= 10) & (F.size(c) > 0), v) for k, v in out.items()}


def prepare_v(df: DataFrame) -> DataFrame:
    df = with_word_counts(df)
    df = T.with_counts(df, v_first_c=F.transform("sent_words", lambda w: F.xxhash64(F.lower(F.get(w, F.lit(0))))), v_marks_c=F.regexp_extract_all("text", F.lit(V_MARKS), F.lit(0)))
    lines = F.transform(T.pieces(F.col("text"), "\n"), lambda p: F.size(T.ws_words(p)).cast("double"))
    return df.withColumns({"v_paras": F.when(F.size("para_len") < 2, lines).otherwise(F.col("para_len")), "v_lines": F.transform(F.split("text", "\n"), T.strip), "v_words": F.array(*(T.among(F.col("alpha"), [f]).cast("double") for f in V_FUNCTION_WORDS))})


def version_two() -> dict[str, Column]:
    n = F.col("n_alpha")
    listed = F.size(F.filter("v_lines", lambda x: x.rlike(r"^([-*•]|\d+[.)])")))
    return {
        "hapax_rate": T.ratio(F.col("n1"), n),
        "sentence_initial_entropy": F.when(F.col("n_sents") >= 2, T.entropy(F.col("v_first_c")) / F.log2(F.col("n_sents").cast("double"))).otherwise(0.0),
        "function_word_cv": T.cv_of(F.col("v_words")),
        "punctuation_entropy": F.when(T.sum_of(F.col("v_marks_c")) >= 5, T.entropy(F.col("v_marks_c"))).otherwise(0.0),
        "paragraph_length_cv": T.cv_of(F.col("v_paras")),
        "sentence_length_cv": T.cv_of(F.col("sent_len")),
        "list_marker_rate": listed / F.size("v_lines"),
        "type_token_ratio": T.ratio(F.col("V"), n),
        "em_dash_rate": T.ratio(T.total([T.count_of(F.col("text"), p) for p in ("—", "--", "–")]), F.col("n_ws")) * 100,
    }


INITIAL = ["however", "therefore", "thus", "moreover", "furthermore", "additionally", "consequently", "in contrast"]


def micro() -> dict[str, Column]:
    """Connector and punctuation rates by sentence; sentences are runs of end marks, one at least."""
    s, low = F.greatest(F.regexp_count("text", F.lit(r"[.!?]+")), F.lit(1)), F.col("low")
    one = lambda w: T.among(F.col("word_runs"), [w])
    first = {w: F.regexp_count(low, F.lit(rf"(?:^|\. ){w}[,\s]")) for w in INITIAL}
    coord, sub = one("and") + one("but") + one("or"), T.total([one(w) for w in ("because", "although", "while", "if")])
    count = {"semicolon": [";"], "colon": [":"], "em_dash": ["—", "--"], "parenthetical": ["("], "ellipsis": ["...", "…"], "exclamation": ["!"], "question": ["?"]}
    marks = {k: T.total([T.count_of(F.col("text"), p) for p in v]) for k, v in count.items()}
    hundred = F.greatest(F.col("n_ws"), F.lit(100))
    out = {f"conn_{w}_rate": one(w) / s for w in ("and", "but", "or", "because", "although", "while", "if")}
    out |= {f"trans_{w}_rate": first[w] / s for w in INITIAL[:6]}
    out |= {"trans_initial_total_rate": T.total(list(first.values())) / s, "conn_and_but_ratio": one("and") / (one("but") + 1), "conn_coord_subord_ratio": coord / (sub + 1)}
    out |= {f"punct_{k}_rate": v / s for k, v in marks.items()}
    return out | {f"punct_{k}_per_100": marks[k] / hundred * 100 for k in ("semicolon", "em_dash")}


#: Layers' features in the fixed order of the long vector; vectors of lower tiers are subsets.
TIERS = {"light": ["layer_e"], "medium": ["layer_e", "layer_b"], "deep": ["layer_e", "layer_b", "layer_d"]}
