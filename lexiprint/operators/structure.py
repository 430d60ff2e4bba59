"""Features of sentences, paragraphs, punctuation, connectors, stance, sentence openings and rhythm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import lexicons as L

QUOTES = "\"'"


def prepare(df: DataFrame) -> DataFrame:
    """Openings and ends of sentences, clauses, cleaned words and word runs."""
    df = df.withColumns(
        {
            "first": F.transform("sent_words", lambda w: F.btrim(F.lower(F.get(w, 0)), F.lit(QUOTES))),
            "last": F.transform("sent_words", lambda w: F.btrim(F.lower(F.element_at(w, -1)), F.lit(QUOTES))),
            "first_raw": F.transform("sent_words", lambda w: F.lower(F.get(w, 0))),
            "clauses": F.filter(F.transform(F.split("text", "[,;]"), lambda c: F.size(T.ws_words(c)).cast("double")), lambda n: n > 1),
            "clean": F.transform(T.ws_words(F.col("low")), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")),
            "word_runs": T.word_runs(F.col("text")),
            "lower_ws": F.transform("ws", F.lower),
            "plain": F.when(F.octet_length("low") > F.length("low"), F.regexp_replace("low", r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")).otherwise(F.col("low")),
        }
    )
    df = T.with_counts(df, first_c=F.col("first"), last_c=F.col("last"), first_raw_c=F.col("first_raw"), ws_c=T.hashes(F.col("lower_ws")))
    return df.withColumn("clause_mean", T.mean_of(F.col("clauses")))


def _share(part: str) -> Column:
    return T.count_of(F.col("text"), part) / F.col("per_sent")


def _guard(out: dict[str, Column]) -> dict[str, Column]:
    return {k: T.zero_unless(F.col("n_ws") >= 10, v) for k, v in out.items()}


LIST_MARK = r"(?:^|\n)\s*[-*•]\s|(?:^|\n)\s*\d+\.\s"
LIST_MARK_L = r"(?:^|\n)\s*(?:\d+[.)]|[-*•])\s"


def structural() -> dict[str, Column]:
    return _guard(structural_free())


def structural_free() -> dict[str, Column]:
    """The structural features without the guard against short texts."""
    several = F.col("n_sents") > 1
    line = F.split("text", "\n")
    trimmed = lambda x: T.strip(x)
    header = lambda x: (trimmed(x) != "") & (trimmed(x).startswith("#") | ((F.size(T.ws_words(x)) <= 8) & trimmed(x).endswith(":")) | ((x == F.upper(x)) & (x != F.lower(x))))
    return {
        "sentence_length_cv": T.zero_unless(several, T.cv_of(F.col("sent_len"))),
        "sentence_length_mean": F.col("sent_mean"),
        "sentence_length_std": T.zero_unless(several, T.std_of(F.col("sent_len"))),
        "paragraph_length_cv": T.cv_of(F.col("para_len")),
        "paragraph_count_norm": F.size("paras") / (F.col("n_ws") / 1000),
        "list_marker_rate": F.regexp_count("text", F.lit(LIST_MARK)) / F.col("per_sent"),
        "header_rate": F.size(F.filter(line, header)) / F.greatest(F.size("paras"), F.lit(1)),
        "sentence_initial_entropy": T.entropy(F.col("first_c")),
        "sentence_final_entropy": T.entropy(F.col("last_c")),
        "quote_rate": F.regexp_count("text", F.lit("[\"'].*?[\"']")) / F.col("per_sent"),
    }


def punctuation() -> dict[str, Column]:
    n = F.col("per_sent")
    dashes = T.total([T.count_of(F.col("text"), p) for p in ("—", "–", "--")])
    return _guard(
        {
            "question_rate": _share("?"),
            "em_dash_rate": dashes / n,
            "semicolon_rate": _share(";"),
            "exclamation_rate": _share("!"),
            "ellipsis_rate": (T.count_of(F.col("text"), "…") + F.regexp_count("text", F.lit(r"\.{3,}"))) / n,
            "parenthetical_rate": _share("("),
            "colon_rate": F.regexp_count("text", F.lit(r"(?<!\d):(?!\d|//)")) / n,
            "comma_density": 100 * T.count_of(F.col("text"), ",") / F.col("n_ws"),
        }
    )


def connectors() -> dict[str, Column]:
    n, clean, low = F.col("n_ws"), F.col("clean"), F.col("low")
    one = lambda *w: T.among(clean, list(w))
    ands, buts = one("and"), one("but")
    rate = lambda c: c / n * 100
    return _guard(
        {
            "and_but_ratio": F.when(buts > 0, ands / buts).when(ands > 0, ands * 2.0).otherwise(1.0),
            "however_rate": rate(one("however")),
            "therefore_rate": rate(one("therefore", "thus")),
            "furthermore_rate": rate(one("furthermore", "moreover", "additionally")),
            "because_rate": rate(one("because", "since")),
            "contrast_marker_density": rate(one(*L.CONTRASTIVE) + T.total([T.count_of(low, p) for p in L.CONTRASTIVE_PHRASES])),
            "additive_density": rate(one(*L.ADDITIVE)),
            "causal_density": rate(one(*L.CAUSAL) + T.total([T.count_of(low, p) for p in L.CAUSAL_PHRASES])),
        }
    )


def prepare_epistemic(df: DataFrame) -> DataFrame:
    """Hedges and boosters as columns: several features mention them, and each mention would count all the phrases again."""
    hits = lambda phrases: T.phrase_count(F.col("low"), F.col("word_runs"), phrases)
    return df.withColumns({"hedges": hits(L.HEDGES), "boosters": hits(L.BOOSTERS)})


def epistemic() -> dict[str, Column]:
    n, h, b = F.col("n_ws"), F.col("hedges"), F.col("boosters")
    hits = lambda phrases: T.phrase_count(F.col("low"), F.col("word_runs"), phrases)
    return _guard(
        {
            "hedge_density": h / n * 100,
            "booster_density": b / n * 100,
            "hedge_boost_ratio": F.when(b > 0, h / b).when(h > 0, h * 2.0).otherwise(1.0),
            "personal_marker_rate": hits(L.PERSONAL) / n * 100,
            "evidential_rate": hits(L.EVIDENTIAL) / n * 100,
            "certainty_score": F.when(h + b > 0, b / (h + b)).otherwise(0.5),
        }
    )


def transitions() -> dict[str, Column]:
    n, first = F.col("n_sents"), F.col("first")
    opens = T.total([F.regexp_count("low", F.lit(r"(?:^|[.!?]\s+)" + p)) for p in L.AI_STARTERS])
    starters = T.among(first, L.TRANSITION_STARTERS) / n
    out = {
        "transition_starter_rate": starters,
        "ai_starter_rate": opens / n,
        "human_starter_rate": T.among(first, L.HUMAN_STARTERS) / n,
        "starter_diversity": F.size("first_c") / n,
        "first_word_entropy": T.entropy_share(F.col("first_c")),
        "explicit_transition_rate": starters,
    }
    return {k: T.zero_unless(n >= 3, v) for k, v in out.items()}


def rhythm() -> dict[str, Column]:
    c, mean, n = F.col("clauses"), F.col("clause_mean"), F.col("per_sent")
    return _guard(
        {
            "clause_length_mean": mean,
            "clause_length_std": T.std_of(c),
            "clause_rhythm_autocorr": T.autocorr(c),
            "sentence_complexity": F.size(c) / n,
            "comma_density": T.count_of(F.col("text"), ",") / (F.col("n_ws") / 100),
            "semicolon_rate": _share(";"),
            "parenthetical_rate": (T.count_of(F.col("text"), "(") + T.count_of(F.col("text"), ")")) / 2 / n,
        }
    )


def lightweight() -> dict[str, Column]:
    n, sents = F.col("n_ws"), F.col("n_sents")
    letters = F.filter("ws", lambda w: w.rlike(r"^\p{L}+$"))
    marks = F.array_distinct(F.filter(F.split("text", ""), lambda c: c.isin(list(L.PUNCTUATION))))
    out = {
        "sentence_length_cv": T.cv_of(F.col("sent_len"), sample=True),
        "paragraph_length_cv": T.cv_of(F.col("para_len"), sample=True),
        "type_token_ratio": F.size("ws_c") / n,
        "list_marker_rate": F.regexp_count("text", F.lit(LIST_MARK_L)) / n,
        "hapax_legomena_ratio": F.size(F.filter("ws_c", lambda c: c == 1)) / F.size("ws_c"),
        "sentence_initial_entropy": T.entropy_share(F.col("first_raw_c")),
        "avg_word_length": T.mean_of(F.transform(letters, lambda w: F.length(w).cast("double"))),
        "punctuation_diversity": F.size(marks) / 15,
        "question_ratio": T.ratio(T.count_of(F.col("text"), "?"), sents),
    }
    return {k: T.zero_unless(n >= 5, v) for k, v in out.items()}
