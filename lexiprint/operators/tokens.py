"""Features over parsed tokens, from whatever parser made them.

``tokens`` is an array of structs ``text, lemma, pos, dep, head, sent, ent``:
tags as in Universal Dependencies, ``head`` the index of the governing token
(its own for a root), ``ent`` the text of a named entity on its first token or
null. Guards and defaults are those of the other groups: too few tokens, or a
null array, give 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexiprint.functions import text as T
from lexiprint.operators.clauses import depths

WINDOW, FAR = 5, 50
ARGUMENTS = ["nsubj", "nsubjpass", "dobj", "iobj", "attr", "ccomp", "xcomp", "acomp"]
# What counts as a specific number, each pattern on its own and without case.
NUMBERS = [
    r"\b[0-9]+\.?[0-9]*%\b",
    r"\b[0-9]{1,3}(?:,[0-9]{3})+\b",
    r"\b[0-9]+/[0-9]+\b",
    r"\b[0-9]{4}\b",
    r"\b[0-9]+\.[0-9]+\b",
    r"\$[0-9]+",
    r"\b[0-9]+\s?(?:million|billion|thousand|hundred)\b",
]


def _small_world(near: list[set[int]], edges: int) -> float:
    """Clustering over path length, each against its random counterpart; 0.5 without paths.

    ``near`` are the neighbours of each node.  Paths are measured from the ten
    nodes mentioned first.
    """
    many = [own for own in near if len(own) >= 2]
    closed = [sum(len(own & near[j]) for j in own) / (len(own) * (len(own) - 1)) for own in many]
    clustering = sum(closed) / len(closed) if closed else 0.0
    total = pairs = 0
    for root in range(min(10, len(near))):
        reached, front, steps = {root}, {root}, 0
        while front:
            steps += 1
            front = set().union(*(near[i] for i in front)) - reached
            reached |= front
            total, pairs = total + steps * len(front), pairs + len(front)
    if not pairs:
        return 0.5
    by_chance = np.log(len(near)) / np.log(max(2 * edges / len(near), 2))
    return float(min(clustering / 0.5 / (total / pairs / by_chance) / 2, 1.0))


def _modularity(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int) -> float:
    """Up to ten greedy merges of the communities whose edge gains most, then modularity + 0.5 within 0 and 1."""
    total = weight.sum()
    degree = np.bincount(x, weight, n) + np.bincount(y, weight, n)
    own = np.arange(n)
    gain = weight / total - degree[x] * degree[y] / (2 * total**2)
    for _ in range(min(n // 2, 10)):
        open_gain = np.where(own[x] != own[y], gain, 0.0)
        best = int(open_gain.argmax())
        if open_gain[best] <= 0:
            break
        own[own == own[y[best]]] = own[x[best]]
    inside = own[x] == own[y]
    value = float(((weight - degree[x] * degree[y] / (2 * total)) / total)[inside].sum())
    return max(0.0, min(1.0, value + 0.5))


@F.pandas_udf(ArrayType(DoubleType()))
def graph(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Small-world coefficient, modularity and share of far edges of a graph of words.

    A row has the words by their first places, those places, and the words at
    the two ends of each edge, repeats being weight.
    """

    def of(names, places, a, b) -> list[float]:
        if names is None or a is None or len(a) == 0:
            return [0.0, 0.0, 0.0]
        n, number = len(names), {w: i for i, w in enumerate(names)}
        pairs = np.array([[number[x], number[y]] for x, y in zip(a, b)])
        keys, first, weight = np.unique(pairs[:, 0] * n + pairs[:, 1], return_index=True, return_counts=True)
        if len(keys) < 3:
            return [0.0, 0.0, 0.0]
        order = np.argsort(first)  # edges as they come up in the text, which settles ties
        x, y, w = keys[order] // n, keys[order] % n, weight[order].astype(float)
        at = np.asarray(places)
        far = float((np.abs(at[x] - at[y]) > FAR).mean())
        if n < 5:
            return [0.0, 0.0, far]
        near: list[set[int]] = [set() for _ in range(n)]
        for i, j in zip(x.tolist(), y.tolist()):
            near[i].add(j)
            near[j].add(i)
        return [_small_world(near, len(keys)), _modularity(x, y, w, n), far]

    for columns in batches:
        yield pd.Series([of(*row) for row in zip(*columns)])


def prepare(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tokens`` with tags, words, nouns and their neighbour pairs; without a text the tokens stand for it."""
    text = T.text_of("text") if "text" in docs.columns else F.array_join(F.transform("tokens", lambda t: t["text"]), " ")
    df = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), "tokens").withColumn("tokens", F.transform("tokens", lambda t, i: F.struct(i.alias("i"), t["text"].alias("text"), t["lemma"].alias("lemma"), t["pos"].alias("pos"), t["dep"].alias("dep"), t["head"].alias("head"), t["sent"].alias("sent"), t["ent"].alias("ent"))))
    df = df.withColumns({"tags": F.transform(F.filter("tokens", lambda t: ~t["pos"].isin("PUNCT", "SPACE")), lambda t: t["pos"]), "n_tokens": F.coalesce(F.size("tokens"), F.lit(0)), "sentences": F.greatest(F.size(F.array_distinct(F.transform("tokens", lambda t: t["sent"]))), F.lit(1))})
    df = df.withColumns({"arcs": F.transform(F.filter("tokens", lambda t: t["dep"] != "ROOT"), lambda t: F.abs(t["i"] - t["head"]).cast("double")), "nouns": F.transform(F.filter("tokens", lambda t: t["pos"].isin("NOUN", "PROPN") & (F.length(t["text"]) > 2)), lambda t: F.struct(F.lower(t["lemma"]).alias("w"), t["i"].alias("i")))})
    # a word's neighbours within WINDOW tokens are among the next WINDOW nouns
    near = lambda a, k: F.transform(F.filter(F.slice("nouns", k + 2, WINDOW), lambda b: (b["i"] - a["i"] <= WINDOW) & (b["w"] != a["w"])), lambda b: F.struct(F.least(a["w"], b["w"]).alias("a"), F.greatest(a["w"], b["w"]).alias("b")))
    by_word = F.array_sort("nouns")
    df = df.withColumns({"edges": F.flatten(F.transform("nouns", near)), "by_word": by_word})
    first = F.filter("by_word", lambda x, k: F.when(k == 0, True).otherwise(F.get(F.col("by_word"), k - 1)["w"] != x["w"]))
    df = df.withColumn("places", F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))))
    return T.with_counts(df, tag2=T.ngram_hashes(F.col("tags"), 2), tag3=T.ngram_hashes(F.col("tags"), 3))


def _tagged(*tags: str) -> Column:
    return F.size(F.filter("tags", lambda t: t.isin(list(tags))))


def pos() -> dict[str, Column]:
    n = F.size("tags")
    nouns, verbs, cc, sc = _tagged("NOUN", "PROPN"), _tagged("VERB"), _tagged("CCONJ"), _tagged("SCONJ")
    one = lambda c: F.greatest(c, F.lit(1))
    out = {
        "coord_subord_ratio": F.when(sc > 0, cc / sc).when(cc > 0, cc * 2.0).otherwise(1.0),
        "adj_noun_ratio": _tagged("ADJ") / one(nouns),
        "pos_bigram_entropy": T.entropy(F.col("tag2")),
        "pos_trigram_entropy": T.entropy(F.col("tag3")),
        "adv_verb_ratio": _tagged("ADV") / one(verbs),
        "noun_verb_ratio": nouns / one(verbs),
        "noun_ratio": nouns / n,
        "verb_ratio": verbs / n,
        "adj_ratio": _tagged("ADJ") / n,
        "adv_ratio": _tagged("ADV") / n,
        "pron_ratio": _tagged("PRON") / n,
        "propn_ratio": _tagged("PROPN") / one(nouns),
    }
    return {k: T.zero_unless(n >= 5, v) for k, v in out.items()}


def dependency() -> dict[str, Column]:
    with_dep = lambda d: F.size(F.filter("tokens", lambda t: t["dep"] == d)) / F.col("sentences")
    out = {
        "avg_dependency_distance": T.mean_of(F.col("arcs")),
        "max_dependency_distance": F.coalesce(F.array_max("arcs"), F.lit(0.0)),
        "dependency_distance_std": T.std_of(F.col("arcs")),
        "tree_depth_mean": T.mean_of(depths(F.transform("tokens", lambda t: t["head"]))),
        "passive_voice_rate": with_dep("nsubjpass"),
        "relative_clause_rate": with_dep("relcl"),
    }
    return {k: T.zero_unless(F.col("n_tokens") >= 5, v) for k, v in out.items()}


def information() -> dict[str, Column]:
    """Propositions, when entities are first named, modifiers and numbers; for at least 3 sentences, 20 words of letters and 100 characters."""
    governed = F.transform(F.filter("tokens", lambda t: t["dep"].isin(ARGUMENTS)), lambda t: t["head"])
    verbs = F.transform(F.filter("tokens", lambda t: (t["pos"] == "VERB") & ~t["dep"].isin("aux", "auxpass")), lambda t: t["i"])
    named = F.filter("tokens", lambda t: t["ent"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda t: F.lower(t["ent"])))
    half = F.floor(F.col("n_tokens") / 2)
    early = F.array_distinct(F.transform(F.filter(named, lambda t: t["i"] < half), lambda t: F.lower(t["ent"])))
    content = _tagged("NOUN", "VERB", "PROPN")
    words = F.size(F.filter("tokens", lambda t: t["text"].rlike(r"^\p{L}+$")))
    digits = F.size(F.filter("tokens", lambda t: (t["pos"] == "NUM") & t["text"].rlike("^[0-9]+$")))
    numbers = T.matches(F.lower("text"), NUMBERS) + digits
    out = {
        "propositional_density": F.least(F.size(F.array_intersect(verbs, governed)) / F.col("sentences") / 3, F.lit(1.0)),
        "named_entity_velocity": F.when(F.size(names) >= 2, 2 * F.abs(F.size(early) / F.size(names) - 0.5)).otherwise(0.5),
        "adverbial_stuffing": F.when(content > 0, F.least(2 * _tagged("ADV", "ADJ") / content, F.lit(1.0))).otherwise(0.5),
        "specific_number_rate": F.least(numbers * 100 / words / 5, F.lit(1.0)),
    }
    return {k: T.zero_unless((words >= 20) & (F.col("sentences") >= 3) & (F.length("text") >= 100), v) for k, v in out.items()}


def topology() -> dict[str, Column]:
    """Graph of nouns that stand near each other: small world, modularity, and the share of edges between far first mentions."""
    side = lambda c, name: F.transform(c, lambda e: e[name])
    shape = graph(side("places", "w"), side("places", "i"), side("edges", "a"), side("edges", "b"))
    enough = F.size("nouns") >= 5
    return {"small_world_coefficient": T.zero_unless(enough, F.get(shape, F.lit(0))), "graph_modularity": T.zero_unless(enough, F.get(shape, F.lit(1))), "long_range_edge_density": T.zero_unless(enough, F.get(shape, F.lit(2)))}


def token_features(docs: DataFrame, groups: tuple[str, ...] = ("pos", "dependency", "information", "topology")) -> DataFrame:
    """``doc_id`` and ``<group>_<feature>`` columns of ``doc_id, tokens``."""
    made = {"pos": pos, "dependency": dependency, "information": information, "topology": topology}
    return prepare(docs).select("doc_id", *(F.coalesce(v, F.lit(0.0)).alias(f"{g}_{k}") for g in groups for k, v in made[g]().items()))
