"""Registry of the feature groups, their features and the views over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.operators import complete, dynamics, embedding, layers, stance, statistical, style, structure
from lexiprint.operators.parts import with_parts

Prepare = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Group:
    """A named set of features over the parts of a document; ``arrow`` if it needs an Arrow UDF."""

    name: str
    features: Callable[[], dict[str, Column]]
    prepare: tuple[Prepare, ...] = ()
    arrow: bool = False


GROUPS: dict[str, Group] = {}


def register(group: Group) -> Group:
    """Add a group; a later one of the same name replaces it."""
    GROUPS[group.name] = group
    return group


for _group in (
    Group("statistical", statistical.features, (statistical.prepare,)),
    Group("statistical_compression", statistical.compression, arrow=True),
    Group("lexical", statistical.lexical, (statistical.prepare,)),
    Group("structural", structure.structural, (structure.prepare,)),
    Group("punctuation", structure.punctuation),
    Group("connectors", structure.connectors, (structure.prepare,)),
    Group("epistemic", structure.epistemic, (structure.prepare, structure.prepare_epistemic)),
    Group("transitions", structure.transitions, (structure.prepare,)),
    Group("rhythm", structure.rhythm, (structure.prepare,)),
    Group("lightweight", structure.lightweight, (structure.prepare,)),
    Group("alignment", style.alignment, (structure.prepare, style.prepare_alignment)),
    Group("noise", style.noise, (statistical.prepare, style.prepare)),
    Group("tokenization", style.tokenization),
    Group("echo", style.echo, (structure.prepare, style.prepare_echo)),
    Group("dynamics", dynamics.dynamics, (dynamics.prepare,)),
    Group("fractal", dynamics.fractal, (dynamics.prepare,)),
    Group("layer_e", layers.layer_e, (layers.prepare_e,)),
    Group("layer_e_compression", layers.layer_e_compression, (layers.prepare_e,), arrow=True),
    Group("layer_a", embedding.layer_a, (embedding.prepare_a,), arrow=True),
    Group("layer_b", layers.layer_b, (layers.prepare_b,)),
    Group("layer_c1", stance.layer_c1, (structure.prepare, stance.prepare)),
    Group("layer_c2", stance.layer_c2, (structure.prepare, stance.prepare)),
    Group("layer_d", layers.layer_d, (layers.prepare_d,)),
    Group("version_two", layers.version_two, (layers.prepare_v,)),
    Group("complete_punctuation", complete.punctuation, (structure.prepare, complete.prepare)),
    Group("complete_structural", complete.structural, (structure.prepare, complete.prepare)),
    Group("complete_connectors", complete.connectors, (structure.prepare, complete.prepare)),
    Group("complete_rhythm", complete.rhythm, (structure.prepare, complete.prepare)),
    Group("complete_lexical", complete.lexical, (statistical.prepare,)),
    Group("complete_epistemic", complete.epistemic, (structure.prepare, complete.prepare_epistemic)),
    Group("complete_transitions", complete.transitions, (structure.prepare,)),
    Group("micro", layers.micro, (structure.prepare,)),
):
    register(_group)


def extract(docs: DataFrame, groups: list[str] | None = None, features: list[str] | None = None, namespaced: bool = True, digits: int | None = None) -> DataFrame:
    """``doc_id`` and the features of ``groups`` (all by default), one scan and no shuffle.

    Columns are ``<group>_<feature>``, or the bare feature names of a single
    group.  ``features`` keeps only those names; an unknown one is 0.  An
    unknown group raises KeyError.
    """
    chosen = [GROUPS[g] for g in (groups or [g for g in GROUPS if not GROUPS[g].arrow])]
    df, done = with_parts(docs), []
    for group in chosen:
        for step in group.prepare:
            if step not in done:
                df, done = step(df), [*done, step]
    out = {(f"{g.name}_{k}" if namespaced else k): v for g in chosen for k, v in g.features().items()}
    if features is not None:
        out = {k: out.get(k, F.lit(0.0)) for k in features}
    tidy = lambda c: c.cast("double") if digits is None else F.round(c.cast("double") + F.lit(1e-10), digits)
    return df.select("doc_id", *(tidy(v).alias(k) for k, v in out.items()))


def extract_groups(docs: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``doc_id`` and a struct of features for each group."""
    names = groups or [g for g in GROUPS if not GROUPS[g].arrow]
    flat = extract(docs, names)
    return flat.select("doc_id", *(F.struct(*(F.col(f"{g}_{k}").alias(k) for k in GROUPS[g].features())).alias(g) for g in names))


def vector(features: DataFrame) -> DataFrame:
    """``doc_id, vector``: all feature columns in alphabetical order."""
    names = sorted(c for c in features.columns if c != "doc_id")
    return features.select("doc_id", F.array(*names).alias("vector"))


# The named vectors, in their order; a layer stands for all its features here listed.
LAYERS = {
    "A": [("layer_a", f) for f in embedding.FEATURES],
    "B": [("layer_b", f) for f in ("phonetic_mean", "phonetic_std", "phonetic_max", "structural_mean", "structural_std", "structural_max", "semantic_mean", "semantic_std", "semantic_max", "cooccurrence_rate", "geometric_mean", "overall_mean", "overall_std", "overall_max", "burstiness")],
    "C1": [("layer_c1", f) for f in ("hedge_density", "hedge_clustering", "hedge_position_bias", "confidence_mean", "confidence_variance", "confidence_arc")],
    "C2": [("layer_c2", f) for f in ("additive_rate", "contrastive_rate", "causal_rate", "temporal_rate", "exemplifying_rate", "reformulating_rate")],
    "D": [("layer_d", f) for f in ("clause_length_mean", "clause_length_std", "clause_rhythm_autocorr", "sentence_complexity", "comma_density", "semicolon_rate", "parenthetical_rate")],
    "E": [("layer_e", "sentence_length_cv"), ("layer_e", "paragraph_length_cv"), ("layer_e", "type_token_ratio"), ("layer_e_compression", "compression_ratio"), ("layer_e", "list_marker_rate"), ("layer_e", "hapax_legomena_ratio")],
    "tortuosity": [("layer_a", "path_tortuosity")],
}
VIEWS = {"fast": ["E", "tortuosity"], "medium": ["E", "A", "B"], "old": ["A", "C1", "C2", "D"], "long": ["A", "B", "C1", "C2", "D"], "full": ["A", "B", "C1", "C2", "D", "E"]}


def view(docs: DataFrame, name: str) -> DataFrame:
    """``doc_id, vector``: one of ``VIEWS``, of 7, 26, 24, 39 or 45 numbers; only the groups it needs are worked out."""
    places = [p for layer in VIEWS[name] for p in LAYERS[layer]]
    found = extract(docs, list(dict.fromkeys(g for g, _ in places)))
    return found.select("doc_id", F.array(*(F.col(f"{g}_{k}") for g, k in places)).alias("vector"))


def flat(features: DataFrame) -> DataFrame:
    """Bare feature names; where groups share one, the later registered group counts."""
    names = {k: f"{g}_{k}" for g in GROUPS for k in GROUPS[g].features() if f"{g}_{k}" in features.columns}
    return features.select("doc_id", *(F.col(c).alias(k) for k, c in names.items()))


def describe(spark: SparkSession) -> DataFrame:
    """``group, feature, arrow`` of everything registered."""
    rows = [(g.name, k, g.arrow) for g in GROUPS.values() for k in g.features()]
    return spark.createDataFrame(rows, "group string, feature string, arrow boolean")
