import math
from collections import Counter

from lexiprint.operators.tokens import token_features

SCHEMA = "doc_id long, tokens array<struct<text: string, lemma: string, pos: string, dep: string, head: int, sent: int, ent: string>>"
ROWS = [  # text, pos, dep, head, sent, ent
    ("Alice", "PROPN", "nsubj", 1, 0, "Alice"),
    ("wrote", "VERB", "ROOT", 1, 0, None),
    ("long", "ADJ", "amod", 3, 0, None),
    ("letters", "NOUN", "dobj", 1, 0, None),
    (".", "PUNCT", "punct", 1, 0, None),
    ("Letters", "NOUN", "nsubjpass", 7, 1, None),
    ("were", "AUX", "auxpass", 7, 1, None),
    ("sent", "VERB", "ROOT", 7, 1, None),
    ("quickly", "ADV", "advmod", 7, 1, None),
    ("and", "CCONJ", "cc", 7, 1, None),
    ("Bob", "PROPN", "conj", 7, 1, "Bob"),
    (".", "PUNCT", "punct", 7, 1, None),
    ("Paris", "PROPN", "ROOT", 12, 2, "Paris"),
]


def rows(pad):
    t = [(w, w, p, d, h, s, e) for w, p, d, h, s, e in ROWS]
    return t + [("thing", "thing", "NOUN", "ROOT", len(t) + i, 2, None) for i in range(pad)]


def test_features_of_a_small_parse(spark):
    df = spark.createDataFrame([(1, rows(0)), (2, rows(60)), (3, []), (4, None)], SCHEMA)
    got = {r["doc_id"]: r.asDict() for r in token_features(df).collect()}
    one = got[1]
    tags = [r[1] for r in ROWS if r[1] != "PUNCT"]
    pairs = Counter(zip(tags, tags[1:]))
    n = sum(pairs.values())
    assert abs(one["pos_pos_bigram_entropy"] + sum(c / n * math.log2(c / n) for c in pairs.values())) < 1e-9
    assert one["pos_coord_subord_ratio"] == 2 and one["pos_noun_verb_ratio"] == 2.5 and one["pos_propn_ratio"] == 3 / 5
    arcs = [abs(i - r[3]) for i, r in enumerate(ROWS) if r[2] != "ROOT"]
    assert abs(one["dependency_avg_dependency_distance"] - sum(arcs) / len(arcs)) < 1e-9 and one["dependency_max_dependency_distance"] == max(arcs)
    assert abs(one["dependency_tree_depth_mean"] - (10 + 1) / 13) < 1e-9 and one["dependency_passive_voice_rate"] == 1 / 3
    two = got[2]
    assert abs(two["information_propositional_density"] - 2 / 3 / 3) < 1e-9 and two["information_named_entity_velocity"] == 1
    assert two["topology_long_range_edge_density"] == 0
    assert all(v == 0 for i in (3, 4) for k, v in got[i].items() if k != "doc_id")


def test_graph_against_plain_loops(spark):
    import random

    r = random.Random(3)
    words = [r.choice("abcdefghijkl") * 3 for _ in range(60)]
    toks = [(w, w, "NOUN" if r.random() < 0.7 else "VERB", "ROOT", i, 0, None) for i, w in enumerate(words)]
    got = token_features(spark.createDataFrame([(1, toks)], SCHEMA), ("topology",)).first()
    nouns = [(t[0], i) for i, t in enumerate(toks) if t[2] == "NOUN"]
    nodes = list(dict.fromkeys(w for w, _ in nouns))
    edges = Counter()
    for k, (a, i) in enumerate(nouns):
        for b, j in nouns[k + 1 :]:
            if j - i <= 5 and a != b:
                edges[tuple(sorted((a, b)))] += 1
    near = {n: {b for e in edges for b in e if n in e and b != n} for n in nodes}
    parts = [sum(y in near[x] for x in near[n] for y in near[n]) / (len(near[n]) * (len(near[n]) - 1)) for n in nodes if len(near[n]) > 1]
    total = pairs = 0
    for s in nodes[:10]:
        seen, front, d = {s}, {s}, 0
        while front:
            d, front = d + 1, {y for x in front for y in near[x]} - seen
            seen |= front
            total, pairs = total + d * len(front), pairs + len(front)
    chance = math.log(len(nodes)) / math.log(max(2 * len(edges) / len(nodes), 2))
    want = min(sum(parts) / len(parts) / 0.5 / (total / pairs / chance) / 2, 1)
    assert abs(got["topology_small_world_coefficient"] - want) < 1e-9
    assert 0 < got["topology_graph_modularity"] <= 1
