"""Queries of features and clauses over parses of ``documents``, and their SQL.

The tables hold no parses; one is derived from the words: a sentence is every
``SENTENCE`` tokens, tags go by length, relations by length and place, and each
token is governed by one a little nearer to the sentence's middle token, its
root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import clauses as C
from lexiprint.operators import tokens as K
from lexiprint.plans.models import rounded

SENTENCE = 24
TAGS = ["X", "DET", "ADP", "CCONJ", "NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "NOUN", "SCONJ", "AUX"]
RELATIONS = ["det", "nsubj", "conj", "amod", "advcl", "dobj", "punct", "ccomp", "nsubjpass", "relcl", "aux", "prep", "xcomp"]
MARKS = ".,;:!?—"
_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[{MARKS}]"


def parsed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, tokens`` with the derived parse."""
    df = docs.select("doc_id", T.text_of("text").alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))
    df = df.withColumn("n", F.size("words"))
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i)

    def token(w, i):
        place = i % SENTENCE
        start = i - place
        root = start + F.floor((F.least(F.lit(SENTENCE), F.col("n") - start) - 1) / 2).cast("int")
        # bound, since each mention would be worked out again
        known = F.struct(w.alias("w"), F.lower(w).alias("low"), F.length(w).alias("size"), w.isin(list(MARKS)).alias("mark"), i.alias("i"), place.alias("place"), root.alias("root"))
        return T.let(known, built)

    def built(k):
        w, low, size, mark, i, root = (k[c] for c in ("w", "low", "size", "mark", "i", "root"))
        step = 1 + size % 3
        return F.struct(
            w.alias("text"), low.alias("lemma"), F.when(mark, "PUNCT").otherwise(pick(TAGS, size % len(TAGS))).alias("pos"),
            F.when(i == root, "ROOT").when(mark, "punct").otherwise(pick(RELATIONS, (size * 5 + k["place"]) % len(RELATIONS))).alias("dep"),
            F.when(i < root, F.least(i + step, root)).when(i > root, F.greatest(i - step, root)).otherwise(i).alias("head"),
            F.floor(i / SENTENCE).cast("int").alias("sent"), F.when((size % 3 == 0) & (low != w), w).alias("ent"),
        )

    return df.select("doc_id", "text", F.transform("words", token).alias("tokens"))


def _parsed(build):
    return lambda spark, sf_dir: build(parsed(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {f"token_{g}": _parsed(lambda d, g=g: rounded(K.token_features(d, (g,)))) for g in ("pos", "dependency", "information", "topology")}
QUERIES |= {
    "clause_spans": _parsed(lambda d: C.clauses(d).withColumnsRenamed({"start": "first_token", "end": "last_token"}).withColumn("words", F.array_join("words", " "))),
    "clause_structure": _parsed(lambda d: rounded(C.structure(d))),
    "clause_pairs": _parsed(lambda d: C.pairs(d).withColumns({z: F.array_join(z, " ") for z in ("zone_a", "zone_b")})),
}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_MARKS = ", ".join(f"'{m}'" for m in MARKS)
#: The derived parse, a row for each token.
TOKENS = rf"""w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') as w, coalesce(text, '') as body from documents),
p as (select doc_id, unnest(w) as word, (generate_subscripts(w, 1) - 1)::bigint as i, len(w) as n from w),
q as (select *, i % {SENTENCE} as place, i - i % {SENTENCE} as start, length(word) as size, word in ({_MARKS}) as mark from p),
r as (select *, start + (least({SENTENCE}, n - start) - 1) // 2 as root, 1 + size % 3 as step from q),
tok as (select doc_id, i, n, word, lower(word) as lemma, i // {SENTENCE} as sent,
    case when mark then 'PUNCT' else ({_list(TAGS)})[size % {len(TAGS)} + 1] end as pos,
    case when i = root then 'ROOT' when mark then 'punct' else ({_list(RELATIONS)})[(size * 5 + place) % {len(RELATIONS)} + 1] end as dep,
    case when i < root then least(i + step, root) when i > root then greatest(i - step, root) else i end as head,
    case when size % 3 = 0 and lower(word) <> word then word end as ent from r)"""


def _r(values: dict[str, str]) -> str:
    return ", ".join(f"round(({v})::double + 1e-10, 6) as {k}" for k, v in values.items())


def _pos_sql() -> str:
    count = lambda *tags: f"count(*) filter (pos in ({', '.join(f'{chr(39)}{t}{chr(39)}' for t in tags)}))"
    entropy = lambda k: f"(select doc_id, -sum(c / s * log2(c / s)) as h{k} from (select doc_id, c, sum(c) over (partition by doc_id) as s from (select doc_id, g{k}, count(*)::double as c from g where g{k} is not null group by all)) group by doc_id)"
    out = {
        "coord_subord_ratio": "case when sc > 0 then cc / sc when cc > 0 then cc * 2 else 1 end",
        "adj_noun_ratio": "adj / greatest(nouns, 1)",
        "pos_bigram_entropy": "coalesce(h2, 0)",
        "pos_trigram_entropy": "coalesce(h3, 0)",
        "adv_verb_ratio": "adv / greatest(verbs, 1)",
        "noun_verb_ratio": "nouns / greatest(verbs, 1)",
        "noun_ratio": "nouns / m",
        "verb_ratio": "verbs / m",
        "adj_ratio": "adj / m",
        "adv_ratio": "adv / m",
        "pron_ratio": "pron / m",
        "propn_ratio": "propn / greatest(nouns, 1)",
    }
    return f"""with {TOKENS},
t as (select doc_id, pos, row_number() over (partition by doc_id order by i) as k from tok where pos <> 'PUNCT'),
g as (select doc_id, pos || ' ' || lead(pos) over o as g2, pos || ' ' || lead(pos) over o || ' ' || lead(pos, 2) over o as g3 from t window o as (partition by doc_id order by k)),
c as (select doc_id, count(*) as m, {count("NOUN", "PROPN")} as nouns, {count("VERB")} as verbs, {count("ADJ")} as adj, {count("ADV")} as adv, {count("PRON")} as pron, {count("PROPN")} as propn, {count("CCONJ")} as cc, {count("SCONJ")} as sc from t group by doc_id)
select doc_id, {_r({f"pos_{k}": f"case when m >= 5 then {v} else 0 end" for k, v in out.items()})}
from documents left join c using (doc_id) left join {entropy(2)} using (doc_id) left join {entropy(3)} using (doc_id)"""


_DEPENDENCY = f"""with recursive {TOKENS},
up as (select doc_id, i, head as place, (head <> i)::int as d from tok union all select up.doc_id, up.i, t.head, d + 1 from up join tok t on t.doc_id = up.doc_id and t.i = up.place where t.head <> up.place),
deep as (select doc_id, i, max(d) as d from up group by doc_id, i),
a as (select doc_id, any_value(n) as n, count(distinct sent) as sentences, avg(abs(i - head)) filter (dep <> 'ROOT') as mean, max(abs(i - head)) filter (dep <> 'ROOT') as most, stddev_pop(abs(i - head)) filter (dep <> 'ROOT') as sd,
    count(*) filter (dep = 'nsubjpass') as passive, count(*) filter (dep = 'relcl') as relative from tok group by doc_id),
b as (select doc_id, avg(d) as depth from deep group by doc_id)
select doc_id, {_r({f"dependency_{k}": f"case when n >= 5 then coalesce({v}, 0) else 0 end" for k, v in {"avg_dependency_distance": "mean", "max_dependency_distance": "most", "dependency_distance_std": "sd", "tree_depth_mean": "depth", "passive_voice_rate": "passive / sentences", "relative_clause_rate": "relative / sentences"}.items()})}
from documents left join a using (doc_id) left join b using (doc_id)"""

_ARGUMENTS = ", ".join(f"'{a}'" for a in K.ARGUMENTS)
_NUMBERS = " + ".join(f"len(regexp_extract_all(lower(body), '{p}'))" for p in K.NUMBERS)
_INFORMATION = rf"""with {TOKENS},
a as (select doc_id, any_value(n) as n, count(distinct sent) as sentences, count(*) filter (pos in ('NOUN', 'VERB', 'PROPN')) as content, count(*) filter (pos in ('ADV', 'ADJ')) as modifiers,
    count(distinct lower(ent)) as names, count(distinct lower(ent)) filter (i < n // 2) as early, count(*) filter (regexp_full_match(word, '\p{{L}}+')) as words, count(*) filter (pos = 'NUM' and regexp_full_match(word, '[0-9]+')) as digits from tok group by doc_id),
v as (select t.doc_id, count(distinct t.i) as verbs from tok t join tok u on u.doc_id = t.doc_id and u.head = t.i and u.dep in ({_ARGUMENTS}) where t.pos = 'VERB' and t.dep not in ('aux', 'auxpass') group by t.doc_id),
m as (select doc_id, length(body) as chars, {_NUMBERS} as numbers from w)
select doc_id, {_r({f"information_{k}": f"case when words >= 20 and sentences >= 3 and chars >= 100 then {v} else 0 end" for k, v in {"propositional_density": "least(coalesce(verbs, 0) / sentences / 3, 1)", "named_entity_velocity": "case when names >= 2 then 2 * abs(early / names - 0.5) else 0.5 end", "adverbial_stuffing": "case when content > 0 then least(2 * modifiers / content, 1) else 0.5 end", "specific_number_rate": "least((numbers + digits) * 100 / words / 5, 1)"}.items()})}
from documents left join a using (doc_id) left join v using (doc_id) left join m using (doc_id)"""

_TOPOLOGY = f"""with recursive {TOKENS},
nn as (select doc_id, lemma as w, i from tok where pos in ('NOUN', 'PROPN') and length(word) > 2),
enough as (select doc_id from nn group by doc_id having count(*) >= 5),
nodes as (select doc_id, w, min(i) as place, row_number() over (partition by doc_id order by min(i)) - 1 as v from nn join enough using (doc_id) group by doc_id, w),
spots as (select a.doc_id, least(a.w, b.w) as x, greatest(a.w, b.w) as y, a.i * 100 + b.i - a.i as seen from nn a join nn b on b.doc_id = a.doc_id and b.i > a.i and b.i - a.i <= {K.WINDOW} and b.w <> a.w),
edges0 as (select doc_id, x, y, count(*) as weight, min(seen) as seen from spots group by doc_id, x, y),
edges as (select e.doc_id, p.v as x, q.v as y, weight, row_number() over (partition by e.doc_id order by seen) as nr, (abs(p.place - q.place) > {K.FAR})::int as far from edges0 e join nodes p on p.doc_id = e.doc_id and p.w = e.x join nodes q on q.doc_id = e.doc_id and q.w = e.y),
sizes as (select doc_id, count(*) as m, sum(weight) as total, avg(far) as far from edges group by doc_id having count(*) >= 3),
counts as (select doc_id, count(*) as n from nodes group by doc_id),
big as (select * from sizes join counts using (doc_id) where n >= 5),
near as (select doc_id, x as a, y as b from edges join big using (doc_id) union all select doc_id, y, x from edges join big using (doc_id)),
degree as (select doc_id, a, count(*) as k from near group by doc_id, a),
closed as (select p.doc_id, p.a, count(*) as c from near p join near q on q.doc_id = p.doc_id and q.a = p.a join near r on r.doc_id = p.doc_id and r.a = p.b and r.b = q.b group by p.doc_id, p.a),
clustering as (select d.doc_id, avg(coalesce(c, 0) / (k * (k - 1))) as value from degree d left join closed using (doc_id, a) where k >= 2 group by d.doc_id),
walk as (
    select doc_id, v as origin, v as place, 0 as d from nodes join big using (doc_id) where v < 10
    union select walk.doc_id, origin, b, d + 1 from walk join near on near.doc_id = walk.doc_id and near.a = walk.place where d < 40),
reach as (select doc_id, origin, place, min(d) as d from walk group by doc_id, origin, place),
paths as (select doc_id, avg(d) as mean from reach where d > 0 group by doc_id),
world as (select big.doc_id, case when paths.mean is null then 0.5 else least(coalesce(clustering.value, 0) / 0.5 / (paths.mean / (ln(n) / ln(greatest(2 * m / n, 2)))) / 2, 1) end as value from big left join paths using (doc_id) left join clustering using (doc_id)),
strength as (select doc_id, v, sum(weight) as s from (select doc_id, x as v, weight from edges union all select doc_id, y, weight from edges) group by doc_id, v),
gains as (select e.doc_id, e.x, e.y, nr, weight, p.s as sx, q.s as sy, total, weight / total - p.s * q.s / (2 * total * total) as gain from edges e join big using (doc_id) join strength p on p.doc_id = e.doc_id and p.v = e.x join strength q on q.doc_id = e.doc_id and q.v = e.y),
merged as (
    select doc_id, n, 0 as step, range(n) as own from big
    union all
    select m.doc_id, m.n, m.step + 1, list_transform(m.own, lambda c: case when c = m.own[b.y + 1] then m.own[b.x + 1] else c end)
    from merged m join lateral (select g.x, g.y from gains g where g.doc_id = m.doc_id and m.own[g.x + 1] <> m.own[g.y + 1] and g.gain > 0 order by g.gain desc, g.nr limit 1) b on true where m.step < least(m.n // 2, 10)),
final as (select doc_id, arg_max(own, step) as own from merged group by doc_id),
modular as (select g.doc_id, greatest(0, least(1, coalesce(sum((weight - sx * sy / (2 * total)) / total) filter (own[x + 1] = own[y + 1]), 0) + 0.5)) as value from gains g join final using (doc_id) group by g.doc_id)
select doc_id, {_r({"topology_small_world_coefficient": "coalesce(world.value, 0)", "topology_graph_modularity": "coalesce(modular.value, 0)", "topology_long_range_edge_density": "coalesce(sizes.far, 0)"})}
from documents left join world using (doc_id) left join modular using (doc_id) left join sizes using (doc_id)"""

_WORDS = lambda marks: ", ".join(f"'{m}'" for m in marks)
_KIND = "case dep " + " ".join(f"when '{d}' then '{k}'" for d, k in C.ANCHORS.items()) + " end"
_CLASS = "case kind " + " ".join(f"when '{k}' then {n}" for k, n in C.ORDER.items()) + " end"
#: Clauses: subtrees by a recursive walk down, neighbours parted by windows.
CLAUSES = f"""anchor as (select doc_id, i as head, {_KIND} as kind from tok where dep in ({_WORDS(C.ANCHORS)})),
below as (select doc_id, head, head as i from anchor union all select b.doc_id, b.head, t.i from below b join tok t on t.doc_id = b.doc_id and t.head = b.i and t.i <> t.head),
span as (select doc_id, head, kind, min(i) as s, max(i) as e from below join anchor using (doc_id, head) group by all),
placed as (select *, row_number() over (partition by doc_id order by s, {_CLASS}, head) - 1 as clause from span),
nexts as (select *, lead(s) over o as s2, lead(e) over o as e2 from placed window o as (partition by doc_id order by clause)),
mark as (select b.doc_id, b.clause, min(t.i) filter (t.word in ({_WORDS(C.STRONG)})) as strong, min(t.i) as any_mark from nexts b join tok t on t.doc_id = b.doc_id and t.word in ({_WORDS(C.MARKS)}) and t.i between b.s2 and least(b.e, b.e2) where b.e >= b.s2 group by all),
cuts as (select b.*, case when e >= s2 then coalesce(strong, any_mark) end as at_mark, case when e >= s2 then (s2 + least(e, e2)) // 2 end as middle from nexts b left join mark using (doc_id, clause)),
ends as (select *, coalesce(at_mark - 1, middle) as cut_end, coalesce(at_mark + 1, middle + 1) as cut_start from cuts),
begun as (select *, lag(cut_start) over (partition by doc_id order by clause) as from_before from ends),
started as (select *, case when from_before <= e then from_before else s end as s1 from begun),
clauses as (select doc_id, clause::int as clause, s1 as a_start, case when cut_end >= s1 then cut_end else e end as a_end, head, kind from started)"""
_STRUCTURE_PAIRS = f"""hung as (select distinct doc_id, head from tok where dep = 'punct' and word in ({_WORDS(C.PAIR_MARKS)})),
marked as (select c.*, h.head is not null as hung from clauses c left join hung h using (doc_id, head)),
heads as (select *, lead(head) over o as head2, lead(a_start) over o as b_start, lead(a_end) over o as b_end, lead(hung) over o as hung2 from marked window o as (partition by doc_id order by head)),
strong_between as (select distinct h.doc_id, h.head from heads h join tok t on t.doc_id = h.doc_id and t.word in ({_WORDS(C.PAIR_MARKS)}) and t.i > h.head and t.i < h.head2),
rule_a as (select h.doc_id, a_start, a_end, b_start, b_end from heads h left join strong_between using (doc_id, head) where head2 is not null and (hung or hung2 or strong_between.head is not null)),
after as (select *, lead(a_start) over o as b_start, lead(a_end) over o as b_end from clauses window o as (partition by doc_id order by clause)),
rule_b as (select distinct n.doc_id, a_start, a_end, b_start, b_end from after n join tok t on t.doc_id = n.doc_id and t.lemma in ({_WORDS(C.CONJUNCTIONS)}) and (t.i between a_start and a_end or t.i between b_start and b_end or t.i between a_end + 1 and b_start - 1) where b_start is not null),
rule_c as (select n.doc_id, a_start, a_end, b_start, b_end from after n join tok t on t.doc_id = n.doc_id and t.i = b_start join tok u on u.doc_id = n.doc_id and u.i = b_start + 1 where b_end > b_start and t.word in ({_WORDS(C.TRANSITIONS)}) and u.word = ','),
ruled as (
    select doc_id, case when a_start > b_start then b_start else a_start end as a_start, case when a_start > b_start then b_end else a_end end as a_end, case when a_start > b_start then a_start else b_start end as b_start, case when a_start > b_start then a_end else b_end end as b_end, 1 as rule, 'punctuation' as kind from rule_a
    union all select doc_id, a_start, a_end, b_start, b_end, 2, 'conjunction' from rule_b union all select doc_id, a_start, a_end, b_start, b_end, 3, 'transition' from rule_c),
joined as (select doc_id, a_start, a_end, b_start, b_end, min(rule) as rule, arg_min(kind, rule) as kind from ruled group by doc_id, a_start, a_end, b_start, b_end)"""
_CONTENT = _WORDS(C.CONTENT)


def _zone(side: str, best: str) -> str:
    return f"zone_{side} as (select j.doc_id, a_start, a_end, b_start, b_end, list(word order by i){best} as zone_{side} from joined j join tok t on t.doc_id = j.doc_id and t.pos in ({_CONTENT}) and t.i between {side}_start and {side}_end group by all)"


_KEYS = "(doc_id, a_start, a_end, b_start, b_end)"
_LENGTH = "a_end - a_start + 1"
_COUNTS = {"clause_count": "n", "clause_main_ratio": "main / greatest(n, 1)", "clause_subordinate_ratio": "sub / greatest(n, 1)", "clause_main_subordinate_ratio": "main / (sub + 1)", "clause_length_mean": "mean", "clause_length_std": "sd", "clause_length_cv": "case when mean > 0 then sd / mean else 0 end", "clause_length_max": "longest", "clause_length_min": "shortest"}
_COUNTS |= {f"pair_{k}_rate": f"{k} / greatest(p, 1)" for k in ("punctuation", "conjunction", "transition")} | {"pairs_per_sentence": "p / greatest(sentences, 1)"} | {f"{k}_pairs_per_sentence": f"{k} / greatest(sentences, 1)" for k in ("punctuation", "conjunction", "transition")}

ORACLES = {
    "token_pos": _pos_sql(),
    "token_dependency": _DEPENDENCY,
    "token_information": _INFORMATION,
    "token_topology": _TOPOLOGY,
    "clause_spans": f'with recursive {TOKENS}, {CLAUSES} select c.doc_id, clause, a_start::int as first_token, a_end::int as last_token, c.head::int as head, kind, string_agg(word, \' \' order by t.i) as words from clauses c join tok t on t.doc_id = c.doc_id and t.i between a_start and a_end group by all',
    "clause_pairs": f"with recursive {TOKENS}, {CLAUSES}, {_STRUCTURE_PAIRS}, {_zone('a', '[-3:]')}, {_zone('b', '[:3]')} select doc_id, a_start::int as a_start, a_end::int as a_end, b_start::int as b_start, b_end::int as b_end, kind, coalesce(array_to_string(zone_a, ' '), '') as zone_a, coalesce(array_to_string(zone_b, ' '), '') as zone_b from joined left join zone_a using {_KEYS} left join zone_b using {_KEYS}",
    "clause_structure": f"""with recursive {TOKENS}, {CLAUSES}, {_STRUCTURE_PAIRS},
x as (select doc_id, count(*) as n, count(*) filter (kind = 'main') as main, count(*) filter (kind = 'subordinate') as sub, avg({_LENGTH}) as mean, stddev_pop({_LENGTH}) as sd, max({_LENGTH}) as longest, min({_LENGTH}) as shortest from clauses group by doc_id),
y as (select doc_id, count(*) as p, {", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in ("punctuation", "conjunction", "transition"))} from joined group by doc_id),
z as (select doc_id, count(distinct sent) as sentences from tok group by doc_id)
select doc_id, {_r({k: f"coalesce({v}, 0)" for k, v in _COUNTS.items()})} from documents left join x using (doc_id) left join y using (doc_id) left join z using (doc_id)""",
}
