"""Queries of the complete extractor's variants and their SQL."""

from __future__ import annotations

from lexiprint.operators import complete, stance
from lexiprint.operators import lexicons as L
from lexiprint.operators.registry import GROUPS
from lexiprint.plans.features import _ASCII, BASE, _agg_cte, _among, _count, _entropy, _lag, _list, _query, _rounded

QUERIES = {f"features_{g}": _query(g) for g in GROUPS if g.startswith("complete_")}


def _punctuation() -> str:
    columns = {
        "question_rate": f"{_count('?')} / per_sent",
        "exclamation_rate": f"{_count('!')} / per_sent",
        "em_dash_rate": f"({_count('—')} + {_count('--')} + {_count(' - ')}) / greatest(n_ws, 1)",
        "semicolon_rate": f"{_count(';')} / per_sent",
        "colon_rate": f"{_count(':')} / per_sent",
        "parenthetical_rate": f"({_count('(')} + {_count(')')}) / 2 / per_sent",
        "ellipsis_rate": f"({_count('...')} + {_count('…')}) / per_sent",
        "entropy": "h",
    }
    marks = complete.MARKS.replace("'", "''")
    return f"""with {BASE},
{_entropy(f"(select doc_id, unnest(regexp_extract_all(text, '{marks}')) as m from d)", "m", "em")},
joined as (select b.*, em.h as h from b left join em using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _structural() -> str:
    columns = {
        "sentence_length_cv": "case when n_sents > 1 then sent_std / sent_mean else 0 end",
        "sentence_length_mean": "sent_mean",
        "sentence_length_std": "case when n_sents > 1 then sent_std else 0 end",
        "paragraph_length_cv": "case when n_paras > 1 then para_std / para_mean else 0 end",
        "paragraph_count_norm": "n_paras / (greatest(n_ws, 1) / 1000)",
        "list_marker_rate": r"len(regexp_extract_all(text, '(?:^|\n)\s*[-*•]\s|(?:^|\n)\s*\d+\.\s')) / per_sent",
        "header_rate": "coalesce(headers, 0) / greatest(n_paras, 1)",
        "sentence_initial_entropy": "hf",
        "sentence_final_entropy": "hl",
        "quote_rate": "len(regexp_extract_all(text, '[\"''].*?[\"'']')) / per_sent",
    }
    return rf"""with {BASE},
f as (select doc_id, lower(sw[1]) as a, lower(sw[len(sw)]) as z from sl),
{_entropy("f", "a", "ef")}, {_entropy("f", "z", "el")},
lines as (select doc_id, l, regexp_replace(l, '^\s+|\s+$', '', 'g') as t from (select doc_id, unnest(string_split(text, chr(10))) as l from d)),
heads as (select doc_id, count(*)::double as headers from lines where t <> '' and (starts_with(t, '#') or (len(regexp_split_to_array(t, '\s+')) <= 8 and suffix(t, ':')) or (l = upper(l) and l <> lower(l))) group by doc_id),
joined as (select b.*, headers, ef.h as hf, el.h as hl from b left join heads using (doc_id) left join ef using (doc_id) left join el using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _connectors() -> str:
    rates = ("however", "therefore", "moreover", "furthermore")
    sets = {"coord": complete.COORDINATORS, "sub": complete.SUBORDINATORS, "ands": ["and"], "buts": ["but"]} | {w: [w] for w in rates}
    single = {k: _among([p for p in v if " " not in p]) for k, v in sets.items()}
    many = " + ".join(rf"len(regexp_extract_all({_ASCII.format('low')}, '\b{p}\b'))" for p in complete.SUBORDINATORS if " " in p)
    columns = {"coord_subord_ratio": "co / greatest(su, 1)", "and_but_ratio": "coalesce(ands, 0) / greatest(coalesce(buts, 0), 1)", "coord_conj_rate": "co / per_sent", "subord_conj_rate": "su / per_sent"}
    columns |= {f"{w}_rate": f"coalesce({w}, 0) / per_sent" for w in rates}
    return f"""with {BASE},
{_agg_cte("k", "runs", single)},
joined as (select *, coalesce(coord, 0) as co, coalesce(sub, 0) + {many} as su from b left join k using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _rhythm() -> str:
    columns = {
        "clause_length_mean": "cm",
        "clause_length_std": "cs",
        "autocorr": "ac",
        "sentence_complexity": "coalesce(cn, 0) / per_sent",
        "comma_density": f"{_count(',')} / (greatest(n_ws, 1) / 100)",
        "semicolon_rate": f"{_count(';')} / per_sent",
        "parenthetical_rate": f"({_count('(')} + {_count(')')}) / 2 / per_sent",
    }
    return rf"""with {BASE},
cl as (select doc_id, k, n from (select doc_id, k, len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> ''))::double as n from (select doc_id, unnest(p) as c, generate_subscripts(p, 1) as k from (select doc_id, regexp_split_to_array(text, '[,;]') as p from d))) where n > 0),
cs as (select doc_id, avg(n) as cm, stddev_pop(n) as cs, count(*)::double as cn from cl group by doc_id),
{_lag("cl", "lagged")},
joined as (select b.*, cm, cs.cs, cn, ac from b left join cs using (doc_id) left join lagged using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _lexical() -> str:
    columns = {
        "type_token_ratio": "v / n_alpha",
        "hapax_legomena_ratio": "n1 / n_alpha",
        "dis_legomena_ratio": "n2 / n_alpha",
        "avg_word_length": "len_mean",
        "word_length_std": "len_std",
        "word_length_cv": "len_std / len_mean",
        "syllable_ratio": "syl",
        "long_word_ratio": "long",
        "rare_word_ratio": "rare",
        "abstract_ratio": "abstract",
        "concrete_ratio": "1 - abstract",
        "formality_score": "0.5",
    }
    return f"""with {BASE},
cnt as (select doc_id, w, count(*) as c from aw group by all),
voc as (select doc_id, count(*)::double as v, sum((c = 1)::int)::double as n1, sum((c = 2)::int)::double as n2 from cnt group by doc_id),
each as (select doc_id, w, len(regexp_extract_all(w, '[aeiouy]+')) - (suffix(w, 'e'))::int + (regexp_matches(w, '[^aeiouy]le$'))::int as syl from aw),
word as (select doc_id, avg(case when syl = 0 then 1 else syl end) as syl, avg((len(w) > 6)::int) as long, avg((w not in ({_list(L.COMMON)}))::int) as rare, avg((regexp_matches(w, '{complete.ABSTRACT}'))::int) as abstract from each group by doc_id),
joined as (select * from b left join voc using (doc_id) left join word using (doc_id))
{_rounded(columns, "joined", "n_alpha > 0")}"""


def _epistemic() -> str:
    columns = {
        "hedge_density": "coalesce(n, 0) / per_sent",
        "hedge_clustering": "case when n > 1 and total > 0 then 2 * weighted / (n * total) - (n + 1) / n else 0 end",
        "hedge_position_bias": "bias",
        "confidence_mean": "1 - least(coalesce(n, 0) / per_sent, 1)",
        "confidence_variance": "0",
        "confidence_arc": "0",
    }
    return rf"""with {BASE},
t as (select doc_id, text, {_ASCII.format("low")} as plain from d),
cut as (select doc_id, string_split(regexp_replace(plain, '({stance.pattern(complete.HEDGES)})', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from t),
piece as (select doc_id, i, sum(len(x)) over (partition by doc_id order by i) - len(x) as start_at from (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as i from cut)),
hp as (select doc_id, start_at / len(text) as pos, row_number() over (partition by doc_id order by start_at) as r from piece join t using (doc_id) where i % 2 = 0),
hm as (select doc_id, count(*)::double as n, sum(pos) as total, sum(pos * r) as weighted, avg(pos) as bias from hp group by doc_id),
joined as (select * from b left join hm using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _transitions() -> str:
    single = {k: _among([p for p in v if p.isalpha()] or [""]) for k, v in complete.TRANSITIONS.items()}
    phrases = lambda v: "".join(rf" + len(regexp_extract_all({_ASCII.format('low')}, '\b{p.replace('.', '[.]')}\b'))" for p in v if not p.isalpha())
    columns = {f"{k}_rate": f"(coalesce({k}, 0){phrases(v)}) / per_sent" for k, v in complete.TRANSITIONS.items()}
    return f"""with {BASE},
{_agg_cte("k", "runs", single)},
joined as (select * from b left join k using (doc_id))
{_rounded(columns, "joined", "true")}"""


ORACLES = {"features_complete_punctuation": _punctuation(), "features_complete_structural": _structural(), "features_complete_connectors": _connectors(), "features_complete_rhythm": _rhythm(), "features_complete_lexical": _lexical(), "features_complete_epistemic": _epistemic(), "features_complete_transitions": _transitions()}
