"""Queries of the feature groups over ``documents`` and their SQL.

The SQL states every feature in relational form, rows of words and sentences
grouped by document, so it shares no logic with the array expressions.
"""

from __future__ import annotations

from lexiprint.operators import lexicons as L
from lexiprint.operators import layers, stance, style
from lexiprint.operators.registry import GROUPS, extract

DIGITS = 6


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


def _rounded(columns: dict[str, str], source: str, guard: str) -> str:
    inner = ",\n    ".join(f"round(case when {guard} then coalesce({v}, 0) else 0 end + 1e-10, {DIGITS}) as {k}" for k, v in columns.items())
    return f"select doc_id,\n    {inner}\nfrom {source}"


def _entropy(rows: str, key: str, name: str) -> str:
    """CTE ``name``: doc_id, h (bits), v (distinct), n of ``key`` in the rows; a document once."""
    return f"{name} as (select doc_id, case when count(*) > 1 then -sum(c / n * log2(c / n)) else 0 end as h, count(*) as v, max(n) as n, sum((c = 1)::int) as once from (select doc_id, c::double as c, sum(c) over (partition by doc_id) as n from (select doc_id, {key}, count(*) as c from {rows} group by all)) group by doc_id)"


BASE = r"""
d as (select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as low from documents),
aw as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as pos from (select doc_id, list_filter(regexp_extract_all(low, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) as w from d)),
ws as (select doc_id, unnest(w) as w from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from d)),
st as (select doc_id, unnest(s) as s, generate_subscripts(s, 1) as k from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from d)),
sl as (select doc_id, k, s, regexp_split_to_array(s, '\s+') as sw, len(regexp_split_to_array(s, '\s+'))::double as n from st),
pl as (select doc_id, len(regexp_split_to_array(p, '\s+'))::double as n from (select doc_id, regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^\s+|\s+$', '', 'g') as p from d) where p <> ''),
na as (select doc_id, count(*) as n_alpha, avg(len(w)) as len_mean, stddev_pop(len(w)) as len_std from aw group by doc_id),
nw as (select doc_id, count(*)::double as n_ws from ws group by doc_id),
ns as (select doc_id, count(*)::double as n_sents, avg(n) as sent_mean, stddev_pop(n) as sent_std, stddev_samp(n) as sent_samp from sl group by doc_id),
np as (select doc_id, count(*)::double as n_paras, avg(n) as para_mean, stddev_pop(n) as para_std, stddev_samp(n) as para_samp from pl group by doc_id),
b as (select d.*, coalesce(n_alpha, 0)::double as n_alpha, len_mean, len_std, coalesce(n_ws, 0) as n_ws, coalesce(n_sents, 0) as n_sents, greatest(coalesce(n_sents, 0), 1) as per_sent, sent_mean, sent_std, sent_samp, coalesce(n_paras, 0) as n_paras, para_mean, para_std, para_samp
    from d left join na using (doc_id) left join nw using (doc_id) left join ns using (doc_id) left join np using (doc_id)),
runs as (select doc_id, unnest(regexp_extract_all(low, '[\p{L}\p{N}_]+')) as w from d)"""


def _count(part: str, text: str = "text") -> str:
    quoted = part.replace("'", "''")
    return f"((len({text}) - len(replace({text}, '{quoted}', ''))) / {len(part)})"


def _matches(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, '(?i){p.replace(chr(39), chr(39) * 2)}'))" for p in patterns) + ")"


def _agg_cte(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} as (select doc_id, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {source} group by doc_id)"


def _among(words: list[str], column: str = "w") -> str:
    return f"sum(({column} in ({_list(words)}))::int)"


def _statistical() -> str:
    grams = "select doc_id, w as a, lead(w) over o as b, lead(w, 2) over o as c from aw window o as (partition by doc_id order by pos)"
    columns = {
        "entropy_char": "cc.h",
        "entropy_word": "wc.h",
        "entropy_bigram": "bc.h",
        "perplexity_approx": "case when wc.h > 0 then pow(2, wc.h) else 0 end",
        "redundancy_rate": "case when wc.v > 1 then 1 - wc.h / log2(wc.v) else 0 end",
        "repetition_rate": "repeated / greatest(n_alpha - 2, 1)",
        "burstiness_words": "gap_std / gap_mean",
        "zipf_coefficient": "case when wc.v >= 10 then abs(zipf) else 0 end",
        "yule_k": "10000 * (sq - n_alpha) / (n_alpha * n_alpha)",
        "simpson_d": "(sq - n_alpha) / (n_alpha * (n_alpha - 1))",
        "honore_r": "case when n1 > 0 and n1 < wc.v then 100 * ln(n_alpha) / (1 - n1 / wc.v) else 0 end",
        "sichel_s": "n2 / wc.v",
        "brunet_w": "pow(n_alpha, pow(wc.v, -0.165))",
    }
    return f"""with {BASE},
{_entropy("(select doc_id, unnest(string_split(low, '')) as ch from d)", "ch", "cc0")}, cc as (select * from cc0),
{_entropy("aw", "w", "wc")},
grams as ({grams}),
{_entropy("(select doc_id, a, b from grams where b is not null)", "a, b", "bc")},
tc as (select doc_id, sum((c > 1)::int)::double as repeated from (select doc_id, a, b, c as z, count(*) as c from grams where c is not null group by all) group by doc_id),
gaps as (select doc_id, avg(g) as gap_mean, stddev_pop(g) as gap_std from (select doc_id, pos - lag(pos) over (partition by doc_id, w order by pos) as g from aw) where g is not null group by doc_id),
cnt as (select doc_id, w, count(*)::double as c from aw group by all),
mom as (select doc_id, sum(c * c) as sq, sum((c = 1)::int)::double as n1, sum((c = 2)::int)::double as n2 from cnt group by doc_id),
zipf as (select doc_id, regr_slope(ln(c), ln(r)) as zipf from (select doc_id, c, row_number() over (partition by doc_id order by c desc)::double as r from cnt) where r <= 100 group by doc_id),
joined as (select b.doc_id, n_alpha, cc.h as cch, wc.h as wch, wc.v as wcv, bc.h as bch, repeated, gap_mean, gap_std, sq, n1, n2, zipf from b left join cc on cc.doc_id = b.doc_id left join wc on wc.doc_id = b.doc_id left join bc on bc.doc_id = b.doc_id left join tc on tc.doc_id = b.doc_id left join gaps on gaps.doc_id = b.doc_id left join mom on mom.doc_id = b.doc_id left join zipf on zipf.doc_id = b.doc_id)
{_rounded({k: v.replace("cc.h", "cch").replace("wc.h", "wch").replace("wc.v", "wcv").replace("bc.h", "bch") for k, v in columns.items()}, "joined", "n_alpha >= 10")}"""


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
        "concrete_ratio": "1 - abstract",
        "abstract_ratio": "abstract",
        "formality_score": "0.3 * (len_mean / 10) + 0.3 * long + 0.4 * abstract",
    }
    return f"""with {BASE},
cnt as (select doc_id, w, count(*) as c from aw group by all),
voc as (select doc_id, count(*)::double as v, sum((c = 1)::int)::double as n1, sum((c = 2)::int)::double as n2 from cnt group by doc_id),
each as (select doc_id, w, len(regexp_extract_all(w, '[aeiouy]+')) - (suffix(w, 'e'))::int + (regexp_matches(w, '[^aeiouy]le$'))::int as syl from aw),
word as (select doc_id, avg(case when syl = 0 then 1 else syl end) as syl, avg((len(w) > 6)::int) as long, avg((w not in ({_list(L.COMMON)}))::int) as rare, avg((regexp_matches(w, '(tion|ness|ity|ism|ment|ence|ance)$'))::int) as abstract from each group by doc_id),
joined as (select * from b left join voc using (doc_id) left join word using (doc_id))
{_rounded(columns, "joined", "n_alpha >= 10")}"""


FIRSTS = """f as (select doc_id, k, trim(lower(sw[1]), '"''') as first, trim(lower(sw[len(sw)]), '"''') as last, lower(sw[1]) as first_raw from sl)"""


def _structural() -> str:
    marks = r"len(regexp_extract_all(text, '(?:^|\n)\s*[-*•]\s|(?:^|\n)\s*\d+\.\s'))"
    trimmed = r"regexp_replace(l, '^\s+|\s+$', '', 'g')"
    columns = {
        "sentence_length_cv": "case when n_sents > 1 then sent_std / sent_mean else 0 end",
        "sentence_length_mean": "sent_mean",
        "sentence_length_std": "case when n_sents > 1 then sent_std else 0 end",
        "paragraph_length_cv": "case when n_paras > 1 then para_std / para_mean else 0 end",
        "paragraph_count_norm": "n_paras / (n_ws / 1000)",
        "list_marker_rate": f"{marks} / per_sent",
        "header_rate": "coalesce(headers, 0) / greatest(n_paras, 1)",
        "sentence_initial_entropy": "hf",
        "sentence_final_entropy": "hl",
        "quote_rate": "len(regexp_extract_all(text, '[\"''].*?[\"'']')) / per_sent",
    }
    return f"""with {BASE}, {FIRSTS},
{_entropy("f", "first", "ef")}, {_entropy("f", "last", "el")},
lines as (select doc_id, l, {trimmed} as t from (select doc_id, unnest(string_split(text, chr(10))) as l from d)),
heads as (select doc_id, count(*)::double as headers from lines where t <> '' and (starts_with(t, '#') or (len(regexp_split_to_array(t, '\\s+')) <= 8 and suffix(t, ':')) or (l = upper(l) and l <> lower(l))) group by doc_id),
joined as (select b.*, headers, ef.h as hf, el.h as hl from b left join heads using (doc_id) left join ef using (doc_id) left join el using (doc_id))
{_rounded(columns, "joined", "n_ws >= 10")}"""


def _punctuation() -> str:
    columns = {
        "question_rate": f"{_count('?')} / per_sent",
        "em_dash_rate": f"({_count('—')} + {_count('–')} + {_count('--')}) / per_sent",
        "semicolon_rate": f"{_count(';')} / per_sent",
        "exclamation_rate": f"{_count('!')} / per_sent",
        "ellipsis_rate": rf"({_count('…')} + len(regexp_extract_all(text, '\.{{3,}}'))) / per_sent",
        "parenthetical_rate": f"{_count('(')} / per_sent",
        "colon_rate": "colons / per_sent",
        "comma_density": f"100 * {_count(',')} / n_ws",
    }
    # no lookaround here: a colon counts by the characters around it
    return rf"""with {BASE},
around as (select doc_id, text, per_sent, n_ws, (select count(*) from (select unnest(generate_series(1, len(t.text))) as i) where t.text[i] = ':' and not (i > 1 and regexp_matches(t.text[i - 1], '[0-9]')) and not regexp_matches(substr(t.text, i + 1, 2), '^([0-9]|//)')) as colons from b t)
{_rounded(columns, "around", "n_ws >= 10")}"""


def _connectors() -> str:
    one = lambda *w: _among(list(w))
    columns = {
        "and_but_ratio": "case when buts > 0 then ands / buts when ands > 0 then ands * 2 else 1 end",
        "however_rate": "however / n_ws * 100",
        "therefore_rate": "therefore / n_ws * 100",
        "furthermore_rate": "furthermore / n_ws * 100",
        "because_rate": "because / n_ws * 100",
        "contrast_marker_density": f"(contrast + {_count('on the other hand', 'low')}) / n_ws * 100",
        "additive_density": "additive / n_ws * 100",
        "causal_density": f"(causal + {_count('as a result', 'low')} + {_count('due to', 'low')}) / n_ws * 100",
    }
    counts = {"ands": one("and"), "buts": one("but"), "however": one("however"), "therefore": one("therefore", "thus"), "furthermore": one("furthermore", "moreover", "additionally"), "because": one("because", "since"), "contrast": one(*L.CONTRASTIVE), "additive": one(*L.ADDITIVE), "causal": one(*L.CAUSAL)}
    return rf"""with {BASE},
clean as (select doc_id, regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g') as w from ws),
{_agg_cte("k", "clean", counts)},
joined as (select * from b left join k using (doc_id))
{_rounded(columns, "joined", "n_ws >= 10")}"""


def _phrases(name: str, phrases: list[str]) -> tuple[str, str]:
    """An aggregate over single words and an expression that adds phrases of several."""
    single, many = [p for p in phrases if " " not in p], [p for p in phrases if " " in p]
    return _among(single), f"(coalesce({name}, 0) + " + " + ".join(_count(p, "low") for p in many) + ")"


def _epistemic() -> str:
    sets = {"hed": L.HEDGES, "boo": L.BOOSTERS, "per": L.PERSONAL, "evi": L.EVIDENTIAL}
    parts = {k: _phrases(k, v) for k, v in sets.items()}
    columns = {
        "hedge_density": "h / n_ws * 100",
        "booster_density": "bo / n_ws * 100",
        "hedge_boost_ratio": "case when bo > 0 then h / bo when h > 0 then h * 2 else 1 end",
        "personal_marker_rate": "p / n_ws * 100",
        "evidential_rate": "e / n_ws * 100",
        "certainty_score": "case when h + bo > 0 then bo / (h + bo) else 0.5 end",
    }
    return f"""with {BASE},
{_agg_cte("k", "runs", {k: v[0] for k, v in parts.items()})},
joined as (select *, {parts["hed"][1]} as h, {parts["boo"][1]} as bo, {parts["per"][1]} as p, {parts["evi"][1]} as e from b left join k using (doc_id))
{_rounded(columns, "joined", "n_ws >= 10")}"""


def _transitions() -> str:
    opens = " + ".join(rf"len(regexp_extract_all(low, '(?:^|[.!?]\s+){p}'))" for p in L.AI_STARTERS)
    columns = {
        "transition_starter_rate": "starters / n_sents",
        "ai_starter_rate": f"({opens}) / n_sents",
        "human_starter_rate": "human / n_sents",
        "starter_diversity": "v / n_sents",
        "first_word_entropy": "case when v > 1 then h / log2(v) else 0 end",
        "explicit_transition_rate": "starters / n_sents",
    }
    return f"""with {BASE}, {FIRSTS}, {_entropy("f", "first", "ef")},
{_agg_cte("k", "f", {"starters": _among(L.TRANSITION_STARTERS, "first"), "human": _among(L.HUMAN_STARTERS, "first")})},
joined as (select b.*, h, v, starters, human from b left join ef using (doc_id) left join k using (doc_id))
{_rounded(columns, "joined", "n_sents >= 3")}"""


def _lag(rows: str, name: str) -> str:
    """CTE: lag-1 autocorrelation of n in order k by covariance over n - 1 and variance over n."""
    return f"{name} as (select doc_id, case when max(m) > 2 and max(v) > 1e-9 then sum((n - mu) * (nxt - mu)) / (max(m) - 1) / max(v) else 0 end as ac from (select doc_id, n, lead(n) over (partition by doc_id order by k) as nxt, avg(n) over (partition by doc_id) as mu, var_pop(n) over (partition by doc_id) as v, count(*) over (partition by doc_id) as m from {rows}) group by doc_id)"


def _rhythm() -> str:
    columns = {
        "clause_length_mean": "cm",
        "clause_length_std": "cs",
        "clause_rhythm_autocorr": "ac",
        "sentence_complexity": "cn / per_sent",
        "comma_density": f"{_count(',')} / (n_ws / 100)",
        "semicolon_rate": f"{_count(';')} / per_sent",
        "parenthetical_rate": f"({_count('(')} + {_count(')')}) / 2 / per_sent",
    }
    return rf"""with {BASE},
cl as (select doc_id, k, n from (select doc_id, k, len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> ''))::double as n from (select doc_id, unnest(p) as c, generate_subscripts(p, 1) as k from (select doc_id, regexp_split_to_array(text, '[,;]') as p from d))) where n > 1),
cs as (select doc_id, avg(n) as cm, stddev_pop(n) as cs, count(*)::double as cn from cl group by doc_id),
{_lag("cl", "lagged")},
joined as (select b.*, cm, cs.cs, cn, ac from b left join cs using (doc_id) left join lagged using (doc_id))
{_rounded(columns, "joined", "n_ws >= 10")}"""


def _lightweight() -> str:
    columns = {
        "sentence_length_cv": "case when n_sents > 1 then sent_samp / sent_mean else 0 end",
        "paragraph_length_cv": "case when n_paras > 1 then para_samp / para_mean else 0 end",
        "type_token_ratio": "wv / n_ws",
        "list_marker_rate": r"len(regexp_extract_all(text, '(?:^|\n)\s*(?:\d+[.)]|[-*•])\s')) / n_ws",
        "hapax_legomena_ratio": "w1 / wv",
        "sentence_initial_entropy": "case when fv > 1 then fh / log2(fv) else 0 end",
        "avg_word_length": "letters",
        "punctuation_diversity": "(" + " + ".join(f"(contains(text, '{c.replace(chr(39), chr(39) * 2)}'))::int" for c in L.PUNCTUATION) + ") / 15",
        "question_ratio": f"case when n_sents > 0 then {_count('?')} / n_sents else 0 end",
    }
    return rf"""with {BASE}, {FIRSTS}, {_entropy("f", "first_raw", "ef")},
{_entropy("(select doc_id, lower(w) as w from ws)", "w", "ew")},
lt as (select doc_id, avg(len(w)) as letters from ws where regexp_full_match(w, '\p{{L}}+') group by doc_id),
joined as (select b.*, ew.v as wv, ew.once as w1, ef.h as fh, ef.v as fv, letters from b left join ew using (doc_id) left join ef using (doc_id) left join lt using (doc_id))
{_rounded(columns, "joined", "n_ws >= 5")}"""


def _alignment() -> str:
    # word boundaries here are those of ASCII, so other letters are turned into one more word character
    plain = lambda c: f"regexp_replace({c}, '[À-ÖØ-öø-ɏͰ-῿]', '_', 'g')"
    typos = [p for p in L.TYPO_PATTERNS if r"\1" not in p] + [r"\b\w*(?:" + "|".join(f"{c}{{4,}}" for c in "abcdefghijklmnopqrstuvwxyz") + r")\w*\b"]
    columns = {
        "benevolence_score": f"least(({_matches('t', L.BENEVOLENT_PATTERNS)} + 0.3 * {_matches('t', L.HEDGE_PATTERNS)}) / per_sent, 2)",
        "neutrality_bias": f"least(100 * {_matches('t', L.NEUTRALITY_PATTERNS)} / n_alpha, 5)",
        "moralizing_coda": "0.4 * least(moral / per_sent, 1) + 0.6 * case when moral > 0 then coda / moral else 0 end",
        "syllogism_stability": "case when prem > 0 and conc > 0 then least(prem, conc) / greatest(prem, conc) * least((prem + conc) / per_sent, 1) else 0 end",
        "sycophancy_index": f"least({_matches('t', L.SYCOPHANCY_PATTERNS)} / per_sent, 2)",
        "lexical_tellscore": "least(100 * tells / n_alpha, 10)",
        "uniformity_score": "case when n_sents < 3 then 0.5 else 0.5 * greatest(0, 1 - sent_std / sent_mean) + 0.2 * greatest(0, 1 - 2 * len_std / len_mean) + 0.3 * (1 - v / n_sents) end",
        "imperfection_absence": f"greatest(0, least(1, 1 - 100 * ({_matches('raw', L.HUMAN_PATTERNS)} + {_matches('raw', typos)}) / n_alpha / 5))",
    }
    return f"""with {BASE}, {FIRSTS}, {_entropy("f", "first_raw", "ef")},
{_agg_cte("k", "aw", {"tells": f"2.0 * {_among(L.TELLS_STRONG)} + 0.5 * {_among(L.TELLS_MEDIUM)}"})},
texts as (select *, {plain("low")} as t, {plain("text")} as raw, {plain("lower(substr(text, cast(floor(len(text) * 0.75) as int) + 1))")} as tail from b left join ef using (doc_id) left join k using (doc_id)),
joined as (select *, {_matches("t", L.MORALIZING_PATTERNS)} as moral, {_matches("tail", L.MORALIZING_PATTERNS)} as coda, {_matches("t", L.PREMISE_PATTERNS)} as prem, {_matches("t", L.CONCLUSION_PATTERNS)} as conc from texts)
{_rounded(columns, "joined", "len(text) >= 50 and n_alpha >= 10")}"""


def _noise() -> str:
    repeats = "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyz")
    columns = {
        "idiosyncrasy_rate": "0.7 * rare / n_alpha + 0.3 * odd / n_alpha",
        "formatting_entropy": "0.3 * least(coalesce(gh, 0) / 2, 1) + 0.3 * least(coalesce(mh, 0) / 3, 1) + 0.2 * ((contains(text, ''''))::int + 2 * (contains(text, '\"'))::int) / 3 + 0.2 * least(coalesce(eh, 0) / 1.5, 1)",
        "dead_end_rate": "0.6 * coalesce(n1 / nv, 0) + 0.4 * coalesce(c1 / cv, 0)",
    }
    return rf"""with {BASE},
{_agg_cte("k", "aw", {"rare": f"sum((len(w) > 2 and w not in ({_list(style.COMMON)}))::int)", "odd": f"sum((len(w) > 15)::int) + sum((regexp_matches(w, 'q[^u]|[^aeiou]{{5,}}|{repeats}'))::int)"})},
{_entropy("(select doc_id, len(unnest(regexp_extract_all(text, '[ \t]+'))) as r from d)", "r", "eg")},
{_entropy("(select doc_id, unnest(regexp_extract_all(text, '[.,;:!?''\"()\\[\\]{}]+')) as r from d)", "r", "em")},
{_entropy("(select doc_id, unnest(regexp_extract_all(text, '[.!?]+')) as r from d)", "r", "ee")},
nm as (select doc_id, regexp_replace(unnest(sw[2:]), '[^\p{{L}}\p{{N}}_]', '', 'g') as w from sl),
{_entropy("(select doc_id, lower(w) as w from nm where len(w) > 1 and w[1] = upper(w[1]) and w[1] <> lower(w[1]))", "w", "en")},
{_entropy(f"(select doc_id, w from aw where len(w) >= 4 and w not in ({_list(style.COMMON)}))", "w", "ec")},
joined as (select b.*, rare, odd, eg.h as gh, em.h as mh, ee.h as eh, en.once as n1, en.v as nv, ec.once as c1, ec.v as cv from b left join k using (doc_id) left join eg using (doc_id) left join em using (doc_id) left join ee using (doc_id) left join en using (doc_id) left join ec using (doc_id))
{_rounded(columns, "joined", "len(text) >= 100 and n_alpha >= 20")}"""


def _tokenization() -> str:
    found = " + ".join(f"(contains(low, '{g.lower()}'))::int" for g in L.GLITCHES)
    columns = {"token_fragmentation": "0.5", "strange_token_split": "0.5", "whitespace_token_bias": "0.5", "glitch_token_sensitivity": f"greatest(0, 1 - 0.2 * ({found}))"}
    return rf"""with d as (select doc_id, coalesce(text, '') as text, lower(coalesce(text, '')) as low from documents),
joined as (select *, len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) as n from d)
{_rounded(columns, "joined", "len(text) >= 50 and n >= 10")}"""


def _echo() -> str:
    names = {"phonetic": "p", "structural": "s", "overall": "o"}
    columns = {f"{n}_{f}": f"{c}_{f}" for n, c in names.items() for f in ("mean", "std", "max")}
    columns |= {"geometric_mean": "geo", "echo_burstiness": "case when o_mean > 0 then o_std / o_mean else 0 end"}
    aggregates = ", ".join(f"avg({'x' if c == 'o' else f'case when kind = {chr(39)}{c}{chr(39)} then x end'}) as {c}_mean, stddev_pop({'x' if c == 'o' else f'case when kind = {chr(39)}{c}{chr(39)} then x end'}) as {c}_std, max({'x' if c == 'o' else f'case when kind = {chr(39)}{c}{chr(39)} then x end'}) as {c}_max" for c in names.values())
    return rf"""with {BASE},
ends as (select doc_id, k, n, list_distinct(list_transform(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')), lambda x: right(x, 3))) as e from sl),
pairs as (select doc_id, e, lead(e) over o as e2, n, lead(n) over o as n2 from ends window o as (partition by doc_id order by k)),
scores as (
    select doc_id, 'p' as kind, len(list_intersect(e, e2)) / len(list_distinct(list_concat(e, e2))) as x from pairs where len(e) > 0 and len(e2) > 0
    union all select doc_id, 's', 1 - abs(n - n2) / greatest(n + n2, 1) from pairs where n2 is not null),
k as (select doc_id, {aggregates}, exp(avg(ln(greatest(x, 1e-8)))) as geo from scores group by doc_id),
joined as (select * from b left join k using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _dynamics() -> str:
    columns = {
        "perplexity_slope": "greatest(-1, least(1, ps))",
        "lexical_density_drift": "least(5 * dd, 1)",
        "sentence_length_autocorr": "greatest(0, least(1, (coalesce(ac, 0) + 1) / 2))",
        "entropy_impulse_response": "case when n_alpha >= 100 and h4 > 0 then 1 - (case when h0 >= 0.9 * h4 then 0 when h1 >= 0.9 * h4 then 1 when h2 >= 0.9 * h4 then 2 when h3 >= 0.9 * h4 then 3 else 4 end) / 4 else 0 end",
    }
    heads = ",\n".join(_entropy(f"(select doc_id, w from aw join na using (doc_id) where pos <= floor(n_alpha * {p}))", "w", f"e{i}") + f", p{i} as (select doc_id, case when v > 1 then h / log2(v) else 0 end as h{i} from e{i})" for i, p in enumerate((0.1, 0.25, 0.5, 0.75, 1.0)))
    return f"""with {BASE},
ch as (select doc_id, w, least((pos - 1) // greatest(n_alpha // 5, 1), 4) as c from aw join na using (doc_id)),
ce as (select doc_id, c, -sum(p * log2(p)) as h from (select doc_id, c, count(*) / sum(count(*)) over (partition by doc_id, c) as p from ch group by doc_id, c, w) group by doc_id, c),
slope as (select doc_id, regr_slope(h, c) as ps from ce group by doc_id),
dens as (select doc_id, stddev_pop(x) as dd from (select doc_id, c, avg((w not in ({_list(L.FUNCTION_WORDS)}))::int) as x from ch group by doc_id, c) group by doc_id),
{_lag("sl", "lagged")},
{heads},
joined as (select * from b left join slope using (doc_id) left join dens using (doc_id) left join lagged using (doc_id) left join p0 using (doc_id) left join p1 using (doc_id) left join p2 using (doc_id) left join p3 using (doc_id) left join p4 using (doc_id))
{_rounded(columns, "joined", "len(text) >= 200 and n_alpha >= 50 and n_sents >= 5")}"""


def _fractal() -> str:
    columns = {
        "hurst_exponent": "coalesce(hurst, 0.5)",
        "multifractal_spectrum": "case when n_sents >= 10 and vn >= 2 then least(coalesce(mf, 0), 1) else 0.5 end",
        "topic_decay_rate": "case when cn >= 20 then 1 - stay else 0.5 end",
    }
    return f"""with recursive {BASE},
win(w) as (select 10 union all select w * 3 // 2 from win where w < 100000000),
part as (select doc_id, win.w, pos, len(aw.w) - avg(len(aw.w)) over (partition by doc_id, win.w) as x from aw join na using (doc_id) join win on win.w <= n_alpha // 2 and pos <= win.w),
cum as (select doc_id, w, x, sum(x) over (partition by doc_id, w order by pos) as s from part),
rs as (select doc_id, w, (max(s) - min(s)) / case when sum(x * x) > 0 then sqrt(sum(x * x) / w) else 1e-10 end as r from cum group by doc_id, w),
hu as (select doc_id, case when count(*) >= 3 then greatest(0, least(1, regr_slope(ln(r), ln(w)))) end as hurst from rs where r > 0 group by doc_id),
scales as (select doc_id, z, var_pop(t) as v from (select doc_id, z, sum(n) as t from sl join ns using (doc_id), (values (1), (2), (4)) as scale(z) where k <= (n_sents::int // z) * z group by doc_id, z, (k - 1) // z) group by doc_id, z having count(*) >= 2),
mf as (select doc_id, count(*) as vn, stddev_pop(y) / nullif(avg(y), 0) as mf from (select doc_id, case when max(v) over (partition by doc_id) > 0 then v / max(v) over (partition by doc_id) else 0 end as y from scales) group by doc_id),
lw as (select doc_id, w, row_number() over (partition by doc_id order by pos) as i, count(*) over (partition by doc_id) // 3 as third, count(*) over (partition by doc_id) as cn from aw where len(w) >= 5),
words as (select doc_id, w, max(cn) as cn, bool_or(i <= third) as a, bool_or(i > third and i <= 2 * third) as m, bool_or(i > 2 * third) as z from lw group by doc_id, w),
td as (select doc_id, max(cn) as cn, (count(*) filter (a and m) + count(*) filter (a and z)) / nullif(count(*) filter (a), 0) / 2 as stay from words group by doc_id),
joined as (select * from b left join hu using (doc_id) left join mf using (doc_id) left join td using (doc_id))
{_rounded(columns, "joined", "len(text) >= 200 and n_alpha >= 50")}"""


def _plain(titles: str, more: str = "") -> str:
    """Sentences that end in a mark and white space, without lookbehind: a sentinel stands behind each end."""
    kept = rf"regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])({titles})\.\s', '\1\2' || chr(1) || ' ', 'g')"
    if more:
        kept = rf"regexp_replace({kept}, '(^|[^\p{{L}}\p{{N}}_])({more})\.\s', '\1\2' || chr(1) || ' ', 'g')"
    return rf"select doc_id, k, s, len(regexp_split_to_array(s, '\s+'))::double as n from (select doc_id, k, regexp_replace(replace(s, chr(1), '.'), '^\s+|\s+$', '', 'g') as s from (select doc_id, unnest(p) as s, generate_subscripts(p, 1) as k from (select doc_id, string_split(regexp_replace({kept}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) as p from d))) where s <> ''"


def _layer_e() -> str:
    columns = {
        "sentence_length_cv": "case when es > 1 then ed / em else 0 end",
        "paragraph_length_cv": "case when pn > 1 then pd / pm else 0 end",
        "type_token_ratio": "case when n_alpha > 0 then v / n_alpha else 0 end",
        "list_marker_rate": r"len(regexp_extract_all(text, '(?m)^[\s]*[-*•]\s|^\s*\d+\.\s')) / len(string_split(text, chr(10)))",
        "hapax_legomena_ratio": "n1 / v",
        "sentence_initial_entropy": "eh",
        "avg_word_length": "len_mean",
        "punctuation_diversity": "(" + " + ".join(f"(contains(text, '{c.replace(chr(39), chr(39) * 2)}'))::int" for c in layers.MARKS) + f") / {len(layers.MARKS)}",
        "question_ratio": f"{_count('?')} / es",
    }
    return rf"""with {BASE},
se as ({_plain("Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Jr|Sr|vs")}),
e1 as (select doc_id, count(*)::double as es, avg(n) as em, stddev_pop(n) as ed from se group by doc_id),
{_entropy(r"(select doc_id, lower(regexp_split_to_array(s, '\s+')[1]) as f from se)", "f", "ef")},
pe as (select doc_id, count(*)::double as pn, avg(n) as pm, stddev_pop(n) as pd from (select doc_id, len(regexp_split_to_array(p, '\s+'))::double as n from (select doc_id, regexp_replace(unnest(regexp_split_to_array(text, '\n\s*\n|\n{{2,}}')), '^\s+|\s+$', '', 'g') as p from d) where p <> '') group by doc_id),
voc as (select doc_id, count(*)::double as v, sum((c = 1)::int)::double as n1 from (select doc_id, w, count(*) as c from aw group by all) group by doc_id),
joined as (select b.*, es, em, ed, ef.h as eh, pn, pm, pd, voc.v as v, n1 from b left join e1 using (doc_id) left join ef using (doc_id) left join pe using (doc_id) left join voc using (doc_id))
{_rounded(columns, "joined", "coalesce(es, 0) >= 2")}"""


def _layer_b() -> str:
    names = {"phonetic": "p", "structural": "s", "semantic": "m", "overall": "o"}
    columns = {f"{n}_{f}": f"{c}_{f}" for n, c in names.items() for f in ("mean", "std", "max")}
    columns |= {"geometric_mean": "geo", "cooccurrence_rate": "0", "burstiness": "case when o_mean > 0 then o_std / o_mean else 0 end"}
    aggregates = ", ".join(f"avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std, max({c}) as {c}_max" for c in names.values())
    beats = lambda w: f"greatest(len(regexp_extract_all(lower({w}), '[aeiou]+')), 1)"
    return rf"""with {BASE},
pr as (select doc_id, k, n, lead(n) over o as n2, {beats("sw[len(sw)]")} as e, lead({beats("sw[1]")}) over o as st2, list_distinct(list_transform(sw, lambda x: lower(x))) as w, lead(list_distinct(list_transform(sw, lambda x: lower(x)))) over o as w2 from sl window o as (partition by doc_id order by k)),
sc as (select doc_id, 1 - abs(e - st2) / greatest(e, st2) as p, least(n, n2) / greatest(n, n2) as s, len(list_intersect(w, w2)) / len(list_distinct(list_concat(w, w2))) as m from pr where n2 is not null),
k as (select doc_id, {aggregates}, avg(pow(greatest(p * s * m, 0.001), 1.0::double / 3)) as geo from (select *, (p + s + m) / 3 as o from sc) group by doc_id),
joined as (select * from b left join k using (doc_id))
{_rounded(columns, "joined", "n_sents >= 2")}"""


def _layer_d() -> str:
    columns = {
        "clause_length_mean": "cm",
        "clause_length_std": "cs",
        "clause_rhythm_autocorr": "ac",
        "sentence_complexity": "cn / sn",
        "comma_density": f"{_count(',')} / n_ws * 100",
        "semicolon_rate": f"{_count(';')} / sn",
        "parenthetical_rate": f"({_count('(')} + {_count('—')} + {_count('–')}) / sn",
    }
    # cuts that keep the mark before them get a sentinel first
    cut = r"string_split(regexp_replace(regexp_replace(s, '([,;:])\s+', '\1' || chr(2), 'g'), '(?i)\s*[—–]\s*|\s+(?:but|and|or|yet|so|because|although|while|if|when|since|unless)\s+', chr(2), 'g'), chr(2))"
    return rf"""with {BASE},
sd as ({_plain("Mr|Mrs|Ms|Dr|Prof|Sr|Jr", "e[.]g|i[.]e|etc")}),
cut as (select doc_id, k, n, list_filter(list_transform({cut}, lambda c: len(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> ''))), lambda x: x >= 2) as c from sd),
cl as (select doc_id, k * 1000000 + i as k, c::double as n from (select doc_id, k, unnest(case when len(c) > 0 then c else [n::bigint] end) as c, generate_subscripts(case when len(c) > 0 then c else [n::bigint] end, 1) as i from cut)),
sn as (select doc_id, count(*)::double as sn from sd group by doc_id),
cs as (select doc_id, avg(n) as cm, stddev_pop(n) as cs, count(*)::double as cn from cl group by doc_id),
lagged as (select doc_id, case when max(m) > 2 and max(v) > 1e-9 then sum((n - mu) * (nxt - mu)) / max(v * m) else 0 end as ac from (select doc_id, n, lead(n) over (partition by doc_id order by k) as nxt, avg(n) over (partition by doc_id) as mu, var_pop(n) over (partition by doc_id) as v, count(*) over (partition by doc_id) as m from cl) group by doc_id),
joined as (select b.*, cm, cs.cs, cn, ac, sn from b left join sn using (doc_id) left join cs using (doc_id) left join lagged using (doc_id))
{_rounded(columns, "joined", "n_ws >= 10 and cn > 0")}"""


def _version_two() -> str:
    columns = {
        "hapax_rate": "n1 / n_alpha",
        "sentence_initial_entropy": "case when n_sents >= 2 then fh / log2(n_sents) else 0 end",
        "function_word_cv": "fs / nullif(fm, 0)",
        "punctuation_entropy": "case when mn >= 5 then mh else 0 end",
        "paragraph_length_cv": "case when n_paras < 2 then case when ln > 1 then ld / lm else 0 end else para_std / para_mean end",
        "sentence_length_cv": "case when n_sents > 1 then sent_std / sent_mean else 0 end",
        "list_marker_rate": "listed / lines",
        "type_token_ratio": "v / n_alpha",
        "em_dash_rate": f"case when n_ws > 0 then ({_count('—')} + {_count('--')} + {_count('–')}) / n_ws * 100 else 0 end",
    }
    return rf"""with {BASE}, {FIRSTS}, {_entropy("f", "first_raw", "ef")},
{_entropy(f"(select doc_id, unnest(regexp_extract_all(text, '{layers.V_MARKS.replace(chr(39), chr(39) * 2)}')) as m from d)", "m", "em")},
voc as (select doc_id, count(*)::double as v, sum((c = 1)::int)::double as n1 from (select doc_id, w, count(*) as c from aw group by all) group by doc_id),
fw as (select unnest([{", ".join(f"'{w}'" for w in layers.V_FUNCTION_WORDS)}]) as w),
fc as (select doc_id, avg(c) as fm, stddev_pop(c) as fs from (select d.doc_id, fw.w, coalesce(x.c, 0)::double as c from d cross join fw left join (select doc_id, w, count(*) as c from aw group by all) x on x.doc_id = d.doc_id and x.w = fw.w) group by doc_id),
li as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as l from d),
lc as (select doc_id, count(*)::double as lines, sum((regexp_matches(l, '^([-*•]|\d+[.)])'))::int)::double as listed from li group by doc_id),
lp as (select doc_id, count(*)::double as ln, avg(n) as lm, stddev_pop(n) as ld from (select doc_id, len(regexp_split_to_array(l, '\s+'))::double as n from li where l <> '') group by doc_id),
joined as (select b.*, ef.h as fh, em.h as mh, em.n as mn, voc.v as v, n1, fm, fs, lines, listed, ln, lm, ld from b left join ef using (doc_id) left join em using (doc_id) left join voc using (doc_id) left join fc using (doc_id) left join lc using (doc_id) left join lp using (doc_id))
{_rounded(columns, "joined", "true")}"""


def _micro() -> str:
    words = ("and", "but", "or", "because", "although", "while", "if")
    first = {w: rf"len(regexp_extract_all(low, '(?:^|\. ){w}[,\s]'))" for w in layers.INITIAL}
    marks = {"semicolon": _count(";"), "colon": _count(":"), "em_dash": f"({_count('—')} + {_count('--')})", "parenthetical": _count("("), "ellipsis": f"({_count('...')} + {_count('…')})", "exclamation": _count("!"), "question": _count("?")}
    columns = {f"conn_{w}_rate": f"coalesce(c_{w}, 0) / s" for w in words}
    columns |= {f"trans_{w}_rate": f"{first[w]} / s" for w in layers.INITIAL[:6]}
    columns |= {"trans_initial_total_rate": f"({' + '.join(first.values())}) / s", "conn_and_but_ratio": "coalesce(c_and, 0) / (coalesce(c_but, 0) + 1)", "conn_coord_subord_ratio": "coalesce(c_and + c_but + c_or, 0) / (coalesce(c_because + c_although + c_while + c_if, 0) + 1)"}
    columns |= {f"punct_{k}_rate": f"{v} / s" for k, v in marks.items()}
    columns |= {f"punct_{k}_per_100": f"{marks[k]} / greatest(n_ws, 100) * 100" for k in ("semicolon", "em_dash")}
    return f"""with {BASE},
{_agg_cte("k", "runs", {f"c_{w}": _among([w]) for w in words})},
joined as (select *, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) as s from b left join k using (doc_id))
{_rounded(columns, "joined", "true")}"""


_ASCII = "regexp_replace({}, '[À-ÖØ-öø-ɏͰ-῿]', '_', 'g')"


def _layer_c1() -> str:
    quoted = lambda v: stance.pattern(v).replace("'", "''")
    cuts = " union all ".join(rf"select doc_id, {i} as cat, string_split(regexp_replace(plain, '({quoted(v)})', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from t" for i, v in enumerate(stance.HEDGES.values()))
    hits = lambda v: f"len(regexp_extract_all(s, '{quoted(v)}'))"
    columns = {
        "hedge_density": "coalesce(hn, 0) / n_ws * 100",
        "hedge_clustering": "case when hn >= 2 then least((10 * sq / hn - hn) / (hn * 9), 1) else 0 end",
        "hedge_position_bias": "coalesce(bias, 0.5)",
        "confidence_mean": "coalesce(cm, 0.5)",
        "confidence_variance": "case when cn > 1 then cv else 0 end",
        "confidence_arc": "case when cn >= 3 then greatest(-1, least(1, slope * cn / 2)) else 0 end",
    }
    few = {k: (0.5 if k in ("hedge_position_bias", "confidence_mean") else 0) for k in columns}
    inner = ", ".join(f"round(case when n_ws >= 5 then coalesce({v}, 0) else {few[k]} end + 1e-10, {DIGITS}) as {k}" for k, v in columns.items())
    return rf"""with {BASE},
t as (select doc_id, text, {_ASCII.format("low")} as plain from d),
cut as ({cuts}),
piece as (select doc_id, cat, i, sum(len(x)) over (partition by doc_id, cat order by i) - len(x) as start_at from (select doc_id, cat, unnest(p) as x, generate_subscripts(p, 1) as i from cut)),
hp as (select doc_id, start_at / len(text) as pos from piece join t using (doc_id) where i % 2 = 0),
hb as (select doc_id, sum(c) as hn, sum(c * c) as sq from (select doc_id, least(floor(pos * 10), 9) as bin, count(*)::double as c from hp group by all) group by doc_id),
hm as (select doc_id, avg(pos) as bias from hp group by doc_id),
se as (select doc_id, s, row_number() over (partition by doc_id order by k) - 1 as i from (select doc_id, unnest(p) as s, generate_subscripts(p, 1) as k from (select doc_id, string_split(regexp_replace(plain, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) as p from t)) where regexp_replace(s, '\s', '', 'g') <> ''),
sc as (select doc_id, i, {hits(stance.CONFIDENCE["high"])} as a, {hits(stance.CONFIDENCE["medium"])} as b, {hits(stance.CONFIDENCE["low"])} as c, {" + ".join(hits(v) for v in stance.HEDGES.values())} as h from se),
sv as (select doc_id, i, case when a + b + c + h > 0 then greatest(0, least(1, (a + 0.6 * b + 0.3 * c - 0.3 * h) / (a + b + c + h))) else 0.5 end::double as x from sc),
ca as (select doc_id, count(*) as cn, avg(x) as cm, var_pop(x) as cv, regr_slope(x, i) as slope from sv group by doc_id),
joined as (select * from b left join hb using (doc_id) left join hm using (doc_id) left join ca using (doc_id))
select doc_id, {inner} from joined"""


def _layer_c2() -> str:
    moved = "plain"
    for k, v in enumerate(stance.TRANSITIONS.values()):
        moved = f"regexp_replace({moved}, '{stance.pattern(v, longest_first=True).replace(chr(39), chr(39) * 2)}', chr({0xE000 + k}), 'g')"
    names = list(stance.TRANSITIONS)
    columns = {f"{n}_rate": f"case when n > 0 then n{k} / n else 0 end" for k, n in enumerate(names)}
    columns |= {"transition_density": "n / n_ws * 100", "flow_entropy": "h"}
    return rf"""with {BASE},
t as (select doc_id, {_ASCII.format("low")} as plain from d),
mv as (select doc_id, unnest(m) as m, generate_subscripts(m, 1) as i from (select doc_id, regexp_extract_all({moved}, '[' || chr({0xE000}) || '-' || chr({0xE000 + len(names) - 1}) || ']') as m from t)),
mc as (select doc_id, count(*)::double as n, {", ".join(f"sum((m = chr({0xE000 + k}))::int)::double as n{k}" for k in range(len(names)))} from mv group by doc_id),
{_entropy("(select doc_id, a, b from (select doc_id, m as a, lead(m) over (partition by doc_id order by i) as b from mv) where b is not null)", "a, b", "fe")},
joined as (select b.*, mc.* exclude (doc_id), fe.h as h from b left join mc using (doc_id) left join fe using (doc_id))
{_rounded(columns, "joined", "n_ws >= 10")}"""


_SQL = {"statistical": _statistical, "lexical": _lexical, "structural": _structural, "punctuation": _punctuation, "connectors": _connectors, "epistemic": _epistemic, "transitions": _transitions, "rhythm": _rhythm, "lightweight": _lightweight, "alignment": _alignment, "noise": _noise, "tokenization": _tokenization, "echo": _echo, "dynamics": _dynamics, "fractal": _fractal, "layer_e": _layer_e, "layer_b": _layer_b, "layer_c1": _layer_c1, "layer_c2": _layer_c2, "layer_d": _layer_d, "version_two": _version_two, "micro": _micro}


def _query(group: str):
    return lambda spark, sf_dir: extract(spark.read.parquet(f"{sf_dir}/documents.parquet"), [group], namespaced=False, digits=DIGITS)


QUERIES = {f"features_{g}": _query(g) for g in GROUPS if not g.startswith("complete_")}
ORACLES = {f"features_{g}": make() for g, make in _SQL.items()}
