"""Queries of corpus preparation over ``documents``, ``conversations`` and ``pages``, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import corpus as C
from lexiprint.operators import layers
from lexiprint.operators.registry import extract
from lexiprint.plans.models import rounded


def _docs(build):
    return lambda spark, sf_dir: rounded(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {
    "corpus_derived": _docs(C.derived),
    "corpus_validate": _docs(C.validate),
    "corpus_dedup": _docs(lambda d: C.exact_dedup(d).select("doc_id", "source")),
    "corpus_quota": _docs(lambda d: C.quota(d.select("doc_id", "source"), "source", 25)),
    "corpus_split": _docs(lambda d: C.split(d.select("doc_id", "source"), "source")),
    "corpus_counts": _docs(lambda d: C.counts_by(d, "source", "lang")),
    "corpus_pseudonyms": _docs(lambda d: d.select("doc_id", C.pseudonym(F.col("source")).alias("author"))),
    "arena_answers": lambda spark, sf_dir: C.answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "clean_markdown": _docs(lambda d: d.select("doc_id", C.cleaned(T.text_of("text"), C.MARKDOWN).alias("text"))),
    "clean_bbcode": _docs(lambda d: d.select("doc_id", C.cleaned(T.text_of("text"), C.BBCODE).alias("text"))),
    "clean_html": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C.cleaned(T.text_of("html"), C.HTML).alias("text")),
    "classify_light": _docs(lambda d: layers.classify_light(extract(d, ["layer_e", "layer_e_compression"], namespaced=False))),
    "classify_signals": _docs(lambda d: layers.signals(extract(d, ["layer_e"], namespaced=False, digits=6))),
}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_DERIVED = rf"""w as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
g as (select doc_id, count(distinct a || ' ' || b || ' ' || c) as distinct_grams, count(*) as grams from (select doc_id, x as a, lead(x) over o as b, lead(x, 2) over o as c from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w) window o as (partition by doc_id order by i)) where c is not null group by doc_id),
dv as (select doc_id, len(w) as words, len(regexp_extract_all(text, '[.!?]')) as ends, len(text) as chars, substr(sha256(array_to_string(w, ' ')), 1, 16) as content_hash, coalesce(1 - distinct_grams / grams, 0) as repetition from w left join g using (doc_id))"""


def _clean(rules: list[tuple[str, str]], column: str) -> str:
    out = f"coalesce({column}, '')"
    for pattern, new in rules:
        new = new.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


def _light_sql() -> str:
    from lexiprint.plans.features import ORACLES as features

    rows = " union all ".join(f"select doc_id, '{k}' as feature, {k} as value, ({k} - {h}) / ({a} - {h}) as p from f" for k, (h, a, _) in layers.REFERENCE.items() if k != "compression_ratio")
    return f"with f as ({features['features_layer_e']}), r as ({rows}) select doc_id, feature, value, case when p < 0.3 then 'human' when p > 0.7 then 'ai' else 'neutral' end as signal from r"


ORACLES = {
    "corpus_derived": f"with {_DERIVED} select doc_id, words, ends, chars, content_hash, round(repetition + 1e-10, 6) as repetition from dv",
    "corpus_validate": f"with {_DERIVED} select doc_id, case when chars < 100 then 'short' when chars > 50000 then 'long' when words < 20 then 'few words' when repetition > 0.3 then 'repetitive' end as reason from dv",
    "corpus_dedup": f"with h as (select doc_id, source, {_WORDS} as w from documents) select doc_id, source from h where doc_id in (select min(doc_id) from h group by w)",
    "corpus_quota": "select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 25",
    "corpus_split": """with r as (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1 as rank, count(*) over (partition by source) as size from documents)
select doc_id, source, case when rank < floor(size * 0.8) then 'train' when rank < floor(size * 0.8) + floor(size * 0.1) then 'val' else 'test' end as split from r""",
    "corpus_counts": "select 'source' as kind, source as value, count(*) as n from documents group by source union all select 'lang', lang, count(*) from documents group by lang",
    "corpus_pseudonyms": "select doc_id, substr(sha256(source), 1, 12) as author from documents",
    "arena_answers": r"""with k as (select conv_id, arg_min(text, turn) filter (role = 'user') as prompt, arg_min(text, turn) filter (role = 'assistant') as answer, arg_max(text, turn) filter (role = 'assistant') as last_answer from conversations group by conv_id)
select *, len(list_filter(regexp_split_to_array(answer, '\s+'), lambda x: x <> '')) as words from k where len(answer) between 50 and 2000""",
    "clean_markdown": f"select doc_id, {_clean(C.MARKDOWN, 'text')} as text from documents",
    "clean_bbcode": f"select doc_id, {_clean(C.BBCODE, 'text')} as text from documents",
    "clean_html": f"select page_id, {_clean(C.HTML, 'html')} as text from pages",
    "classify_signals": _light_sql(),
}
