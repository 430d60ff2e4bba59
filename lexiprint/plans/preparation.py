"""Queries of tags, layouts and authorship flags over ``documents``, and their SQL.

The tables hold no tags, titles or flags; they are derived from words and
identifiers, in the SQL as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.functions import text as T
from lexiprint.operators import formatting, tagging
from lexiprint.plans.models import rounded

TAGS = ["X", "DET", "ADP", "CCONJ", "NOUN", "VERB", "ADJ", "ADV", "PRON", "AUX", "NOUN", "SCONJ", "PUNCT"]
DOMAINS = ["journalistic", "academic", "conversational", "technical", "legal", "other", "academic"]
HEADS = ["", "# A Headline #\n", "import os\n", "Supported by\nmore\n", "  "]


def _docs(build):
    return lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _tagged(docs: DataFrame) -> DataFrame:
    """A tag for each word by its length."""
    tags = F.array(*map(F.lit, TAGS))
    return docs.select("doc_id", F.transform(T.ws_words(T.text_of("text")), lambda w: F.get(tags, F.length(w) % len(TAGS))).alias("tags"))


def _texts(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    some = lambda n, name: F.when(k % n == 0, F.concat(F.lit(f"{name} "), k.cast("string")))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    text = F.concat(pick(HEADS), T.text_of("text"))
    out = formatting.formatted(text, pick(DOMAINS), F.when(k % 2 == 0, "essays"), some(3, "title"), some(2, "url"), some(2, "case"), some(3, "court"), some(5, "date"))
    return docs.select("doc_id", out.alias("text"))


def _flags(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    said = F.get(F.array(F.lit(None), F.lit("Human text"), F.lit("GPT output"), F.lit("machine"), F.lit("web"), F.lit("AI and human")), (k % 6).cast("int"))
    rows = docs.select("doc_id", F.when(k % 5 == 0, k % 2 == 0).alias("is_human"), said.alias("label"), F.when(k % 4 == 0, "m").when(k % 4 == 1, "").alias("model"))
    return rows.select("doc_id", formatting.written_by_human(rows).alias("human"))


QUERIES = {"tag_features": _docs(lambda d: rounded(tagging.tag_features(_tagged(d)))), "formatted_texts": _docs(_texts), "human_flags": _docs(_flags)}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _tag_sql() -> str:
    names = lambda v: ", ".join(f"'{x}'" for x in v)
    counts = ", ".join(f"count(*) filter (t in ({names(v)})) as k_{k}" for k, v in tagging.KINDS.items())
    pairs = ", ".join(f"count(*) filter (p = '{p}') as b_{k}" for k, p in tagging.PAIRS.items())
    out = {f"pos_{k}_ratio": f"k_{k} / n" for k in tagging.KINDS} | {f"pos_{k}_ratio": f"k_{a} / greatest(k_{b}, 1)" for k, (a, b) in tagging.RATIOS.items()}
    out["pos_content_function_ratio"] = "(k_noun + k_verb + k_adj + k_adv) / (k_det + k_prep + k_pron + 1)"
    out |= {f"bigram_{k}_rate": f"coalesce(b_{k}, 0) / greatest(words, 1) * 100" for k in tagging.PAIRS} | {"bigram_entropy_norm": "case when np > 1 then h / log2(np) else 0 end"}
    return rf"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from documents),
t as (select doc_id, ({_list(TAGS)})[length(x) % {len(TAGS)} + 1] as t, i from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w)),
p as (select doc_id, t || ' ' || lead(t) over (partition by doc_id order by i) as p from t),
c as (select doc_id, count(*)::double as n, count(*) filter (t not in ({names(tagging.NO_WORDS)})) as words, {counts} from t group by doc_id),
b as (select doc_id, {pairs} from p group by doc_id),
e as (select doc_id, sum(c) as np, -sum(c / s * log2(c / s)) as h from (select doc_id, c, sum(c) over (partition by doc_id) as s from (select doc_id, p, count(*)::double as c from p where p is not null group by all)) group by doc_id)
select doc_id, {", ".join(f"round(coalesce({v}, 0) + 1e-10, 6) as {k}" for k, v in out.items())} from documents left join c using (doc_id) left join b using (doc_id) left join e using (doc_id)"""


ORACLES = {
    "tag_features": _tag_sql(),
    "formatted_texts": rf"""with t as (
    select doc_id, ({_list(DOMAINS)})[doc_id % {len(DOMAINS)} + 1] as domain, ({_list(HEADS)})[doc_id % {len(HEADS)} + 1] || coalesce(text, '') as text,
        case when doc_id % 3 = 0 then 'title ' || doc_id end as title, case when doc_id % 2 = 0 then 'url ' || doc_id end as url, case when doc_id % 2 = 0 then 'case ' || doc_id end as c, case when doc_id % 3 = 0 then 'court ' || doc_id end as k, case when doc_id % 5 = 0 then 'date ' || doc_id end as d from documents),
n as (select *, string_split(text, chr(10))[1] as head, title is null and (starts_with(text, '# ') or starts_with(text, 'Supported by' || chr(10))) and length(regexp_replace(trim(string_split(text, chr(10))[1], '# '), '^\s+|\s+$', '', 'g')) < 200 as taken, regexp_replace(text, '^\s+|\s+$', '', 'g') as bare from t),
m as (select *, case when taken then regexp_replace(trim(head, '# '), '^\s+|\s+$', '', 'g') else title end as name, case when taken then regexp_replace(substr(text, length(head) + 2), '^\s+|\s+$', '', 'g') else text end as rest from n)
select doc_id, case
    when domain = 'journalistic' then case when name <> '' then '# ' || name || chr(10) || chr(10) else '' end || case when url is not null then '*Source: ' || url || '*' || chr(10) || chr(10) else '' end || rest
    when domain = 'academic' and doc_id % 2 = 0 then case when title is not null then title || chr(10) || chr(10) else '' end || text
    when domain = 'technical' and regexp_matches(lower(substr(text, 1, 100)), 'def |function |class |import |#include') then '```python' || chr(10) || text || chr(10) || '```'
    when domain = 'legal' then case when c is not null then '**Case:** ' || c || chr(10) else '' end || case when k is not null then '**Court:** ' || k || chr(10) else '' end || case when d is not null then '**Date:** ' || d || chr(10) else '' end
        || case when coalesce(c, k, d) is not null then chr(10) || '---' || chr(10) || chr(10) else '' end || text
    else bare end as text from m""",
    "human_flags": """select doc_id, case when doc_id % 5 = 0 then doc_id % 2 = 0
    when doc_id % 6 in (1, 5) then true when doc_id % 6 in (2, 3) then false
    else doc_id % 4 <> 0 end as human from documents""",
}
