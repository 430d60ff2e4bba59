"""Queries of the clause echoes over ``documents`` and of learned views over ``embeddings``, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprint.operators import echoes as E
from lexiprint.operators import learning, lexicons
from lexiprint.operators import profiles as P
from lexiprint.plans.models import _BASE, _vectors, rounded


def _docs(build):
    return lambda spark, sf_dir: rounded(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _forest(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    columns = [f"x{i}" for i in range(v.agg(F.max(F.size("vec"))).first()[0] or 0)]
    return learning.cross_validated(v.select("id", (F.col("label") % 2).alias("y"), *(F.get("vec", F.lit(i)).alias(c) for i, c in enumerate(columns))), columns, "y", "id")


def _meanings(spark, sf_dir):
    """Pairs scored with word vectors: a word's is one of ``embeddings`` by its length and first letter; every third identifier has none."""
    v = _vectors(spark, sf_dir).select(F.col("id").alias("key"), "vec").filter("key % 3 <> 0")
    place = lambda w: ((F.length(w) * 31 + F.ascii(w)) % 97).cast("long")
    return rounded(E.scored(E.meanings(E.pairs(spark.read.parquet(f"{sf_dir}/documents.parquet")), v, place)))


QUERIES = {
    "echo_meanings": _meanings,
    "echo_pairs": _docs(lambda d: E.pairs(d).withColumns({z: F.array_join(z, " ") for z in ("zone_a", "zone_b")})),
    "echo_scores": _docs(lambda d: E.scored(E.pairs(d))),
    "echo_documents": _docs(lambda d: E.document_scores(E.scored(E.pairs(d)), 0.4, 0.05)),
    "echo_kinds": _docs(lambda d: E.kinds(E.pairs(d))),
    "coverage": lambda spark, sf_dir: rounded(learning.coverage(v := _vectors(spark, sf_dir), P.centroids(v))),
    "cross_validated_forest": _forest,
    "kmeans": lambda spark, sf_dir: learning.clusters(_vectors(spark, sf_dir), 10),
    "pca": lambda spark, sf_dir: learning.projected(_vectors(spark, sf_dir)),
}

_FUNCTION = ", ".join(f"'{w}'" for w in sorted(set(lexicons.FUNCTION_WORDS)))
_PAIRS = rf"""cut as (select doc_id, unnest(p) as c, generate_subscripts(p, 1) as i from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?,;:—])', '\1' || chr(2), 'g'), chr(2)) as p from documents)),
cl as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as k, w, list_filter(w, lambda x: x not in ({_FUNCTION})) as content, regexp_matches(c, '[;:—]\s*$') as strong from (select *, list_filter(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) as w from cut) where len(w) >= 2),
nx as (select doc_id, k::int as pair, w, content, strong, lead(w) over o as w2, lead(content) over o as content2 from cl window o as (partition by doc_id order by k)),
pr as (select doc_id, pair, case when strong then 'punctuation' when list_has_any(list_concat(w, w2), ['and', 'but', 'or']) then 'conjunction' when w2[1] in ('however', 'therefore', 'thus') then 'transition' end as kind, content[-3:] as zone_a, content2[:3] as zone_b from nx where w2 is not null),
pairs as (select * from pr where kind is not null)"""
_SYLLABLES = "list_sum(list_transform({z}, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - suffix(w, 'e')::int + regexp_matches(w, '[^aeiouy]le$')::int)))"
_SCORES = f"""za as (select doc_id, pair, unnest(zone_a) as a, generate_subscripts(zone_a, 1) as i, zone_b from pairs),
zb as (select doc_id, pair, i, a, unnest(zone_b) as b from za),
bs as (select doc_id, pair, i, max(1 - levenshtein(upper(a), upper(b)) / greatest(len(a), len(b))) as s from zb group by doc_id, pair, i),
so as (select doc_id, pair, avg(s) as s from bs where s > 0 group by doc_id, pair),
sy as (select *, coalesce({_SYLLABLES.format(z="zone_a")}, 0) as ya, coalesce({_SYLLABLES.format(z="zone_b")}, 0) as yb from pairs),
sc as (select doc_id, pair, kind, case when len(zone_a) = 0 or len(zone_b) = 0 then 0 else coalesce(s, 0) end as phonetic, case when len(zone_a) = 0 or len(zone_b) = 0 then 0 else 0.5 * (len(zone_a) = len(zone_b))::int + 0.5 * (1 - abs(ya - yb) / greatest(ya, yb)) end as structural, case when len(zone_a) = 0 or len(zone_b) = 0 then 0 else 0.5 end as semantic from sy left join so using (doc_id, pair)),
scores as (select *, least(1, greatest(0, 0.33 * phonetic + 0.33 * structural + 0.34 * semantic)) as combined from sc)"""


def _r(x: str, name: str) -> str:
    return f"round(({x})::double + 1e-10, 6) as {name}"


_MEANING = """vx as (select vec_id as id, unnest(list_transform(embedding, lambda x: x::double)) as x, generate_subscripts(embedding, 1) as dim from embeddings where vec_id % 3 <> 0),
zw as (select doc_id, pair, 'a' as side, unnest(zone_a) as word from pairs union all select doc_id, pair, 'b', unnest(zone_b) from pairs),
zm as (select doc_id, pair, side, dim, avg(x) as m from zw join vx on vx.id = (length(word) * 31 + ascii(word)) % 97 group by all),
zc as (select a.doc_id, a.pair, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) as c from zm a join zm b on a.doc_id = b.doc_id and a.pair = b.pair and a.dim = b.dim and a.side = 'a' and b.side = 'b' group by all),
me as (select sc.* exclude (semantic), case when semantic = 0 then 0 else coalesce((1 + c) / 2, 0.5) end as semantic from sc left join zc using (doc_id, pair))"""
ORACLES = {
    "echo_meanings": f"with {_PAIRS}, {_SCORES}, {_MEANING} select doc_id, pair, kind, {_r('phonetic', 'phonetic')}, {_r('structural', 'structural')}, {_r('semantic', 'semantic')}, {_r('least(1, greatest(0, 0.33 * phonetic + 0.33 * structural + 0.34 * semantic))', 'combined')} from me",
    "echo_pairs": f"with {_PAIRS} select doc_id, pair, kind, array_to_string(zone_a, ' ') as zone_a, array_to_string(zone_b, ' ') as zone_b from pairs",
    "echo_scores": f"with {_PAIRS}, {_SCORES} select doc_id, pair, kind, {_r('phonetic', 'phonetic')}, {_r('structural', 'structural')}, {_r('semantic', 'semantic')}, {_r('combined', 'combined')} from scores",
    "echo_documents": f"""with {_PAIRS}, {_SCORES}, g as (select doc_id, count(*) as pairs, avg(combined) as score, quantile_cont(combined, 0.5) as median, min(combined) as low, max(combined) as high, coalesce(stddev_samp(combined), 0) as sd from scores group by doc_id)
select doc_id, pairs, {_r("score", "score")}, {_r("median", "median")}, {_r("low", "low")}, {_r("high", "high")}, {_r("sd", "sd")}, {_r("(score - 0.4) / 0.05", "z")}, case when (score - 0.4) / 0.05 > 3 then 'very high' when (score - 0.4) / 0.05 > 2 then 'high' when (score - 0.4) / 0.05 > 1 then 'moderate' else 'low' end as verdict from g""",
    "echo_kinds": f"with {_PAIRS} select doc_id, {_r('avg((kind = $$punctuation$$)::int)', 'punctuation')}, {_r('avg((kind = $$conjunction$$)::int)', 'conjunction')}, {_r('avg((kind = $$transition$$)::int)', 'transition')} from pairs group by doc_id",
    "coverage": f"""with {_BASE}, s as (select l.id, c.model, sum(l.x * c.mean) / (sqrt(sum(l.x * l.x)) * sqrt(sum(c.mean * c.mean))) as cosine from l join c using (dim) group by l.id, c.model),
k as (select *, row_number() over (partition by model order by cosine desc, id)::int as rank from s) select id, model, {_r("cosine", "cosine")}, rank from k where rank <= 3""",
}
