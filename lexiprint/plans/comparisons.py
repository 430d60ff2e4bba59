"""Queries of judgements, names and comparisons, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprint.operators import comparisons as K
from lexiprint.operators import judging as J
from lexiprint.operators import naming as N
from lexiprint.operators import profiles as P
from lexiprint.operators.registry import extract
from lexiprint.plans import features
from lexiprint.plans.models import _BASE, _q, _r, rounded
from lexiprint.plans.models import ORACLES as MODELS

#: Model names that stand in for those of a corpus, which the tables do not hold.
SPIKES = ["Claude-3-opus", "claude-2.1", "gpt-4o-mini", "gpt-4-0613", "gemini-1.5-flash", "Llama-3-8B-instruct", "mixtral-8x7b", "yi-large", "other"]
#: Headlines and docket entries that stand in front of the texts.
HEADS = ["Singer dies at 80. ", "In pictures: ", "", "Letter: ", "Emergency motion to stay. ", "Reply brief. ", "Scheduling order. ", "Affidavit of service. "]


def _docs(build):
    return lambda spark, sf_dir: rounded(build(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _light(d):
    return extract(d, ["layer_e"], namespaced=False, digits=6)


def _second(d):
    return extract(d, ["version_two"], namespaced=False, digits=6)


def _pick(values: list[str]):
    return F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))


def _kinds(d):
    text = F.concat(_pick(HEADS), F.coalesce("text", F.lit("")))
    return d.select("doc_id", N.category(text).alias("category"), N.document_kind(text).alias("kind"))


def _names(d):
    named = d.select("doc_id", _pick(SPIKES).alias("model")).withColumn("m", N.model_name(F.col("model")))
    return named.select("doc_id", "m.family", "m.name", "m.version", P.family(F.col("model"), N.FAMILIES).alias("store_family"))


MERGED = ["claude-3-5-sonnet-20241022", "Claude-opus", "claude-2.0", "gpt-4o", "GPT-4-1.5", "gpt-3.5-turbo", "ChatGPT", "gemini-2.0-flash", "gemini-pro", "grok-2", "llama3:70b", "llama-3.1-8b", "mixtral", "Gemma", "phi-4", "qwen2", "human", "Unheard-Of-8b"]


def _merged(d):
    return d.select("doc_id", N.merged_name(_pick(MERGED)).alias("m")).select("doc_id", "m.*")


def _modes(v):
    mode = F.get(F.array(F.lit("neutral"), *map(F.lit, K.MODES)), (F.col("id") % 6).cast("int"))
    return v.select("model", mode.alias("mode"), "vec")


def _attacks(v):
    attack = (F.col("id") % 11).cast("int")
    samples = v.select(F.col("id").alias("sample"), F.concat(F.lit("a"), attack.cast("string")).alias("attack"), F.concat(F.lit("c"), (attack % 4).cast("string")).alias("category"), "vec")
    return K.against_baseline(samples, P.centroids(v).filter("model = 'm0'").select(F.col("centroid").alias("vec")))


def _claims(v):
    return K.trust_evidence(rounded(P.verify(v.withColumn("claim", F.concat(F.lit("m"), (F.col("id") % 11).cast("string"))), P.centroids(v))))


QUERIES = {
    "classify_likelihood": _docs(lambda d: J.likelihood(_light(d))),
    "classify_votes": _docs(lambda d: J.votes(_light(d))),
    "classify_heuristic": _docs(lambda d: J.heuristic(_second(d))),
    "model_shares": _docs(lambda d: J.model_shares(_second(d))),
    "model_names": _docs(_names),
    "merged_names": _docs(_merged),
    "text_kinds": _docs(_kinds),
    "deformations": _q(lambda v: K.deformations(_modes(v))),
    "deformation_signature": _q(lambda v: K.deformation_signature(_modes(v)).select("model", F.posexplode("signature").alias("place", "u"))),
    "distinctive_modes": _q(lambda v: K.distinctive_modes(K.deformations(_modes(v)))),
    "attacks": _q(_attacks),
    "separation": _q(K.separation),
    "plain_effects": _q(lambda v: K.plain_effects(v.withColumn("is_human", F.col("label") % 2 == 0), 0.01)),
    "deviations": _q(lambda v: K.deviations(v, "m0")),
    "trust_evidence": _q(_claims),
}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(column: str, rules: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{k}'" for p, k in rules) + f" else {other} end"


def _closeness(name: str, mean: float, sd: float) -> str:
    return f"(abs({name} - {mean}) / {sd})"


_E, _V = features.ORACLES["features_layer_e"], features.ORACLES["features_version_two"]
_L = {k: v for k, v in J.LIKELIHOOD.items() if k != "compression_ratio"}
_VOTES = {k: v for k, v in J.VOTES.items() if k != "compression_ratio"}
_H = {k: v for k, v in J.HEURISTIC.items() if k != "compression_ratio"}


def _likelihood() -> str:
    h = " + ".join(f"{w} / (1 + {_closeness(k, m, s)})" for k, (m, s, _, _, w) in _L.items())
    a = " + ".join(f"{w} / (1 + {_closeness(k, m, s)})" for k, (_, _, m, s, w) in _L.items())
    return f"with f as ({_E}), s as (select doc_id, {h} as h, {a} as a from f) select doc_id, {_r('h / (h + a)', 'human')}, {_r('a / (h + a)', 'ai')}, case when h > a then 'human' else 'ai' end as label from s"


def _votes() -> str:
    rows = " union all ".join(f"select doc_id, ({_closeness(k, hm, hs)} < {_closeness(k, am, s)})::int as v from f" for k, (hm, hs, am, s) in _VOTES.items())
    return f"""with f as ({_E}), v as ({rows}), s as (select doc_id, sum(v)::int as human_votes, (count(*) - sum(v))::int as ai_votes from v group by doc_id)
select *, case when human_votes > ai_votes then 'human' else 'ai' end as label, {_r(f"greatest(human_votes, ai_votes) / {len(_VOTES)}", "confidence")} from s"""


def _heuristic() -> str:
    rows = " union all ".join(f"select doc_id, greatest(0, least(1, ({k} - {h}) / ({a} - {h}))) as s, {w} as w from f" for k, (h, a, w) in _H.items())
    return f"""with f as ({_V}), v as ({rows}), s as (select doc_id, sum(s::double * w::double) / sum(w::double) as p from v group by doc_id)
select doc_id, {_r("p", "ai_share")}, case when p > 0.6 then 'AI' when p < 0.4 then 'HUMAN' else 'UNCERTAIN' end as label, {_r("abs(p - 0.5) * 2", "confidence")} from s"""


def _model_shares() -> str:
    rows = ", ".join(f"('{m}', {v[0]}, {v[2]})" for m, v in J.MODELS.items())
    return f"""with f as ({_V}), m(model, a, b) as (values {rows}),
c as (select doc_id, model, greatest(0, 1 - (abs(sentence_length_cv - a) + abs(list_marker_rate - b))) as c from f, m)
select doc_id, model, {_r("coalesce(c / nullif(sum(c) over (partition by doc_id), 0), 0)", "share")} from c"""


_MODES = f"{_BASE}, t as (select model, {_list(['neutral', *K.MODES])}[id % 6 + 1] as mode, dim, avg(x) as x from l where dim < {K.WIDTH} group by all), sh as (select t.model, t.mode, t.dim, t.x - n.x as s from t join t n on n.model = t.model and n.dim = t.dim and n.mode = 'neutral' where t.mode <> 'neutral')"
_DEFORMED = f"{_MODES}, de as (select model, mode, sqrt(sum(s * s)) as size, {', '.join(f'sqrt(sum(s * s) filter (dim >= {a} and dim < {b})) as {k}' for k, (a, b) in K.LAYERS.items())} from sh group by model, mode)"

ORACLES = {
    "classify_likelihood": _likelihood(),
    "classify_votes": _votes(),
    "classify_heuristic": _heuristic(),
    "model_shares": _model_shares(),
    "model_names": f"""with n as (select doc_id, lower({_list(SPIKES)}[doc_id % {len(SPIKES)} + 1]) as m from documents)
select doc_id, {_case("m", [(r[0], r[1]) for r in N.MODEL_NAMES], "'unknown'")} as family, {_case("m", [(r[0], r[2]) for r in N.MODEL_NAMES], "m")} as name, {_case("m", [(r[0], r[3]) for r in N.MODEL_NAMES], "''")} as version, {_case("m", N.FAMILIES, "'unknown'")} as store_family from n""",
    "merged_names": f"""with n as (select doc_id, lower({_list(MERGED)}[doc_id % {len(MERGED)} + 1]) as m from documents),
k as (select doc_id, m, {_case("m", [(r[0], r[1]) for r in N.MERGED_NAMES], "'unknown'")} as family, {_case("m", [(r[0], r[2]) for r in N.MERGED_NAMES], "m")} as short from n)
select doc_id, family, case when family = 'unknown' then m else {_case("m", N.MERGED_WHOLE, "short || " + _case("m", N.MERGED_ENDS, "''"))} end as name from k""",
    "text_kinds": f"with t as (select doc_id, lower({_list(HEADS)}[doc_id % {len(HEADS)} + 1] || coalesce(text, '')) as t from documents) select doc_id, {_case('t', N.CATEGORIES, chr(39) + 'news' + chr(39))} as category, {_case('t', N.DOCUMENT_KINDS, chr(39) + 'OTHER' + chr(39))} as kind from t",
    "deformations": f"with {_DEFORMED} select model, mode, {', '.join(_r(k, k) for k in ['size', *K.LAYERS])}, row_number() over (partition by model order by size desc, mode) as rank from de",
    "deformation_signature": f"""with {_MODES}, u as (select model, mode, dim, s / sqrt(sum(s * s) over (partition by model, mode)) as u from sh),
g as (select distinct model, mode, (list_position({_list(K.MODES)}, mode) - 1) * {K.WIDTH} as first from (select model from sh) cross join (select unnest({_list(K.MODES)}) as mode))
select g.model, (first + d.dim)::int as place, {_r("coalesce(u, 0)", "u")} from g cross join (select unnest(range({K.WIDTH})) as dim) d left join u on u.model = g.model and u.mode = g.mode and u.dim = d.dim""",
    "distinctive_modes": f"with {_DEFORMED} select mode, {_r('var_pop(size)', 'variance')}, {_r('max(size) - min(size)', 'range')}, row_number() over (order by var_pop(size) desc, mode) as rank from de group by mode",
    "attacks": f"""with {_BASE}, s as (select id, 'a' || id % 11 as attack, 'c' || (id % 11) % 4 as category, sqrt(sum((x - mean) * (x - mean))) as d, corr(x, mean) as r, sum(x * mean) / (sqrt(sum(x * x)) * sqrt(sum(mean * mean))) as cs from l join (select dim, mean from c where model = 'm0') using (dim) group by id)
select attack, category, count(*) as n, {_r("avg(d)", "distance")}, {_r("avg(r)", "correlation")}, {_r("avg(cs)", "cosine")}, row_number() over (order by avg(d) desc, attack) as rank from s group by attack, category""",
    "separation": f"""with {_BASE}, p as (select a.model as a, b.model as b, sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))) as d, corr(a.mean, b.mean) as r from c a join c b on a.dim = b.dim and a.model < b.model group by all)
select a, b, {_r("d", "distance")}, {_r("r", "correlation")}, row_number() over (order by d desc, a, b) as rank, row_number() over (order by d, a desc, b desc) as similar_rank from p""",
    "plain_effects": f"""with {_BASE}, e as (select dim, avg(x) filter (label % 2 = 0) as h, avg(x) filter (label % 2 <> 0) as a, sqrt((var_pop(x) filter (label % 2 = 0) + var_pop(x) filter (label % 2 <> 0)) / 2) as s,
    avg((abs(x) <= 0.01)::int) filter (label % 2 = 0) as zh, avg((abs(x) <= 0.01)::int) filter (label % 2 <> 0) as za from l group by dim)
select dim, {_r("h", "human")}, {_r("a", "ai")}, {_r("coalesce((a - h) / nullif(s, 0), 0)", "d")}, {_r("zh", "zero_human")}, {_r("za", "zero_ai")} from e""",
    "deviations": f"""with {_BASE}, p as (select c.model, c.dim, (c.mean - b.mean) / abs(b.mean) * 100 as p from c join c b on b.dim = c.dim and b.model = 'm0' where c.model <> 'm0' and b.mean <> 0)
select model, dim, {_r("p", "percent")}, case when abs(p) < 10 then 'NEAR' when abs(p) < 25 then 'MINOR' when abs(p) < 50 then 'MODERATE' else 'MAJOR' end as band from p""",
    "trust_evidence": f"""with q as ({MODELS["verify_claim"]})
select id, {_r("case when matched then least(1, claimed_confidence * 1.1) else claimed_confidence * 0.3 end", "trust_score")}, matched as verified, {_r("case when matched then claimed_confidence else 0.3 end", "value")}, case when not matched then 'claims ' || claim || ', matches ' || found end as alert from q""",
}
