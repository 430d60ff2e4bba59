"""Queries of reports and sequences, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.operators import evaluation as E
from lexiprint.operators import profiles as P
from lexiprint.operators.registry import extract
from lexiprint.operators.sequences import decay
from lexiprint.plans import features
from lexiprint.plans.models import _BASE, _DRIFT, _q, _r, _samples

HUMAN = "m0"
#: The registry's groups, which together make the whole vector.
WHOLE = ["statistical", "lexical", "structural", "punctuation", "connectors", "epistemic", "transitions", "rhythm", "lightweight", "alignment", "noise", "tokenization", "echo", "dynamics", "fractal"]
LAYERS = ["layer_e", "layer_b", "layer_c1", "layer_c2", "layer_d"]


def _predicted(v: DataFrame) -> DataFrame:
    found = P.identify(v, P.centroids(v)).select("id", F.col("model").alias("predicted"))
    return v.select("id", "model").join(found, "id")


def _claims(v: DataFrame) -> DataFrame:
    """Every identifier claims one of twelve names; two of them are no model's, and one holds a model's name."""
    k = F.col("id") % 12
    return v.withColumn("claim", F.when(k == 11, F.lit("M3-large")).otherwise(F.concat(F.lit("m"), k.cast("string"))))


def _zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.zero_counts(extract(spark.read.parquet(f"{sf_dir}/documents.parquet"), LAYERS, digits=features.DIGITS), LAYERS)


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all groups in one scan without an exchange."""
    return extract(spark.read.parquet(f"{sf_dir}/documents.parquet"), WHOLE, digits=features.DIGITS)


QUERIES = {
    "features_whole": _whole,
    "component_quartiles": _q(lambda v: E.quartiles(P.long_form(v, "model"), "model", "dim")),
    "class_report": _q(lambda v: E.class_report(_predicted(v))),
    "human_pairs": _q(lambda v: E.human_pairs(v, P.centroids(v), HUMAN)),
    "alternatives": _q(lambda v: E.alternatives(v, P.centroids(v))),
    "check_claims": _q(lambda v: E.check_claims(_claims(v), P.centroids(v))),
    "drift_alerts": _q(lambda v: E.alerts(P.drift(_samples(v)), since=3, least="medium")),
    "drift_reset": _q(lambda v: P.drift(_samples(v), base="last")),
    "similarity_decay": _q(lambda v: decay(v.select(F.col("model").alias("path"), F.col("id").alias("pos"), "vec"))),
    "zero_counts": _zeros,
}

_NEAR = """dist as (select l.id, l.model as own, c.model, sqrt(sum((l.x - c.mean) * (l.x - c.mean))) as d from l join c using (dim) group by l.id, l.model, c.model),
near as (select *, row_number() over (partition by id order by d, model) as r, min(d) over (partition by id) as lo, max(d) over (partition by id) as hi, count(*) over (partition by id) as m from dist)"""
_CONFIDENCE = "case when hi = lo then case when m > 1 then 0.5 else 1.0 end else greatest(1 - (d - lo) / (hi - lo), 0) end"


def _zero_sql() -> str:
    parts = []
    for x in LAYERS:
        sql = features.ORACLES[f"features_{x}"]
        parts.append(f"z_{x} as (select doc_id, count(*) filter (v = 0)::int as zeros from (unpivot ({sql}) on columns(* exclude (doc_id)) into name k value v) group by doc_id)")
    joins = " ".join(f"join z_{x} using (doc_id)" for x in LAYERS[1:])
    return f"with {', '.join(parts)} select doc_id, {', '.join(f'z_{x}.zeros as {x}_zeros' for x in LAYERS)} from z_{LAYERS[0]} {joins}"


def _whole_sql() -> str:
    parts = [f"g_{g} as (select doc_id, columns(* exclude (doc_id)) as '{g}_\\0' from ({features.ORACLES[f'features_{g}']}) as f)" for g in WHOLE]
    return f"with {', '.join(parts)} select * from g_{WHOLE[0]} {' '.join(f'join g_{g} using (doc_id)' for g in WHOLE[1:])}"


ORACLES = {
    "features_whole": _whole_sql(),
    "component_quartiles": f"with {_BASE}, q as (select model, dim, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as c from l group by model, dim) select model, dim, {_r('a', 'p25')}, {_r('b', 'median')}, {_r('c', 'p75')}, {_r('c - a', 'iqr')} from q",
    "class_report": f"""with {_BASE}, {_NEAR}, p as (select own as model, model as predicted from near where r = 1),
o as (select model, count(*) as n, count(*) filter (model = predicted) as hits from p group by model), s as (select predicted as model, count(*) as said from p group by predicted)
select model, n, hits, {_r("hits / n", "accuracy")}, {_r('coalesce(hits / said, 0)', "precision")} from o left join s using (model)
union all select null, sum(n)::bigint, sum(hits)::bigint, {_r('sum(hits) / sum(n)', "accuracy")}, {_r('sum(hits) / sum(n)', "precision")} from o having sum(n) is not null""",
    "human_pairs": f"""with {_BASE}, {_NEAR}, h as (select id, d as people from dist where model = '{HUMAN}'),
p as (select dist.model, own = '{HUMAN}' as is_human, people <= d as said from dist join h using (id) where dist.model <> '{HUMAN}' and own in ('{HUMAN}', dist.model))
select model, count(*) as n, {_r("avg((is_human = said)::int)", "accuracy")}, {_r("coalesce(avg(said::int) filter (is_human), 0)", "human_recognition")} from p group by model""",
    "alternatives": f"with {_BASE}, {_NEAR} select id, r::int as rank, model, {_r('d', 'distance')}, {_r(_CONFIDENCE, 'confidence')} from near where r <= 5",
    "check_claims": f"""with {_BASE}, {_NEAR}, k as (select id, case when id % 12 = 11 then 'M3-large' else 'm' || (id % 12) end as claim from v),
j as (select k.id, claim, n.model as found, coalesce(x.conf, 0) as conf from k join near n on n.id = k.id and n.r = 1 left join (select id, model, {_CONFIDENCE} as conf from near) x on x.id = k.id and x.model = claim),
t as (select *, contains(lower(found), lower(claim)) or contains(lower(claim), lower(found)) or conf > 0.7 as verified from j)
select id, claim, found, {_r("conf", "claim_confidence")}, verified, case when not verified then 'Claimed ' || claim || ' but fingerprint matches ' || found end as alert from t""",
    "drift_alerts": f"with {_BASE}, {_DRIFT} select model, ts, {_r('drift', 'drift')}, level, upper(level) || ' drift of ' || model as message from dc where ts >= 3 and level in ('medium', 'high', 'critical')",
    "drift_reset": f"with {_BASE}, {_DRIFT.replace('min(ts) as t0', 'max(ts) as t0')} select model, ts, {_r('drift', 'drift')}, level, change from dc",
    "similarity_decay": f"""with {_BASE}, o as (select *, row_number() over (partition by model order by id) as i, count(*) over (partition by model) as n from v),
p as (select a.model, a.i, b.i - a.i as k, list_cosine_similarity(a.vec, b.vec) as s from o a join o b on a.model = b.model and b.i between a.i + 1 and a.i + 3 where a.i + 3 <= a.n)
select model as path, any_value(n) as n, {_r("coalesce(avg(s) filter (k = 1), 0)", "decay_k1")}, {_r("coalesce(avg(s) filter (k = 2), 0)", "decay_k2")}, {_r("coalesce(avg(s) filter (k = 3), 0)", "decay_k3")} from (select distinct model, n from o) left join p using (model) group by model""",
    "zero_counts": _zero_sql(),
}
