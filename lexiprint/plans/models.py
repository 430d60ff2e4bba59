"""Queries of profiles, evaluation and sequences over ``embeddings``, and their SQL.

``label`` stands for the model of a vector, ``vec_id`` for its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.operators import profiles as P

THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c) + F.lit(1e-10), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.col("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _q(build):
    return lambda spark, sf_dir: rounded(build(_vectors(spark, sf_dir)))


def _samples(v: DataFrame) -> DataFrame:
    """Means of every 50 identifiers of a model, as a time series."""
    slots = P.long_form(v.withColumn("ts", F.floor(F.col("id") / 50)), "model", "ts").groupBy("model", "ts", "dim").agg(F.avg("x").alias("x"))
    return slots.groupBy("model", "ts").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("p")).select("model", "ts", F.transform("p", lambda s: s["x"]).alias("vec"))


def _scored(v: DataFrame) -> DataFrame:
    """A score between 0 and 1 from the first component; even labels stand for AI."""
    return v.select((F.col("label") % 2 == 0).alias("is_ai"), (1 / (1 + F.exp(-5 * F.get("vec", F.lit(0))))).alias("score"))


QUERIES = {
    "profile_components": _q(P.components),
    "profile_centroids": _q(lambda v: P.centroids(v).select("model", "n", F.posexplode("centroid").alias("dim", "mean"))),
    "profile_covariance": _q(lambda v: P.covariance(v.withColumn("vec", F.slice("vec", 1, 8)))),
    "profile_covariance_whole": _q(P.covariance),
    "identify": _q(lambda v: P.identify(v, P.centroids(v))),
    "verify_claim": _q(lambda v: P.verify(v.withColumn("claim", F.concat(F.lit("m"), (F.col("id") % 11).cast("string"))), P.centroids(v))),
    "effect_sizes": _q(lambda v: P.effect_sizes(v.withColumn("is_human", F.col("label") % 2 == 0))),
    "effect_summary": _q(lambda v: P.effect_summary(P.effect_sizes(v.withColumn("is_human", F.col("label") % 2 == 0)))),
    "separability": _q(P.separability),
    "style_stability": _q(lambda v: P.stability(v.withColumn("style", F.col("id") % 2))),
    "top_differentiators": _q(P.differentiators),
    "confusion": _q(lambda v: P.confusion(_scored(v).select("is_ai", (F.col("score") >= 0.5).alias("predicted_ai")))),
    "threshold_sweep": _q(lambda v: P.threshold_sweep(_scored(v), THRESHOLDS)),
    "trajectory": _q(lambda v: P.trajectory(v.select(F.col("model").alias("path"), F.col("id").alias("pos"), "vec"))),
    "drift": _q(lambda v: P.drift(_samples(v))),
    "drift_summary": _q(lambda v: P.drift_summary(P.drift(_samples(v)))),
}

_BASE = """v as (select vec_id as id, 'm' || label as model, label, list_transform(embedding, lambda x: x::double) as vec from embeddings),
l as (select id, model, label, unnest(vec) as x, generate_subscripts(vec, 1)::int - 1 as dim from v),
c as (select model, dim, count(*) as n, avg(x) as mean, coalesce(stddev_samp(x), 0) as sd from l group by model, dim)"""
_NEAR = """dist as (select l.id, c.model, sqrt(sum((l.x - c.mean) * (l.x - c.mean))) as d from l join c using (dim) group by l.id, c.model),
ranked as (select id, model, d, row_number() over (partition by id order by d, model) as r, exp(-d / 0.5) / sum(exp(-d / 0.5)) over (partition by id) as p from dist)"""
_TRUST = "case when {p} >= 0.85 then 'high' when {p} >= 0.70 then 'medium' when {p} >= 0.50 then 'low' else 'reject' end"
_EFFECT = """e as (select dim, count(*) filter (label % 2 = 0) as nh, count(*) filter (label % 2 <> 0) as na, avg(x) filter (label % 2 = 0) as human, avg(x) filter (label % 2 <> 0) as ai, var_samp(x) filter (label % 2 = 0) as vh, var_samp(x) filter (label % 2 <> 0) as va from l group by dim),
ed as (select dim, human, ai, (human - ai) / sqrt(((nh - 1) * vh + (na - 1) * va) / (nh + na - 2)) as d from e where nh >= 10 and na >= 10)"""
_DRIFT = """s as (select model, id // 50 as ts, dim, avg(x) as x from l group by all),
f as (select model, min(ts) as t0 from s group by model),
dr as (select s.model, s.ts, sqrt(sum((s.x - b.x) * (s.x - b.x))) as drift from s join f using (model) join s b on b.model = s.model and b.ts = f.t0 and b.dim = s.dim group by s.model, s.ts),
dc as (select *, case when drift >= 0.25 then 'critical' when drift >= 0.15 then 'high' when drift >= 0.10 then 'medium' when drift >= 0.05 then 'low' else 'none' end as level, coalesce(abs(drift - lag(drift) over (partition by model order by ts)) > 0.10, false) as change from dr)"""


def _r(x: str, name: str) -> str:
    return f"round({x} + 1e-10, 6) as {name}"


ORACLES = {
    "profile_components": f"with {_BASE} select model, dim, n, {_r('mean', 'mean')}, {_r('sd', 'sd')} from c",
    "profile_centroids": f"with {_BASE} select model, n, dim, {_r('mean', 'mean')} from c",
    "profile_covariance": f"with {_BASE} select a.model, a.dim as i, b.dim as j, {_r('covar_samp(a.x, b.x)', 'cov')} from l a join l b on a.id = b.id and a.dim <= b.dim and b.dim < 8 group by a.model, a.dim, b.dim having count(*) >= 10",
    "profile_covariance_whole": f"with {_BASE} select a.model, a.dim as i, b.dim as j, case when abs(covar_samp(a.x, b.x) + 1e-10) < 5e-7 then 0.0::double else round(covar_samp(a.x, b.x)::double + 1e-10, 6) end as cov from l a join l b on a.id = b.id and a.dim <= b.dim group by a.model, a.dim, b.dim having count(*) >= 10",
    "identify": f"with {_BASE}, {_NEAR} select id, model, {_r('d', 'distance')}, {_r('p', 'confidence')}, case when (select count(distinct model) from c) > 1 and d = (select max(d) from dist x where x.id = ranked.id) then 0.5 else 1.0 end as minmax, {_TRUST.format(p='p')} as trust from ranked where r = 1",
    "verify_claim": f"""with {_BASE}, {_NEAR},
j as (select v.id, 'm' || (v.id % 11) as claim, n.model as found, coalesce(m.p, 0) as p from v join ranked n on n.id = v.id and n.r = 1 left join ranked m on m.id = v.id and m.model = 'm' || (v.id % 11))
select id, claim, found, {_r("p", "claimed_confidence")}, claim = found as matched, case when claim <> found and p >= 0.70 then 'low' else {_TRUST.format(p="p")} end as trust from j""",
    "effect_sizes": f"with {_BASE}, {_EFFECT} select dim, {_r('human', 'human')}, {_r('ai', 'ai')}, {_r('d', 'd')}, case when abs(d) >= 1 then 'very large' when abs(d) >= 0.8 then 'large' when abs(d) >= 0.5 then 'medium' when abs(d) >= 0.2 then 'small' else 'negligible' end as band from ed",
    "effect_summary": f"with {_BASE}, {_EFFECT}, k as (select *, dim // 8 as part, row_number() over (partition by dim // 8 order by abs(d) desc, dim) as r from ed) select part, {_r('avg(abs(d))', 'mean_d')}, {_r('max(abs(d))', 'max_d')}, max(case when r = 1 then dim end) as best from k group by part",
    "separability": f"""with {_BASE}, w as (select model, avg(v) as spread from (select model, dim, var_pop(x) as v from l group by model, dim) group by model)
select a.model as a, b.model as b, {_r("sqrt(sum((a.mean - b.mean) * (a.mean - b.mean)))", "distance")}, {_r("max(wa.spread)", "spread_a")}, {_r("max(wb.spread)", "spread_b")} from c a join c b on a.dim = b.dim and a.model < b.model join w wa on wa.model = a.model join w wb on wb.model = b.model group by a.model, b.model""",
    "style_stability": f"with {_BASE}, m as (select model, dim, avg(x) filter (id % 2 = 0) as a, avg(x) filter (id % 2 = 1) as b from l group by model, dim) select model, {_r('corr(a, b)', 'r')}, coalesce(corr(a, b) > 0.7, false) as stable from m group by model",
    "top_differentiators": f"with {_BASE}, g as (select dim, var_samp(mean) as variance from c group by dim), k as (select *, row_number() over (order by variance desc, dim) as rank from g) select dim, {_r('variance', 'variance')}, rank::int as rank from k where rank <= 10",
    "confusion": f"""with {_BASE}, s as (select label % 2 = 0 as y, 1 / (1 + exp(-5 * vec[1])) >= 0.5 as p from v),
k as (select count(*) filter (y and p) as tp, count(*) filter (not y and p) as fp, count(*) filter (y and not p) as fn, count(*) filter (not y and not p) as tn from s)
select tp, fp, fn, tn, {_r("(tp + tn) / (tp + fp + fn + tn)", "accuracy")}, {_r("tp / (tp + fp)", "precision")}, {_r("tp / (tp + fn)", "recall")}, {_r("2 * tp / (2 * tp + fp + fn)", "f1")}, {_r("tn / (tn + fp)", "human_recognition")} from k""",
    "threshold_sweep": f"""with {_BASE}, s as (select label % 2 = 0 as y, 1 / (1 + exp(-5 * vec[1])) as score from v),
t as (select unnest([{", ".join(map(str, THRESHOLDS))}])::double as threshold)
select {_r("threshold", "threshold")}, {_r("avg((y = (score >= threshold))::int)", "accuracy")}, {_r("(avg((score >= threshold)::int) filter (y) + avg((score < threshold)::int) filter (not y)) / 2", "balanced")} from s, t group by threshold""",
    "trajectory": f"""with {_BASE}, o as (select model, id, row_number() over (partition by model order by id) as i, count(*) over (partition by model) as n from v),
p as (select l.model, o.i, o.n, l.dim, l.x, lead(l.x) over w - l.x as s1, lead(l.x, 2) over w - lead(l.x) over w as s2 from l join o using (model, id) window w as (partition by l.model, l.dim order by o.i)),
j as (select model, i, max(n) as n, sqrt(sum(s1 * s1)) as jump, case when max(i) <= max(n) - 2 then acos(greatest(-1, least(1, sum(s1 * s2) / greatest(sqrt(sum(s1 * s1)) * sqrt(sum(s2 * s2)), 1e-12)))) end as turn from p group by model, i),
e as (select a.model, sqrt(sum((b.x - a.x) * (b.x - a.x))) as far from p a join p b on a.model = b.model and a.dim = b.dim and a.i = 1 and b.i = b.n group by a.model)
select model as path, max(n) as n, {_r("avg(jump)", "jump_mean")}, {_r("var_pop(jump)", "jump_variance")}, {_r("sum(jump) / greatest(max(far), 0.001)", "tortuosity")}, {_r("avg(turn)", "turning")} from j join e using (model) group by model""",
    "drift": f"with {_BASE}, {_DRIFT} select model, ts, {_r('drift', 'drift')}, level, change from dc",
    "drift_summary": f"with {_BASE}, {_DRIFT} select model, count(*) as n, {_r('max(drift)', 'max_drift')}, {_r('avg(drift)', 'mean_drift')}, count(*) filter (change) as changes, case when arg_max(drift, ts) > arg_min(drift, ts) then 'increasing' else 'stable' end as trend from dc group by model",
}
