"""Queries of stores, configurations, returns and budgets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprint.operators import merging as M
from lexiprint.operators import sequences as S
from lexiprint.operators import subsets as B
from lexiprint.operators.budget import within
from lexiprint.operators.cascade import FIRST, SECOND, cascade, text_tiers
from lexiprint.operators.embedding import text_paths
from lexiprint.operators.registry import view
from lexiprint.operators.store import Store
from lexiprint.plans.models import _BASE, _vectors, rounded
from lexiprint.sources.shared import fresh_dir

SUBSETS = B.places() | {"whole": list(range(64))}
KINDS = ["click", "error", "purchase", "signup", "view"]


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored in two batches that overlap, one of them twice; then the merged profiles."""
    v = _vectors(spark, sf_dir).select(F.col("id"), "model", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), "vec")
    store = Store(spark, fresh_dir(spark, "store"))
    store.add("first", v.filter("id % 3 <> 2").drop("id"))
    store.add("second", v.filter("id % 3 <> 0").drop("id"))
    store.add("first", v.drop("id"))
    return rounded(store.profiles().select("model", "n", F.posexplode(F.arrays_zip("centroid", "sd")).alias("dim", "x")).select("model", "n", "dim", F.col("x.centroid").alias("mean"), F.col("x.sd").alias("sd")))


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a path through value and kind."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("path"), F.col("event_id").alias("pos"), F.array("value", kind * 10).alias("vec"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rounded(B.judged(B.predictions(v, SUBSETS), SUBSETS))


def _corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables as corpora of unlike schema; the second holds all texts of the first that its identifiers' thirds name."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = table("documents")
    return M.merge({
        "documents": docs.select(F.col("doc_id").alias("Sample_ID"), "text", F.col("lang").alias("domain"), F.col("source").alias("model"), F.col("n_chars").cast("string").alias("temperature")),
        "turns": table("conversations").select("text", F.col("role").alias("model_id"), F.col("conv_id").alias("seed_id"), F.lit("x").alias("temperature")).unionByName(docs.filter("doc_id % 3 = 0").select("text"), allowMissingColumns=True),
        "items": table("benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("sample_id"), "text", F.lit("").alias("domain"), F.lit("formal").alias("prompt_style")),
    })


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpora(spark, sf_dir).select("sample_id", "seed_id", "domain", "model_id", "model_family", "model_name", "prompt_style", "temperature", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "word_count", "char_count", "sentence_count", "source", F.array_join("sources", " ").alias("sources"), "copies")


BUDGET = 5_000_000_000


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date until their prices, in cents, have used up the budget; windows of a thousand rows at most."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return within(orders, "at", "o_orderkey", F.col("cents"), BUDGET, light=1000).select("o_orderkey", "cents", "running")


QUERIES = {
    "text_cascade": lambda spark, sf_dir: rounded(cascade(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), text_tiers())),
    "merged_corpus": _merged,
    "merged_statistics": lambda spark, sf_dir: M.statistics(_corpora(spark, sf_dir)),
    "orders_within_budget": _bought,
    "vector_full": lambda spark, sf_dir: view(spark.read.parquet(f"{sf_dir}/documents.parquet"), "full").select("doc_id", F.transform("vector", lambda x: F.round(x + F.lit(1e-10), 6)).alias("vector")),
    "text_paths": lambda spark, sf_dir: rounded(text_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))),
    "stored_profiles": _stored,
    "path_returns": lambda spark, sf_dir: rounded(S.returns(_walks(spark, sf_dir))),
    "vector_path_returns": lambda spark, sf_dir: rounded(S.returns(_vectors(spark, sf_dir).select(F.col("model").alias("path"), F.col("id").alias("pos"), "vec"))),
    "layer_configurations": _layers,
}


def _r(x: str, name: str) -> str:
    return f"round(({x})::double + 1e-10, 6) as {name}"


def _returns_sql(points: str) -> str:
    return f"""with pts as ({points}),
o as (select *, row_number() over (partition by path order by pos) as i, count(*) over (partition by path) as n from pts),
j as (select a.path, avg(list_distance(a.vec, b.vec)) as jump from o a join o b on a.path = b.path and b.i = a.i + 1 group by a.path),
near as (select a.path, a.i, b.i as k, list_distance(a.vec, b.vec) as d, jump from o a join o b on a.path = b.path and b.i >= a.i + 2 join j on j.path = a.path where a.n >= 3),
early as (select path, count(distinct i) as c from near where d < case when jump > 0 then jump / 2 else 0.1 end group by path),
late as (select path, count(distinct k) as c from near where d < jump / 2 group by path),
sizes as (select path, count(*) as n from pts group by path)
select sizes.path, n, {_r("coalesce(early.c, 0) / n", "return_rate")}, {_r("coalesce(late.c, 0) / greatest(n - 2, 1)", "orbit_rate")} from sizes left join early using (path) left join late using (path)"""


_PLACES = ", ".join(f"('{k}', {v})" for k, v in SUBSETS.items())
_MERGED = r"""d as (select doc_id, text, lang, source, n_chars from documents),
s as (
    select 0 as place, 'documents' as source, doc_id::varchar as sample_id, null as seed_id, lang as domain, source as model_id, null as style, n_chars::double as temperature, coalesce(text, '') as text from d
    union all select 1, 'turns', null, conv_id::varchar, null, role, null, null, coalesce(text, '') from conversations
    union all select 1, 'turns', null, null, null, null, null, null, coalesce(text, '') from d where doc_id % 3 = 0
    union all select 2, 'items', 'item ' || item_id, null, null, null, 'formal', null, coalesce(text, '') from benchmark),
f as (select place, source, coalesce(nullif(sample_id, ''), 'sample_' || sha256(text)[:12]) as sample_id, coalesce(nullif(seed_id, ''), 'unknown') as seed_id, coalesce(nullif(domain, ''), 'unknown') as domain, coalesce(nullif(model_id, ''), 'unknown') as model_id,
    coalesce(style, 'neutral') as prompt_style, coalesce(temperature, 0.7) as temperature, text from s),
g as (select *, row_number() over (partition by text order by place, sample_id, seed_id, domain, model_id) as nr, count(*) over (partition by text) as copies from f),
h as (select text, array_to_string(list_sort(list(distinct source)), ' ') as sources from f group by text),
merged as (select sample_id, seed_id, domain, model_id, 'unknown' as model_family, lower(model_id) as model_name, prompt_style, temperature::double as temperature, sha256(text) as text_sha256,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as word_count, length(text)::bigint as char_count, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S')))::bigint as sentence_count, source, sources, copies
    from g join h using (text) where nr = 1)"""
_CASCADE = rf"""with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as words, list_filter(list_transform(regexp_split_to_array(text, '[,;.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as parts from t),
m as (select *, (length(text) - length(replace(text, ',', ''))) * 100 / greatest(length(text), 1) as commas, len(list_distinct(list_transform(words, lambda x: lower(x)))) / greatest(len(words), 1) as variety,
    len(list_filter(words, lambda x: length(x) > 8)) / greatest(len(words), 1) as long_words, list_transform(parts, lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> ''))::double) as sizes from w),
s as (select doc_id, 1 / (1 + exp(-((commas - 1.2) * 4))) as a, 1 / (1 + exp(-((0.6 - variety) * 5))) as b,
    1 / (1 + exp(-((0.7 - case when len(sizes) > 1 and list_avg(sizes) > 0 then list_stddev_pop(sizes) / list_avg(sizes) else 0 end) * 3 + (long_words - 0.15) * 5))) as c from m),
r as (select doc_id, case when greatest(a, 1 - a) >= {FIRST} then 'commas' when greatest(b, 1 - b) >= {SECOND} then 'variety' else 'shapes' end as tier, case when greatest(a, 1 - a) >= {FIRST} then a when greatest(b, 1 - b) >= {SECOND} then b else c end as ai from s)
select doc_id, tier, round(ai + 1e-10, 6) as ai, case when ai >= 0.5 then 'ai' else 'human' end as label from r"""
ORACLES = {
    "text_cascade": _CASCADE,
    "merged_corpus": f"with {_MERGED} select * from merged",
    "merged_statistics": f"""with {_MERGED} select case when grouping(model_name) = 0 then 'model_name' when grouping(model_family) = 0 then 'model_family' when grouping(domain) = 0 then 'domain' when grouping(prompt_style) = 0 then 'prompt_style' when grouping(source) = 0 then 'source' else 'all' end as kind,
    coalesce(model_name, model_family, domain, prompt_style, source) as value, count(*) as samples, sum(copies)::bigint as copies, sum(word_count)::bigint as words from merged group by grouping sets ((), (model_name), (model_family), (domain), (prompt_style), (source))""",
    "orders_within_budget": f"""with o as (select o_orderkey, round(o_totalprice * 100)::bigint as cents, sum(round(o_totalprice * 100)::bigint) over (order by o_orderdate, o_orderkey rows unbounded preceding) as running from orders)
select o_orderkey, cents, running::bigint as running from o where running <= {BUDGET}""",
    "stored_profiles": f"with {_BASE} select model, count(*) as n, dim, {_r('avg(x)', 'mean')}, {_r('stddev_samp(x)', 'sd')} from l group by model, dim",
    "path_returns": _returns_sql("select user_id as path, event_id as pos, [value, 10.0::double * list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], event_type)] as vec from events"),
    "vector_path_returns": _returns_sql("select 'm' || label as path, vec_id as pos, list_transform(embedding, lambda x: x::double) as vec from embeddings"),
    "layer_configurations": f"""with {_BASE}, f as (select *, id % 5 as fold from l),
s as (select model, fold, dim, count(*) as n, sum(x) as s from f group by model, fold, dim),
folds as (select unnest(range(5)) as fold),
ctr as (select g.fold as held, s.model, s.dim, sum(s.n) as n, sum(s.s) / sum(s.n) as m from folds g join s on s.fold <> g.fold group by g.fold, s.model, s.dim),
w as (select c.held, f.dim, greatest(avg((f.x - c.m) * (f.x - c.m)), 1e-12) as v from f join ctr c on c.held <> f.fold and c.model = f.model and c.dim = f.dim group by c.held, f.dim),
config as (select config, unnest(places) as dim, len(places) as dimensions from (values {_PLACES}) t(config, places)),
t as (select f.id, f.model, c.model as other, f.dim, (f.x - c.m) * (f.x - c.m) / w.v as d from f join ctr c on c.held = f.fold and c.dim = f.dim join w on w.held = f.fold and w.dim = f.dim),
e as (select config, id, model, other, sum(d) as d from t join config using (dim) group by config, id, model, other),
p as (select config, id, model, arg_min(other, (round(d, 9), other)) as predicted from e group by config, id, model),
k as (select config, model, count(*) as n, count(*) filter (model = predicted) as hits from p group by config, model),
q as (select config, predicted as model, count(*) as said from p group by config, predicted),
u as (select config, sum(n) as rows, sum(hits) / sum(n) as accuracy, sum(n * (2 * hits / (n + coalesce(said, 0)))) / sum(n) as f1 from k left join q using (config, model) group by config),
z as (select u.*, d.dimensions from u join (select distinct config, dimensions from config) d using (config))
select config, dimensions::int as dimensions, rows::bigint as rows, {_r("accuracy", "accuracy")}, {_r("f1", "f1")}, row_number() over (order by round(accuracy, 12) desc, dimensions, config)::int as rank, case when accuracy > 0.7 then 'GO' when accuracy > 0.5 then 'INVESTIGATE' else 'NOGO' end as verdict from z""",
}
