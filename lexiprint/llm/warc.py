"""Not-modified revisits of web archives, resolved to the responses they stand for.

A revisit record says that a page had not changed since an earlier capture.
It is joined as of its time to the latest earlier full response of the same
canonical URL; their validators must agree; the revisit's permitted headers
then replace those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import attach, cut

#: Headers that a not-modified answer may replace.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not select a page.
TRACKING = r"^(?:utm_[a-z_]+|ref|fbclid|gclid|sessionid)="
#: Spans of time, of about as many captures each, in which a URL's captures are ordered on their own.
SPANS = 1024
#: Captures of each page in the log of ``captures``, and seconds between them.
ROUNDS, APART = 3, 1000


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, tracking parameters or closing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url.cast("string")), "#.*$", "")
    base, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    front = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.substring(base, F.length(front) + 1, F.length(base))
    front = F.regexp_replace(F.regexp_replace(front, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    return F.concat(front, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last entry of the map counts."""
    low = F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    names = F.array_distinct(F.transform(low, lambda x: x["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(low, lambda x: x["key"] == n), -1)["value"]))


def _tag(headers: Column) -> Column:
    """Entity tag for the weak comparison."""
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def _span(ts: Column, bounds: list[int], width: int = 32) -> Column:
    """How many of the sorted ``bounds`` are at or below ``ts``, found by rows of ``width``."""
    if not bounds:
        return F.lit(0)
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda xs: F.size(F.filter(xs.cast("array<bigint>"), lambda x: x <= ts))
    nth = below(F.lit([r[0] for r in rows]))
    return F.when(nth == 0, 0).otherwise((nth - 1) * width + below(F.get(F.array(*(F.lit(r).cast("array<bigint>") for r in rows)), nth - 1)))


def as_of(points: DataFrame, facts: DataFrame) -> DataFrame:
    """``url, ts`` of ``points`` with ``at``: the latest earlier ``ts`` of ``facts`` of the same url, or null.

    Both are distinct.  A URL's times are ordered span by span, and the last
    fact of earlier spans is found over one row per span, so a URL of any
    number of captures is spread over tasks.  Spans are cut at quantiles of all
    times, so stray times do not widen them.
    """
    both = cut(points.select("url", "ts", F.lit(False).alias("fact")).union(facts.select("url", "ts", F.lit(True))))
    (bounds,) = both.agg(F.percentile_approx("ts", [i / SPANS for i in range(1, SPANS)], 8 * SPANS)).first()
    spanned = both.withColumn("span", _span(F.col("ts"), sorted(set(bounds or []))))
    spans = spanned.groupBy("url", "span").agg(F.max(F.when(F.col("fact"), F.col("ts"))).alias("last"))
    before = spans.selectExpr("url as u", "span as s", "max(last) over (partition by url order by span rows between unbounded preceding and 1 preceding) as before")
    inside = spanned.withColumn("inside", F.expr("max(case when fact then ts end) over (partition by url, span order by ts range between unbounded preceding and 1 preceding)"))
    return inside.filter("not fact").join(before, (F.col("url") == F.col("u")) & (F.col("span") == F.col("s"))).select("url", "ts", F.coalesce("inside", "before").alias("at"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row a revisit: ``record_id, url, ts, response_id, outcome, headers``.

    ``records`` has ``record_id`` (long), ``kind`` ('response' or 'revisit'),
    ``url``, ``ts`` (long), ``digest`` (may be null) and ``headers`` (map of
    strings).  Earlier means a smaller ``ts``; of several responses at one
    moment the largest ``record_id`` counts.  Digest, entity tag and last
    modification, as far as both sides have them, must agree and one must be
    there.  ``outcome`` is 'resolved', 'mismatch', 'unverifiable' (no common
    validator) or 'missing' (no earlier response, or a null url or time).
    ``headers`` of a resolved revisit are the response's with the permitted
    ones replaced; of others the revisit's own.  Repeated rows come back
    repeated.
    """
    slim = cut(records.select(F.col("record_id").cast("long").alias("record_id"), "kind", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "digest", _lower_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))).alias("headers")))
    known = slim.filter("url is not null and ts is not null")
    full = known.filter("kind = 'response'").groupBy("url", "ts").agg(F.max_by(F.struct("record_id", "digest", "headers"), F.struct("record_id", "digest")).alias("response"))
    full = cut(full)
    asked = known.filter("kind = 'revisit'").groupBy("url", "ts").agg(F.count(F.lit(1)).alias("n"))
    asked = cut(asked)
    found = as_of(asked, full).join(asked, ["url", "ts"])
    # several moments of one URL may share a response; the moments, not the response, are the many
    joined = found.withColumn("k", F.xxhash64("url", "at"))
    uses = joined.groupBy("k").agg(F.count(F.lit(1)).alias("uses"))
    facts = full.select(F.xxhash64("url", "ts").alias("k"), "response").join(uses, "k")
    moments = attach(joined, cut(facts), "k", "uses", asked.count()).select(F.xxhash64("url", "ts").alias("moment"), "n", "response")
    revisits = slim.filter("kind = 'revisit'").withColumn("moment", F.when(F.col("url").isNotNull() & F.col("ts").isNotNull(), F.xxhash64("url", "ts")))
    got = attach(revisits, cut(moments), "moment", "n", revisits.count())
    mine, theirs = F.col("headers"), F.col("response.headers")
    checks = [(F.col("digest"), F.col("response.digest")), (_tag(mine), _tag(theirs)), (F.trim(mine["last-modified"]), F.trim(theirs["last-modified"]))]
    any_common, all_equal = F.lit(False), F.lit(True)
    for a, b in checks:
        any_common = any_common | (a.isNotNull() & b.isNotNull())
        all_equal = all_equal & F.coalesce(a == b, F.lit(True))
    outcome = F.when(F.col("response").isNull(), "missing").when(~any_common, "unverifiable").when(all_equal, "resolved").otherwise("mismatch")
    fresh = F.map_filter(mine, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    return got.withColumn("outcome", outcome).select("record_id", "url", "ts", F.when(F.col("outcome").isin("resolved", "mismatch", "unverifiable"), F.col("response.record_id")).alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", merged).otherwise(mine).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over the whole table: ``ROUNDS`` fetches of each page, each followed by a conditional one.

    A page is fetched at ``page_id`` seconds and every ``APART`` seconds again,
    and asked for 500 seconds after each; of every fifth page the second fetch
    is not in the log.  Every third page changes between fetches.  The server
    sends back the tag of the page as it is, except for every seventh page,
    which got another one meanwhile, and every eleventh, for which it sends
    none.  So the response that a revisit stands for is one of several.
    """
    page, nth = F.col("page_id").cast("long"), F.col("nth").cast("long")
    rounds = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("nth"))
    body = F.concat("html", F.when(page % 3 == 0, nth.cast("string")).otherwise(""))
    tag = F.concat(F.lit('"'), F.md5(body.cast("binary")), F.lit('"'))
    at, asked, none = page + nth * APART, page + nth * APART + 500, F.lit(None).cast("string").alias("digest")
    fetched = rounds.filter(~((page % 5 == 0) & (nth == 1)))
    response = fetched.select((page * 8 + nth * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("ts"), none, F.create_map(F.lit("ETag"), tag, F.lit("Date"), at.cast("string"), F.lit("Content-Length"), F.length(body).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    answer = F.when(page % 11 == 0, F.create_map(F.lit("Date"), asked.cast("string"))).otherwise(F.create_map(F.lit("etag"), F.when(page % 7 == 0, F.lit('"new"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("Date"), asked.cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), (asked + 400).cast("string")))
    revisit = rounds.select((page * 8 + nth * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", asked.alias("ts"), none, answer.alias("headers"))
    return response.unionByName(revisit)


def page_revisits(pages: DataFrame) -> DataFrame:
    """Resolved revisits of the capture log of ``pages``, with headers as sorted lines."""
    got = resolve_revisits(captures(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda x: F.concat_ws(": ", x["key"], x["value"])))
    return got.withColumn("headers", F.array_join(lines, "\n"))


#: DuckDB SQL of ``page_revisits``.
SQL = rf"""
with split as (select page_id, url, coalesce(html, '') as html, regexp_replace(trim(url), '#.*$', '') as bare from pages),
parts as (select *, regexp_replace(bare, '\?.*$', '') as base, regexp_extract(bare, '\?(.*)$', 1) as query from split),
fronts as (
    select *, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) as front,
        list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '{TRACKING}'))) as kept from parts),
rows as (
    select page_id, html, regexp_replace(regexp_replace(front, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || regexp_replace(substr(base, length(front) + 1), '/+$', '')
        || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from fronts),
rounds as (
    select page_id, nth, url, page_id + nth * {APART} as ts, html || case when page_id % 3 = 0 then cast(nth as varchar) else '' end as body
    from rows, (select unnest(range({ROUNDS})) as nth)),
responses as (select *, page_id * 8 + nth * 2 as record_id from rounds where not (page_id % 5 = 0 and nth = 1)),
asked as (
    select a.page_id, a.nth, max([b.ts, b.record_id]) as latest from rounds a left join responses b on a.url = b.url and b.ts < a.ts + 500 group by a.page_id, a.nth),
joined as (
    select mine.page_id, mine.nth, mine.url, mine.ts + 500 as ts, mine.body as own, theirs.body as other, theirs.record_id as response_id
    from asked join rounds mine using (page_id, nth) left join responses theirs on theirs.record_id = latest[2]),
judged as (
    select *, case when response_id is null then 'missing' when page_id % 11 = 0 then 'unverifiable' when page_id % 7 = 0 or own <> other then 'mismatch' else 'resolved' end as outcome,
        case when page_id % 7 = 0 then '"new"' else 'W/"' || md5(own) || '"' end as tag from joined)
select 8 * page_id + 2 * nth + 1 as record_id, url, ts, response_id, outcome,
    case when page_id % 11 = 0 then 'date: ' || ts
        when outcome = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || length(other) || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || tag || chr(10) || 'expires: ' || (ts + 400)
        else 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || tag || chr(10) || 'expires: ' || (ts + 400) end as headers
from judged
"""
