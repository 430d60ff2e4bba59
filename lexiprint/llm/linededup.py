"""Boilerplate lines by their frequency within a site.

A line's ratio is the share of a host's pages that hold it.  Lines above the
ratio are dropped from the host's pages.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import attach, cut

#: A line is boilerplate on a host if more than this share of the host's pages hold it, and so many pages at least.
RATIO = 0.2
LEAST_PAGES = 1
#: Line hashes that are sent to every task at most (8 bytes each); more are joined by a shuffle.
SENT_LINES = 2_000_000

#: Elements that end a line, and those whose content is no text.
BREAKS = r"(?i)<(?:br|hr|/p|/div|/li|/ul|/ol|/h[1-6]|/title|/nav|/article|/section|/header|/footer|/tr|/td|/table|/blockquote)\b[^>]*>"
HIDDEN = [r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(html: Column) -> Column:
    """Text of a page with a line for every block element."""
    out = F.coalesce(html.cast("string"), F.lit(""))
    for pattern in HIDDEN:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without its port; null without one."""
    host = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def site_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, n, lines``: pages of each host and hashes of its boilerplate lines.

    ``pages`` has ``host`` and ``hashes``, the line hashes of a page.  A host
    has at most (mean distinct lines of its pages) / ratio such lines.
    """
    known = pages.filter("host is not null")
    totals = cut(known.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    counts = known.select("host", F.explode(F.array_distinct("hashes")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= least_pages)
    with_total = attach(counts, totals.withColumn("total", F.col("n")), "host", "n", totals.agg(F.sum("n")).first()[0] or 0)
    flagged = with_total.filter(F.col("held") > F.col("total") * ratio)
    return flagged.groupBy("host").agg(F.max("total").alias("n"), F.collect_set("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every row of ``pages`` (``page_id, url, html``).

    Lines are trimmed, white space in them is one space, and blank ones are
    left out; they are compared without case.  Pages without a host keep all
    lines.  The ratio alone decides; with ``least_pages`` a line must also
    stand on so many pages, so that a site of few pages keeps its text.
    A null page has no lines and the text ''.  Repeated rows are pages of their
    own.  A page of a hot host is dealt like any other: the host's few lines go
    to the pages, never the pages to the host.
    """
    lines = F.filter(F.transform(F.split(html_text(F.col("html")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), lambda x: x != "")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), lines.alias("all_lines"))
    hashed = split.withColumn("hashes", F.transform("all_lines", lambda x: F.xxhash64(F.lower(x))))
    boiler = cut(site_lines(hashed.select("host", "hashes"), ratio, least_pages))
    size = boiler.agg(F.sum(F.size("lines")), F.sum("n")).first()
    if (size[0] or 0) <= SENT_LINES:
        joined = hashed.join(F.broadcast(boiler.select(F.col("host").alias("_host"), "lines")), F.col("host") == F.col("_host"), "left").drop("_host")
    else:
        joined = attach(hashed, boiler, "host", "n", size[1])
    kept = F.filter("both", lambda x: F.col("lines").isNull() | ~F.array_contains("lines", x["hashes"]))
    out = joined.withColumn("both", F.arrays_zip("all_lines", "hashes")).withColumn("kept", F.transform(kept, lambda x: x["all_lines"]))
    return out.select("page_id", "host", F.size("all_lines").cast("long").alias("n_lines"), (F.size("all_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _sql_text() -> str:
    out = "coalesce(html, '')"
    for pattern in HIDDEN:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{BREAKS}', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


#: DuckDB SQL of ``drop_boilerplate`` over ``pages``.
SQL = rf"""
with split as (
    select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') as host,
        list_filter(list_transform(string_split({_sql_text()}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'))), lambda x: x <> '') as lines,
        row_number() over () as row_no
    from pages),
each as (select distinct row_no, host, trim(lower(line)) as line from (select row_no, host, unnest(lines) as line from split) where host is not null),
totals as (select host, count(*) as n from split where host is not null group by host),
boiler as (select host, line from (select host, line, count(*) as held from each group by host, line) join totals using (host) where held >= {LEAST_PAGES} and held > n * {RATIO}),
of_host as (select host, list(line) as boiler from boiler group by host)
select page_id, host, cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(kept) as bigint) as n_dropped, array_to_string(kept, chr(10)) as text
from (select page_id, host, lines, list_filter(lines, lambda x: not coalesce(list_contains(boiler, trim(lower(x))), false)) as kept from split left join of_host using (host))
"""
