import random

import pytest
from pyspark.sql import functions as F

from lexiprint.llm import warc

SCHEMA = "record_id long, kind string, url string, ts long, digest string, headers map<string,string>, at string, n int, span int"


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Ex.COM:80/a/?b=2&a=1&utm_source=x#top", "http://ex.com/a?a=1&b=2"),
        ("https://ex.com:443", "https://ex.com"),
        ("https://ex.com:8443/A?ref=1", "https://ex.com:8443/A"),
        ("  ftp://ex.com/p//  ", "ftp://ex.com/p"),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.range(1).select(warc.canonical_url(F.lit(url))).first()[0] == want


def records(seed=0, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choice(["response", "revisit", "revisit"])
        url = "http://hot.example/" if r.random() < 0.4 else f"http://h{r.randrange(40)}.example/"
        h = {"Date": str(i), "ETag": r.choice(['"a"', 'W/"a"', '"b"']), "Server": kind, "Expires": f"e{i}", "Last-Modified": r.choice(["m1", "m2"])}
        for k in [k for k in h if r.random() < 0.3]:
            del h[k]
        rows.append((i, kind, r.choice([url, url + "#f", url.upper().replace("HTTP", "http").replace("EXAMPLE", "example")]), r.choice([r.randrange(100), r.randrange(10**12)]), r.choice([None, None, "d"]), h))
    rows += [(n, "revisit", None, 5, None, {}), (n + 1, "revisit", "http://hot.example/", None, None, None), (n + 2, "response", "http://hot.example/", None, None, None), (n + 3, "revisit", "http://none.example/", 5, None, {"a": "b"}), (n + 4, "other", "http://hot.example/", 1, None, None)]
    rows += [rows[1]] * 3
    return rows


def plain(rows, canon):
    out = []
    for i, kind, url, ts, digest, h in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        earlier = [x for x in rows if x[1] == "response" and None not in (x[3], ts, url, x[2]) and canon[x[2]] == canon[url] and x[3] < ts]
        if not earlier:
            out.append((i, None, "missing", h))
            continue
        o = max(earlier, key=lambda x: (x[3], x[0]))
        oh = {k.lower(): v for k, v in (o[5] or {}).items()}
        tag = lambda x: x.get("etag") and x["etag"].removeprefix("W/")
        pairs = [(a, b) for a, b in ((digest, o[4]), (tag(h), tag(oh)), (h.get("last-modified"), oh.get("last-modified"))) if a and b]
        outcome = "unverifiable" if not pairs else "resolved" if all(a == b for a, b in pairs) else "mismatch"
        out.append((i, o[0], outcome, oh | {k: v for k, v in h.items() if k in warc.PERMITTED} if outcome == "resolved" else h))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed):
    rows = records(seed)
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    canon = {r["url"]: r["c"] for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).distinct().collect()}
    got = sorted(((r["record_id"], r["response_id"], r["outcome"], dict(r["headers"])) for r in warc.resolve_revisits(df).collect()), key=repr)
    want = plain(rows, canon)
    assert [(a, b, c, sorted(d.items())) for a, b, c, d in got] == [(a, b, c, sorted(d.items())) for a, b, c, d in want]
    assert {r[2] for r in want} == {"resolved", "mismatch", "unverifiable", "missing"}


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    assert warc.page_revisits(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stray_times_do_not_widen_the_spans(spark):
    """Captures of one URL within a minute, one at the epoch and one far ahead."""
    times = [0, 10**15, *range(10**12, 10**12 + 6000, 3)]
    facts = spark.createDataFrame([("u", t) for t in times], "url string, ts long")
    points = spark.createDataFrame([("u", 10**12 + 2 * i) for i in range(3000)] + [("u", 0), ("u", 2 * 10**15)], "url string, ts long")
    got = {r["ts"]: r["at"] for r in warc.as_of(points, facts).collect()}
    assert all(got[t] == max((x for x in times if x < t), default=None) for t in got) and len(got) == 3002
    bounds = list(range(10**12, 10**12 + 6000, 7))
    spans = facts.select(warc._span(F.col("ts"), bounds).alias("s"), "ts").collect()
    assert all(r["s"] == sum(b <= r["ts"] for b in bounds) for r in spans)


def test_log_makes_the_join_choose(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example/a", f"page {i}") for i in range(60)], "page_id long, url string, html string")
    got = {r["record_id"]: r for r in warc.page_revisits(pages).collect()}
    assert len(got) == 60 * warc.ROUNDS
    assert {got[8 * 5 + 3]["response_id"]} == {8 * 5} and got[8 * 4 + 3]["response_id"] == 8 * 4 + 2
    assert {r["outcome"] for r in got.values()} == {"resolved", "mismatch", "unverifiable"}
