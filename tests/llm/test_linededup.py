import random

import duckdb
import pytest

from lexiprint.llm import linededup

SCHEMA = "page_id long, url string, html string, host string, lines string"


def pages(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        host = "big.example" if i % 3 == 0 else f"h{r.randrange(12)}.example"
        body = [f"<p>own {i} {r.random()}</p>" for _ in range(r.randint(0, 4))]
        if r.random() < 0.5:
            body.append("<div>Shared  NAV line</div>" if i % 2 else "<li>shared nav <b>line</b></li>")
        if r.random() < 0.1:
            body.append("rare line<br>")
        rows.append((i, f"https://u@{host.upper()}:80/p{i}", "<script>if (a<b) {}</script>" + "".join(body) + "a &amp;lt; b", "x", "y"))
    rows += [(900, None, "<p>shared nav line</p>", None, None), (901, "no url", None, None, None), (902, "http://alone.example/", "one<br>one<br>two", None, None), (903, "http://big.example/", "", None, None), (None, "http://big.example/", "Shared nav line", None, None)]
    rows += [rows[0]] * 3
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows, least=1):
    import re

    def lines_of(h):
        h = re.sub(r"(?is)<script\b.*?</script>", " ", h or "")
        h = re.sub(linededup.BREAKS, "\n", h)
        h = re.sub("<[^>]*>", " ", h)
        for e, c in linededup.ENTITIES:
            h = h.replace(e, c)
        return [x for x in (re.sub(r"[ \t\r\f]+", " ", x).strip(" ") for x in h.split("\n")) if x]

    def host(u):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "")
        return m[1].lower() if m else None

    split = [(r["page_id"], host(r["url"]), lines_of(r["html"])) for r in rows]
    out = []
    for i, h, ls in split:
        mine = [set(map(str.lower, x)) for _, g, x in split if g == h and h]
        drop = {x for x in {y.lower() for y in ls} if h and (k := sum(x in m for m in mine)) >= least and k > len(mine) * linededup.RATIO}
        kept = [x for x in ls if x.lower() not in drop]
        out.append((i, h, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [linededup.SENT_LINES, 0])
def test_matches_brute_force_and_sql(spark, monkeypatch, sent):
    monkeypatch.setattr(linededup, "SENT_LINES", sent)
    df = pages(spark)
    got = sorted(map(tuple, linededup.drop_boilerplate(df).collect()), key=repr)
    want = plain(df.collect())
    assert got == want and any(r[3] for r in want)
    # the ratio alone: the one page of a host holds each of its lines
    assert (902, "alone.example", 3, 3, "") in want
    fewer = sorted(map(tuple, linededup.drop_boilerplate(df, least_pages=3).collect()), key=repr)
    assert fewer == plain(df.collect(), 3) and "one\none\ntwo" in {r[4] for r in fewer}
    frame = df.select("page_id", "url", "html").toPandas()
    con = duckdb.connect()
    con.register("pages", frame)
    assert sorted(con.sql(linededup.SQL).limit(100_000).fetchall(), key=repr) == want


def test_empty(spark):
    assert linededup.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
