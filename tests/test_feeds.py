"""Paged feeds: equal to the rows they were written from, pages skipped by filters, odd pages."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiprint.plans import feeds
from lexiprint.sources import paged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["atom", "json"])
def test_a_feed_gives_back_what_was_written(spark, kind):
    odd = [(-1, "left out"), (3000, "a < b & c > d\r\n\x0bcarriage ]]> ümlaut \U0001f600"), (3001, None), (3002, "")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = feeds.entries(docs).cache()
    found = feeds.feed(spark, feeds.written(spark, rows, kind), kind)
    columns = ["id", "title", "summary", "published", "page"]
    assert dict(found.dtypes) == {"id": "string", "title": "string", "summary": "string", "published": "timestamp", "page": "int"}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.select(columns).collect()))
    assert rows.count() == 203


def test_filters_skip_pages(spark):
    rows = feeds.entries(spark.read.parquet(f"{SF}/documents.parquet"))
    found = feeds.feed(spark, feeds.written(spark, rows, "atom"), "atom")
    assert found.rdd.getNumPartitions() == 4
    chosen = found.filter(F.col("published") < F.lit("2024-01-03 02:00:00").cast("timestamp"))
    assert chosen.rdd.getNumPartitions() == 1 and chosen.count() == 50
    assert found.filter("page in (1, 3)").rdd.getNumPartitions() == 2 and found.filter("page = 2").count() == 50
    late = found.filter(F.col("published") >= F.lit("2024-01-05 00:00:00").cast("timestamp"))
    assert late.rdd.getNumPartitions() == 3 and late.count() == 104
    assert "page" in found.filter("page = 2")._jdf.queryExecution().executedPlan().toString()


def test_many_pages_share_a_task(spark, tmp_path):
    for n in range(300):
        (tmp_path / f"page={n}").mkdir()
        (tmp_path / f"page={n}" / "x.json").write_text(json.dumps({"entries": [{"id": str(n)}] * (n % 3)}))
    found = feeds.feed(spark, str(tmp_path), "json")
    assert paged.LEAST - 4 <= found.rdd.getNumPartitions() <= paged.LEAST + 1
    assert sorted((int(r["id"]), r["page"]) for r in found.collect()) == [(n, n) for n in range(300) for _ in range(n % 3)]
    sizes = [(n, str(n), 3 * paged.FULL if n == 5 else paged.FULL // 4) for n in range(1000)]
    parts = [p.pages for p in paged.packed(sizes)]
    assert [x for p in parts for x in p] == [x[:2] for x in sizes] and max(map(len, parts)) == 4 and len(parts) < 260


def test_pages_without_entries_and_broken_parts(spark, tmp_path):
    for n, body in enumerate(['{"entries": [{"id": "1"}, {"id": "2", "published": "no time", "title": "t"}]}', "", '{"entries": null}']):
        (tmp_path / f"page={n}").mkdir()
        (tmp_path / f"page={n}" / "x.json").write_text(body)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "y.json").write_text("{}")
    got = [tuple(r) for r in feeds.feed(spark, str(tmp_path), "json").collect()]
    assert sorted(got) == [("1", None, None, None, 0), ("2", "t", None, None, 0)]
    assert paged._time("2024-01-01T02:00:00+02:00").isoformat() == "2024-01-01T00:00:00+00:00"
    assert list(paged.atom_entries(b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>7</id></entry></feed>')) == [("7", None, None, None)]
    assert list(paged.json_entries(json.dumps({"entries": [{"id": "8"}]}).encode())) == [("8", None, None, None)]


@pytest.mark.parametrize("name", list(feeds.QUERIES))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as from '{SF}/documents.parquet'")
    want = db.sql(feeds.ORACLES[name])
    assert sorted(map(tuple, feeds.QUERIES[name](spark, SF).select(want.columns).collect())) == sorted(want.fetchall())
