"""Runs held against a search over all periods, and the query's digests against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import data
import pytest

from lexiprint.llm import runs
from lexiprint.llm.queries import QUERIES


def brute(words, exponent=runs.EXPONENT, least=runs.LEAST):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= exponent * p and j > i:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(runs.Run(s, e - s, q) for (s, e), q in found.items() if e - s >= least)


def repetitive(r):
    out = []
    while len(out) < r.randint(0, 250):
        if out and r.random() < 0.5:
            back = r.randint(1, min(len(out), r.choice([3, 12, 40])))
            for _ in range(r.randint(1, 80)):
                out.append(out[-back])
        else:
            out.append(r.randrange(4))
    return out


@pytest.mark.parametrize("exponent", [2, 3, 4, 5])
def test_runs_against_all_periods(exponent):
    r = random.Random(exponent)
    for _ in range(700):
        words = repetitive(r) if r.random() < 0.7 else [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 80))]
        assert runs.find_runs(words, exponent, 1) == brute(words, exponent, 1)
        assert runs.find_runs(words, exponent) == brute(words, exponent)


def test_factors_are_the_longest_that_start_earlier():
    r = random.Random(5)
    for _ in range(200):
        words = repetitive(r)
        at = 0
        for start, length, back in runs.SuffixAutomaton(words).factors(words):
            assert start == at
            longest = max((next((k for k in range(len(words) - at + 1) if at + k == len(words) or words[i + k] != words[at + k]), 0) for i in range(at)), default=0)
            assert length == max(1, longest)
            if back:
                assert words[start - back : start - back + length] == words[start : start + length]
            at += length
        assert at == len(words)


def test_long_texts_take_linear_time():
    r = random.Random(3)
    assert runs.find_runs([0] * 300_000) == [runs.Run(0, 300_000, 1)]
    block = [r.randrange(50) for _ in range(30_000)]
    assert runs.Run(0, 150_000, 30_000) in runs.find_runs(block * 5)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-Fraction(x.length, x.period), x.start, x.period), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    four = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return (doc_id, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_digest_against_plain_python(spark):
    r = random.Random(8)
    names = ["a", "b", "Ü", "çé", "it's", "x-y"]
    extra = [(1000 + i, r.choice([" ", "\n", "\t \x0b"]).join(names[w] for w in repetitive(r))) for i in range(150)]
    extra += [(None, "a " * 30), (-5, "no\xa0break " * 9), (2000, None), (2001, "z " * 500)]
    docs = data.documents(spark, extra)
    got = runs.runs_digest(docs)
    assert dict(got.dtypes) == dict.fromkeys(COLUMNS[:6], "bigint") | dict.fromkeys(COLUMNS[6:], "string")
    rows = [tuple(x) for x in got.select(COLUMNS).collect()]
    want = [expected(x["doc_id"], x["text"]) for x in docs.collect() if x["doc_id"] not in (5, 6)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((x for x in rows if x[0] not in (5, 6)), key=key) == sorted(want, key=key)
    assert sum(x[0] in (5, 6) for x in rows) == 2


def test_operator_gives_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "go on and on and on and on and on now"), (1, "x"), (None, None), (2, " \n")], "doc_id long, text string")
    rows = {(r["doc_id"], r["n_words"]): r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in rows[1, 11]["runs"]] == [(1, 9, 2)]
    assert rows[1, 11]["collapsed"] == "go on and now"
    assert rows[1, 1]["runs"] == [] and rows[1, 1]["collapsed"] == "x"
    assert rows[None, 0]["collapsed"] == "" and rows[2, 0]["collapsed"] == ""


def test_empty_table_and_query(spark):
    assert runs.runs_digest(data.empty(spark)).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op11_periodic_runs"](spark, sf)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in rows.select(COLUMNS).collect()}
    assert got.keys() == docs.keys()
    short = [i for i in docs if len(docs[i] or "") < 8000]
    assert all(got[i] == expected(i, docs[i]) for i in short)
    assert any(got[i][1] for i in short)
