"""Collocations held against plain counting of all phrases, and their arithmetic against Python's whole numbers."""

import random
import re
from collections import Counter

import data
import duckdb
import pytest

from lexiprint.llm import phrases
from lexiprint.llm.queries import ORACLES, QUERIES


def plain(rows, least, longest=phrases.WORDS, top=phrases.TOP):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    chosen = {g for g, a in f.items() if len(g) > 2 and a >= least}
    covered = {(g[0], *g[i : i + k]) for g in chosen for k in range(2, len(g) - 1) for i in range(1, len(g) - k + 1) if f[g] >= f[g[0], *g[i : i + k]]}
    by_lang = {}
    for g in chosen - covered:
        lang, *w = g
        a = f[g]
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in by_lang.items() for i, x in enumerate(sorted(found)[:top])]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def texts(seed):
    r = random.Random(seed)
    names = ["the", "of", "New", "york", "Ünï", "x-1", "it's", "\xa0", "a\x1cb"]
    out = []
    for i in range(120):
        words = [r.choice(names[: r.randint(2, 9)]) for _ in range(r.randint(0, 60))]
        out.append((r.choice(["en", "de", None, ""]), "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for w in words)))
    passage = "copied again and again, word for word: as it is"
    return out + [("en", passage)] * 70 + [(None, None), ("de", ""), ("en", " .,\n"), ("fr", "ha " * 200)]


@pytest.mark.parametrize(("least", "longest", "top", "block"), [(100, 5, 2000, phrases.BLOCK), (5, 5, 2000, 1500), (12, 3, 4, 3000), (3, 2, 50, 700), (1, 5, 2000, 9000)])
def test_collocations_against_plain_counts(spark, least, longest, top, block):
    rows = texts(least)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = phrases.collocations(docs.repartition(3), least, longest, top, block)
    assert got.dtypes == [*zip(COLUMNS, ["string", "bigint", "string", *["bigint"] * 5])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows, least, longest, top))


def test_repeated_texts_count_each_time(spark):
    docs = spark.createDataFrame([(1, "a b", "en")] * 500 + [(2, "b a", "en")] * 99, "doc_id long, text string, lang string")
    assert [tuple(r) for r in phrases.collocations(docs).collect()] == [("en", 1, "a b", 500, 599, 599, 1198, 1669)]


def test_products_of_over_64_bits_are_exact(spark):
    a, left, right, n = 2**45 + 7, 2**47 + 11, 2**46 + 13, 2**52 + 5
    table = spark.createDataFrame([("en", "", n), ("en", "p q", a), ("en", "p", left), ("en", "q", right)], "lang string, gram string, n long")
    row = phrases.scored(table).first()
    assert (row["score"], row["l"], row["r"]) == (1000 * a * n // (left * right), left, right)


def test_awkward_rows_and_empty_table(spark):
    docs = data.documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs, 30).collect()) == sorted(plain(rows, 30))
    assert phrases.collocations(data.empty(spark)).count() == 0


def test_query_against_sql_and_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(plain(rows, phrases.LEAST))
    assert want
    assert sorted(tuple(r) for r in QUERIES["op13_collocations"](spark, sf).collect()) == want
    db = duckdb.connect()
    db.execute(f"create view documents as from '{sf}/documents.parquet'")
    assert sorted(db.sql(ORACLES["op13_collocations"]).fetchall()) == want


def test_a_block_counts_by_places_in_its_vocabulary():
    """Distinct pieces with multiplicities, of two languages with the same words, against plain counting."""
    rng = random.Random(5)
    pieces = {(lang, b" ".join(rng.choices([b"a", b"b", b"\xff", "é".encode(), b"aa"], k=rng.randint(1, 9)))): rng.randint(1, 4) for lang in ("de", "und") for _ in range(300)}
    body = phrases._body(phrases.pa.table([*map(list, zip(*((lang, p, m) for (lang, p), m in sorted(pieces.items()))))], schema=phrases._GRAMS))
    texts = phrases.pa.table({"block": [7, 7], "body": phrases.pa.array([body, body], phrases.pa.binary())})
    naive = Counter()
    for (lang, p), m in pieces.items():
        w = p.split(b" ")
        naive.update({(lang, b""): 2 * m * len(w)})
        for k in range(1, 6):
            for i in range(len(w) - k + 1):
                naive[lang, b" ".join(w[i : i + k])] += 2 * m
    got, answer = {}, None
    for run in (lambda t, _: phrases._words(3)(t), phrases._phrases(3, 5, True), phrases._phrases(3, 5, False)):
        sent = run(texts, answer)
        answer = sent.select(["block", "body"])
        where = {}
        for bucket, b in zip(sent["bucket"].to_pylist(), sent["body"].to_pylist()):
            for row in phrases._read(b).to_pylist():
                assert where.setdefault((row["lang"], row["gram"]), bucket) == bucket and (row["lang"], row["gram"]) not in got
                got[row["lang"], row["gram"]] = row["n"]
    assert got == naive
    assert len({w.lang: w for w in phrases._by_language(texts)}["de"].vocabulary) == 5
