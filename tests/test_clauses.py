"""Clauses and pairs held against plain Python over random trees, and the named queries against their SQL."""

import random

import duckdb
import pytest

from lexiprint.operators import clauses as C
from lexiprint.operators import tokens as K
from lexiprint.plans import parses

TOKENS = "doc_id long, tokens array<struct<text: string, lemma: string, pos: string, dep: string, head: int, sent: int, ent: string>>"
WORDS = ["ask", "and", "or", "However", "Thus", ",", ";", ":", "—", ".", "go", "sun", "--", "But", "However,"]
DEPS = ["ROOT", "conj", "advcl", "ccomp", "punct", "nsubj", "det"]


def sentence(r, base, sent):
    """A random tree over up to 14 tokens, crossing arcs included; now and then with several roots."""
    n = r.randint(1, 14)
    order = r.sample(range(n), n)
    out = [None] * n
    for k, j in enumerate(order):
        head = j if k == 0 or r.random() < 0.05 else order[r.randrange(k)]
        out[j] = {"text": r.choice(WORDS), "lemma": "x", "pos": r.choice(["NOUN", "VERB", "DET", "PUNCT", "ADV"]), "dep": "ROOT" if head == j else r.choice(DEPS[1:]), "head": base + head, "sent": sent, "ent": None}
    return out


def document(r):
    out = []
    for s in range(r.randint(0, 6)):
        out += sentence(r, len(out), s)
    return out


def plain_clauses(tokens):
    children = {i: [j for j, t in enumerate(tokens) if t["head"] == i and j != i] for i in range(len(tokens))}

    def under(i):
        return {i}.union(*(under(j) for j in children[i]))

    found = [[min(under(i)), max(under(i)), i, C.ANCHORS[d]] for wanted in (["ROOT"], ["conj"], ["advcl", "ccomp"]) for i, t in enumerate(tokens) if (d := t["dep"]) in wanted]
    found.sort(key=lambda c: c[0])
    for a, b in zip(found, found[1:]):
        if a[1] >= b[0]:
            region = range(b[0], min(a[1], b[1]) + 1)
            at = next((i for marks in (C.STRONG, C.MARKS) for i in region if tokens[i]["text"] in marks), None)
            end, start = (at - 1, at + 1) if at is not None else ((region[0] + region[-1]) // 2, (region[0] + region[-1]) // 2 + 1)
            if end >= a[0]:
                a[1] = end
            if start <= b[1]:
                b[0] = start
    return found


def plain_pairs(tokens):
    found, out = plain_clauses(tokens), {}
    text = [t["text"] for t in tokens]

    def add(a, b, kind):
        out.setdefault((a[0], a[1], b[0], b[1]), kind)

    by_head = sorted(found, key=lambda c: c[2])
    for a, b in zip(by_head, by_head[1:]):
        hung = any(t["dep"] == "punct" and t["text"] in C.PAIR_MARKS and t["head"] in (a[2], b[2]) for j, t in enumerate(tokens))
        if hung or any(text[i] in C.PAIR_MARKS for i in range(a[2] + 1, b[2])):
            add(*((b, a) if a[0] > b[0] else (a, b)), "punctuation")
    for a, b in zip(found, found[1:]):
        if any(text[i].lower() in C.CONJUNCTIONS for i in [*range(a[0], a[1] + 1), *range(b[0], b[1] + 1), *range(a[1] + 1, b[0])]):
            add(a, b, "conjunction")
    for a, b in zip(found, found[1:]):
        if b[1] > b[0] and {text[b[0]], text[b[0]] + text[b[0] + 1]} & {f"{w}," for w in C.TRANSITIONS}:
            add(a, b, "transition")
    return out


@pytest.fixture(scope="module")
def parsed(spark):
    r = random.Random(11)
    rows = [(i, document(r)) for i in range(400)] + [(1000, None), (1001, [])]
    return dict(rows), spark.createDataFrame(rows, TOKENS).cache()


def test_clauses_against_plain_python(parsed):
    rows, docs = parsed
    got = {}
    for r in C.clauses(docs).orderBy("doc_id", "clause").collect():
        got.setdefault(r["doc_id"], []).append([r["start"], r["end"], r["head"], r["kind"]])
        assert r["words"] == [t["text"] for t in rows[r["doc_id"]][r["start"] : r["end"] + 1]]
    assert got == {i: c for i, t in rows.items() if (c := plain_clauses(t or []))}


def test_pairs_against_plain_python(parsed):
    rows, docs = parsed
    got, kinds = {}, set()
    for r in C.pairs(docs).collect():
        key = (r["a_start"], r["a_end"], r["b_start"], r["b_end"])
        assert key not in got.setdefault(r["doc_id"], {})
        got[r["doc_id"]][key] = r["kind"]
        kinds.add(r["kind"])
        t = rows[r["doc_id"]]
        assert r["zone_a"] == [x["text"] for x in t[key[0] : key[1] + 1] if x["pos"] in C.CONTENT][-3:]
        assert r["zone_b"] == [x["text"] for x in t[key[2] : key[3] + 1] if x["pos"] in C.CONTENT][:3]
    assert got == {i: p for i, t in rows.items() if (p := plain_pairs(t or []))} and kinds == {"punctuation", "conjunction", "transition"}


def test_structure_of_documents_without_clauses(parsed):
    rows, docs = parsed
    got = {r["doc_id"]: r.asDict() for r in C.structure(docs).collect()}
    assert got.keys() == rows.keys()
    for i in (1000, 1001):
        assert all(v == 0 for k, v in got[i].items() if k != "doc_id")
    for i, t in rows.items():
        if t:
            found = plain_clauses(t)
            assert got[i]["clause_count"] == len(found) and got[i]["clause_length_max"] == max(c[1] - c[0] + 1 for c in found)
            assert got[i]["pairs_per_sentence"] == pytest.approx(len(plain_pairs(t)) / len({x["sent"] for x in t}))


def test_depths(spark):
    r = random.Random(2)
    rows = [(i, document(r)) for i in range(100)] + [(1000, [dict(sentence(r, 0, 0)[0], head=max(0, i - 1)) for i in range(3000)])]
    docs = spark.createDataFrame(rows, TOKENS)
    got = {x["doc_id"]: x["d"] for x in docs.select("doc_id", C.depths(C.F.transform("tokens", lambda t: t["head"])).alias("d")).collect()}
    for i, tokens in rows:
        want = []
        for j in range(len(tokens)):
            steps, at = 0, j
            while tokens[at]["head"] != at:
                at, steps = tokens[at]["head"], steps + 1
            want.append(steps)
        assert got[i] == want


def test_long_documents_stay_linear(spark):
    """A sentence of many thousand words, and a document of many thousand sentences."""
    r = random.Random(4)
    one = [{"text": r.choice(WORDS), "lemma": "x", "pos": "NOUN", "dep": r.choice(DEPS[1:]), "head": min(i + r.randint(1, 3), 3999), "sent": 0, "ent": None} for i in range(4000)]
    one[3999] |= {"dep": "ROOT", "head": 3999}
    many = []
    for s in range(4000):
        many += sentence(r, len(many), s)
    docs = spark.createDataFrame([(1, one), (2, many)], TOKENS)
    found = {}
    for x in C.clauses(docs).collect():
        found.setdefault(x["doc_id"], []).append([x["start"], x["end"], x["head"], x["kind"]])
    assert len(found[1]) > 1000 and len(found[2]) > 8000


@pytest.mark.parametrize("name", list(parses.QUERIES))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as from '{sf}/documents.parquet'")
    want = db.sql(parses.ORACLES[name])
    got = parses.QUERIES[name](spark, sf)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert rows == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)


def test_numbers_count_once_a_pattern(spark):
    word = {"lemma": "x", "pos": "NOUN", "dep": "det", "head": 0, "ent": None}
    tokens = [{**word, "text": "abcd", "sent": i // 10} for i in range(38)] + [{**word, "text": "7", "pos": "NUM", "sent": 4}]
    text = "In 2024 they sold 1,500 of 3.5 and $40 for 2 million, or 1/2. " + "word " * 20
    row = K.token_features(spark.createDataFrame([(1, text, tokens)], TOKENS.replace("doc_id long,", "doc_id long, text string,")), ("information",)).first()
    # the year, the comma number, the decimal, the price, the word number, the fraction, and the digits among the tokens
    assert row["information_specific_number_rate"] == pytest.approx(min(7 * 100 / 38 / 5, 1))


def test_extents_of_a_batch_and_no_sorts(spark):
    """Extents and depths were sorted out by higher-order functions in each round; they are taken over a batch at once."""
    r = random.Random(3)
    rows = [(k, [r.choice([r.randrange(-2, n + 2), i, None]) for i in range(n)], sorted({0, *(r.randrange(n) for _ in range(3))}) if n else []) for k, n in enumerate([0, 1, 5, 40, 0, 90, 3])]
    df = spark.createDataFrame(rows, "id int, heads array<int>, borders array<int>")
    made = df.select("id", C.extents(C.F.transform("heads", lambda x: C.F.coalesce(x, C.F.lit(-1))), "borders").alias("x"), C.depths("heads").alias("d"))
    assert "sort_array" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "aggregate(" not in plan
    got = {x["id"]: x for x in made.collect()}
    for k, heads, borders in rows:
        n = len(heads)
        low, high = list(range(n)), list(range(n))
        ends = {b: e for b, e in zip(borders, [*borders[1:], n])}
        for i in range(n):
            at, b, seen = i, max(x for x in borders if x <= i), set()
            while at not in seen:
                seen.add(at)
                low[at], high[at] = min(low[at], i), max(high[at], i)
                at = heads[at] if heads[at] is not None and b <= heads[at] < ends[b] else at
        assert [(x["low"], x["high"]) for x in got[k]["x"]] == list(zip(low, high))
        assert len(got[k]["d"]) == n
