import re

import xxhash
from data import WIDE, documents, empty, wide, words

from lexiprint.llm import simhash


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    """Brute force over all pairs."""
    ids = sorted(fps)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_and_components_match_brute_force(spark):
    docs = documents(spark)
    got = simhash.simhash_digest(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


def test_whole_table_of_fingerprints_against_brute_force(spark):
    """Chains of links and a crowded ball, with cells cut in pieces."""
    import random

    r = random.Random(3)
    fps, x = [], r.getrandbits(64)
    for _ in range(60):  # a chain
        fps.append(x)
        for b in r.sample(range(64), 4):
            x ^= 1 << b
    hub = r.getrandbits(64)
    fps += [hub ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(150)]
    fps += [r.getrandbits(64) for _ in range(300)]
    fps = dict(enumerate(dict.fromkeys(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    nodes = spark.createDataFrame(signed, "node long, fp long")
    want = plain_components(fps)
    for piece, agree in ((16, None), (1024, 3)):
        found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, piece=piece, agree=agree)).collect()}
        assert {i: found.get(i, i) for i in fps} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_empty_table_and_null_identifier(spark):
    assert simhash.simhash_digest(empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, words(9, 1)), (4, words(9, 1)), (None, words(9, 2))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_digest(docs).collect()} == {(None, 4), (4, 4), (None, None)}


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs).collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    ids = sorted(r["doc_id"] for r in kept)
    assert len(ids) == len(set(ids)) and 20 in ids and 21 not in ids and 0 in ids and 1 not in ids and 100 in ids


def test_rows_without_identifier_link_and_stay(spark):
    base = 0x0123456789ABCDEF
    far = [base, base ^ 0b1111, base ^ 0b11111111]  # the ends meet through the middle only
    prints = spark.createDataFrame([(5, far[0]), (None, far[1]), (9, far[2])], "doc_id long, fp long")
    assert {r["component_id"] for r in simhash._named(prints, 4, simhash.SEGMENT).collect()} == {5}
    a, b, c, d = (words(60, n) for n in range(4))
    rows = [(None, a), (None, b), (None, b), (4, c), (4, d), (None, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(None, a), (None, b), (4, c), (4, d)], key=str)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIGHT", 50)
    edges = spark.createDataFrame([(3, i) for i in range(10, 200)] + [(i, i + 1000) for i in range(10, 30)] + [(5000, 5001)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys([3, *range(10, 200), *range(1010, 1030)], 3) | {5000: 5000, 5001: 5000}


def test_cells_get_finer_with_the_number_of_fingerprints():
    found = [simhash.agreeing(10**n) for n in range(3, 11)]
    assert found == sorted(found) and found[0] == 2 and found[-1] == 4


def test_wide_identifiers_come_back(spark):
    docs = wide(spark, [words(60, i) for i in range(20)])
    assert sorted(map(str, (r["doc_id"] for r in simhash.simhash_digest(docs).collect()))) == sorted(map(str, WIDE * 4))
