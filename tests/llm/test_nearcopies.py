import random

import corpus_pipeline
from data import documents, empty, wide, words

from lexiprint.llm import nearcopies


def plain_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts, similarity=0.8):
    """Brute force over all pairs."""
    sets, label = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) > 0):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {root(i) for i in texts}


def edited(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for at in r.sample(range(len(w)), edits):
        w[at] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def planted():
    rows = [(i, words(40 + 4 * i, i)) for i in range(60)]
    for i in range(60):
        rows += [(1000 + 10 * i + k, edited(rows[i][1], 1 + k, 7 * i + k)) for k in range(4)]
    base = words(150, 999)
    return rows + [(5000 + i, edited(base, 2, i)) for i in range(60)]


def test_the_stage_keeps_what_brute_force_keeps(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(dict(rows))
    assert len(want) < len(rows) / 2
    kept = sorted(r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert kept == sorted(want)


def test_pieces_meet_each_other(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = nearcopies._Hashes()
    nodes = spark.createDataFrame([(i, nearcopies.bands(nearcopies.shingles(t, known)).view("i8").tolist(), 8 * len(t.split())) for i, t in rows], "node long, bands array<long>, bytes long")
    texts = docs.withColumnRenamed("doc_id", "node")
    for piece, size in ((8, 1 << 24), (1024, 1 << 24), (1024, 5_000)):
        monkeypatch.setattr(nearcopies, "PIECE_BYTES", size)
        found = {r["node"]: r["component"] for r in nearcopies.components(nearcopies.links(nodes, texts, piece=piece)).collect()}
        assert {found.get(i, i) for i, _ in rows} == plain_groups(dict(rows))


def test_rows_without_identifier_and_texts_under_one_identifier_stay(spark):
    a, b, c, d, e = (words(60, n) for n in range(5))
    rows = [(None, a), (None, b), (None, b), (4, c), (4, d), (None, c), (None, edited(e, 1, 1)), (None, e)]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["text"]) for r in kept), key=str)
    assert len(found) == 5 and {(None, a), (None, b), (4, c), (4, d)} <= set(found)
    assert len({t for _, t in found} & {e, edited(e, 1, 1)}) == 1


def test_awkward_documents(spark):
    docs = documents(spark)
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns and nearcopies.keep_one(empty(spark)).count() == 0
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted(plain_groups({r["doc_id"]: r["text"] for r in docs.collect()}))


def test_wide_identifiers_and_other_columns_come_back(spark):
    docs = wide(spark, [words(60, i) for i in range(20)])
    assert sorted(map(str, nearcopies.keep_one(docs).collect())) == sorted(map(str, docs.collect()))
