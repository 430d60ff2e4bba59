import random
import zlib
from collections import defaultdict

import pytest
from data import documents, empty

from lexiprint.llm import common, sharding


def brute(sizes, shards):
    """Least capacity and the number of groups before each cut, by trying capacities."""

    def fill(cap):
        cuts, held = [], 0
        for i, s in enumerate(sizes):
            if held + s > cap:
                cuts.append(i)
                held = 0
            held += s
        return cuts

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if len(fill(mid)) < shards else (mid + 1, hi)
    return lo, fill(lo)


@pytest.mark.parametrize("seed,n,shards,hot", [(0, 500, 24, 0), (1, 2000, 24, 90_000), (2, 10, 24, 0), (3, 700, 3, 5), (4, 1, 24, 0), (5, 300, 7, 20)])
def test_cuts_are_those_of_brute_force(spark, seed, n, shards, hot):
    r = random.Random(seed)
    wide = r.choice([10, 40, 63])
    keys = sorted({r.getrandbits(wide) - (1 << wide - 1) for _ in range(n)})
    sizes = [r.randint(8, 400) + (hot if i == len(keys) // 2 else 0) for i in range(len(keys))]
    groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    cap, cuts = sharding.minimax_cuts(groups, shards, first=4, finer=3)
    want_cap, want_cuts = brute(sizes, shards)
    assert (cap, cuts) == (want_cap, [keys[i] for i in want_cuts])


def test_documents(spark):
    docs = documents(spark)
    got = sharding.shard_documents(docs).collect()
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < 24 and min(slots) >= 0
    assert all(len(v) == 1 for v in shard_of.values())


def test_empty(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0
    assert sharding.minimax_cuts(spark.createDataFrame([], "key long, size long")) == (0, [])


@pytest.mark.parametrize("hot,shards", [([10], 24), ([10, 400], 24), ([0], 8), ([499], 8), ([7], 3)])
def test_groups_beside_an_oversized_one_are_spread(spark, hot, shards):
    r = random.Random(len(hot) + shards)
    sizes = [r.randint(8, 400) + (40_000 if i in hot else 0) for i in range(500)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    capacity, cuts = sharding.even_cuts(groups, shards)
    assert capacity == brute(sizes, shards)[0] and cuts == sorted(set(cuts)) and len(cuts) < shards
    held = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, 500])]
    assert max(held) == capacity
    if shards > 3:
        assert len(cuts) == shards - 1
        rest = [h for h in held if h < 40_000]
        assert max(rest) < 1.35 * sum(rest) / len(rest)


def test_repeated_rows_of_one_identifier_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LIGHT", 40)
    assert common.LIGHT > 1000
    docs = spark.createDataFrame([(None, "same text") for _ in range(500)] + [(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert len(got) == 800 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({x["shard"] for x in got if x["doc_id"] is None}) == 1


def test_sizes_are_near_equal(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * r.randint(50, 500)) for i in range(3000)], "doc_id long, text string")
    held = defaultdict(int)
    for x in sharding.shard_documents(docs).collect():
        held[x["shard"]] += x["size"]
    assert len(held) == 24 and max(held.values()) < 1.05 * sum(held.values()) / 24
