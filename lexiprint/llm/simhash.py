"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into narrow segments; the vector of set bits per
segment embeds it so that the Manhattan distance of two vectors never exceeds
the fingerprints' Hamming distance.  Vectors within ``radius`` agree exactly on
at least ``k`` of ``radius + k`` groups of segments, so the grid has one cell
per choice of ``k`` groups and their counts; a join on cells finds every pair.
With ``k`` the cells get finer and a fingerprint has more of them; ``k`` follows
the number of fingerprints (``agreeing``) and no result depends on it.  Pairs in
a cell are kept if their whole Manhattan distance is within the radius, then
verified on the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import LIGHT, attach, attach_any, beside, cut, key_of, unused, with_texts

SEED = 42
BITS = 64
SEGMENT = 2
RADIUS = 4
WORDS = 4
#: Fingerprints compared with each other in one piece; fuller cells are compared piece by piece.
PIECE = 1024
_ROWS = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit ``hashes``; 0 without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS):
        part = hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority of the bits of all word shingles' XXH64, repeats included; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined, size = b" ".join(w), len(w)
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    first = words - 1
    if size <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[: size - words])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[first:])]
    return majority(np.array(hashes, dtype="<u8"))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield beside(b, [c for c in b.schema.names if c != "text"], fp=pa.array(got.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, *more: Column) -> DataFrame:
    """``doc_id, fp`` (a signed long with the 64 bits) of every whole text, and ``more`` columns between."""
    need = with_texts(docs).select(F.col("doc_id").cast("long"), *more, F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in need.schema if f.name != "text")
    return need.mapInArrow(_fingerprints(words), f"{schema}, fp long")


def embed(fp: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Set bits of each segment, one row a fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fp, dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(bits), BITS // segment, segment).sum(axis=2, dtype=np.int8)


def agreeing(n: int, radius: int = RADIUS, segment: int = SEGMENT, most: int = 4) -> int:
    """Groups that a cell fixes, for the least cost of ``n`` random fingerprints.

    A segment of 2 fair bits tells 1.5 bits of its fingerprint by its count, so
    a cell of k of radius + k groups holds n / 2**bits of them.  A row to sort
    and send counts as much as 64 comparisons within a cell.
    """
    spread = {1: 1.0, 2: 1.5, 4: 2.03}.get(segment, 0.5 * log2(2.08 * segment + 1))
    bits = lambda k: spread * (BITS // segment) * k / (radius + k)
    return min(range(2, most + 1), key=lambda k: comb(radius + k, k) * (64 + n / 2 ** bits(k)))


def _cells(radius: int, segment: int, agree: int):
    groups = np.array_split(np.arange(BITS // segment), radius + agree)
    choices = list(combinations(range(radius + agree), agree))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = embed(b["fp"].to_numpy(), segment).astype(np.int64)
            codes = [counts[:, g] @ (segment + 1) ** np.arange(len(g)) for g in groups]
            for n, chosen in enumerate(choices):
                cell = np.zeros(len(b), dtype=np.int64)
                for g in chosen:
                    cell = cell * (segment + 1) ** len(groups[g]) + codes[g]
                yield pd.DataFrame({"cell": cell * len(choices) + n, "fp": b["fp"], "node": b["node"]})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each index reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(b: pd.DataFrame, radius: int, segment: int) -> pd.DataFrame:
    """Links of a sorted run of whole cells, thinned to one to the smallest node of each connected set."""
    key, left, right, own = (b[c].to_numpy() for c in ("cell", "left", "right", "own"))
    fp = b["fp"].to_numpy().view(np.uint64)
    counts = embed(b["fp"].to_numpy(), segment)
    found_i, found_j = [], []
    i = np.arange(len(b))
    for step in range(1, len(b)):
        i = i[i + step < len(b)]
        j = i + step
        same = (key[i] == key[j]) & (left[i] == left[j]) & (right[i] == right[j])
        i, j = i[same], j[same]
        if not len(i):
            break
        due = (left[i] == right[i]) | (own[i] != own[j])
        p, q = i[due], j[due]
        near = np.abs(counts[p] - counts[q]).sum(axis=1, dtype=np.int32) <= radius
        p, q = p[near], q[near]
        near = np.bitwise_count(fp[p] ^ fp[q]) <= radius
        found_i.append(p[near])
        found_j.append(q[near])
    if not found_i or not sum(map(len, found_i)):
        return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
    p, q = np.concatenate(found_i), np.concatenate(found_j)
    label = _roots(len(b), p, q)
    node = b["node"].to_numpy()
    linked = np.unique(np.concatenate([p, q]))
    pairs = pd.DataFrame({"a": node[label[linked]], "b": node[linked]})
    return pairs[pairs["a"] != pairs["b"]].drop_duplicates()


def _links(radius: int, segment: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for b in batches:
            last = b.iloc[-1]
            open_run = (b["cell"] == last["cell"]) & (b["left"] == last["left"]) & (b["right"] == last["right"])
            if not open_run.all():
                yield _linked(pd.concat([*kept, b[~open_run]], ignore_index=True), radius, segment)
                kept = []
            kept.append(b[open_run])
        if kept:
            yield _linked(pd.concat(kept, ignore_index=True), radius, segment)

    return run


def links(nodes: DataFrame, radius: int = RADIUS, segment: int = SEGMENT, piece: int = PIECE, agree: int | None = None) -> DataFrame:
    """``a, b``: links that connect all ``nodes`` (``node``, distinct ``fp``) within ``radius`` bits.

    ``agree`` is ``agreeing`` of the number of nodes unless given.  Within a cell the links are thinned to those that keep its connected sets
    connected.  A cell of more than ``piece`` fingerprints is cut in pieces and
    every two pieces meet in a task of their own, so no task holds a whole cell.
    """
    agree = agree or agreeing(nodes.count(), radius, segment)
    cells = nodes.select("node", "fp").mapInPandas(_cells(radius, segment, agree), "cell long, fp long, node long")
    full = cut(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece).withColumn("pieces", F.ceil(F.col("n") / piece).cast("int")))
    if full.limit(1).count() == 0:
        spread = cells.withColumns({"own": F.lit(0), "left": F.lit(0), "right": F.lit(0)})
    else:
        joined = attach(cells, full, "cell", "n", comb(radius + agree, agree) * nodes.count())
        joined = joined.withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "pieces").cast("int"))
        spread = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("pieces", "other")
    dealt = spread.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right", "node")
    return dealt.select("cell", "left", "right", "own", "fp", "node").mapInPandas(_links(radius, segment), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges`` (``a, b``) reaches.

    Each round every node moves onto its neighbour of least random rank and the
    graph shrinks by a constant factor, so rounds grow with the logarithm of
    the longest path.
    """
    left = cut(edges.filter("a <> b").select("a", "b").distinct())
    moves, turn = [], 0
    while True:
        turn += 1
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))
        move = cut(both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).alias("to"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("node"), F.col("to.v").alias("to"), "n"))
        most, total = move.agg(F.max("n"), F.sum("n")).first()
        if not total:
            break
        moves.append(move)
        for c in ("a", "b"):
            ends = move.select(F.col("node").alias(c), F.col("to").alias(f"t{c}"), F.col("n").alias("_n"))
            left = attach(left, ends, c, "_n", total) if most > LIGHT else left.join(ends.drop("_n"), c)
        left = cut(left.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # many nodes may move onto one
    label = moves[-1].select("node", "to")
    for move in reversed(moves[:-1]):
        after = label.select(F.col("node").alias("to"), F.col("to").alias("end"))
        label = cut(attach_any(move.select("node", "to"), after, "to").select("node", F.coalesce("end", "to").alias("to")))
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    return attach_any(label, least, "to").select("node", "component")


def candidates(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``node, groups``: for ``nodes`` (``node, fp``) the groups of nodes whose fingerprints link or are equal.

    Every two nodes within the radius have a group in common: a group holds
    what is connected within a cell, under its smallest fingerprint.  Nodes
    that meet no other have none.
    """
    prints = cut(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    found = links(prints.select(F.col("fp").alias("node"), "fp"), radius)
    equal = prints.filter("n > 1").select("fp", F.col("fp").alias("group"))
    member = found.select(F.col("b").alias("fp"), F.col("a").alias("group")).union(found.select(F.col("a").alias("fp"), F.col("a").alias("group"))).union(equal)
    # a fingerprint has a group for each of its cells at most
    held = prints.join(member.groupBy("fp").agg(F.collect_set("group").alias("groups")), "fp")
    return attach(nodes.select("node", "fp"), cut(held), "fp", "n", nodes.count()).filter("groups is not null").select("node", "groups")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, fp, component_id``: one row a document, whole texts, all links within ``radius`` bits.

    Links are sought between distinct fingerprints; equal ones share a row, so
    copies cost nothing however many there are.  Null and empty texts have the
    fingerprint zero and link like any other.  Repeated rows come back repeated.
    A null doc_id links like any other but is no candidate for a component's
    name; a component without any doc_id has a null name.  An empty table gives
    an empty result.
    """
    prints = cut(fingerprints(docs, words))
    named = _named(prints, radius, segment).select("fp", "n", "component_id")
    return attach(prints, named, "fp", "n", prints.count())


def _named(prints: DataFrame, radius: int, segment: int) -> DataFrame:
    """``fp, n, component, component_id``: the fingerprint itself is the node, the least doc_id only the name."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    found = components(links(nodes.withColumn("node", F.col("fp")), radius, segment))
    parts = cut(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "n", "doc_id", F.coalesce("component", "fp").alias("component")))
    names = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    named = attach(parts.drop("doc_id"), names, "component", "_n", parts.count())
    return named.select("fp", "n", "component", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The operator's rows with the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``docs`` without near copies: of every component the row of the smallest doc_id stays, null last.

    Of several such rows it is the one whose text has the least hash.  A row is
    known by 128 bits of its identifier and text, so rows without an identifier
    stay unless they are copies, and different texts under one doc_id are
    different documents.
    """
    (row,) = unused(docs, "_row")
    keyed = docs.withColumn(row, key_of(F.col("doc_id"), F.col("text")))
    rows = cut(fingerprints(keyed, words, F.col(row).alias("row")).distinct())
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    least = rows.groupBy("fp").agg(first)
    groups = _named(rows.select("doc_id", "fp"), radius, SEGMENT).select("fp", "component").join(least, "fp").groupBy("component").agg(F.min("first").alias("first"))
    single = keyed.join(groups.select(F.col("first.row").alias(row)), row, "left_semi").dropDuplicates([row])
    return single.select(*(F.col(f"`{c}`") for c in docs.columns))
