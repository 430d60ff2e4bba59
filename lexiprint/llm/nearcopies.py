"""Near copies by SimHash groups, completed and verified on five-word shingles.

The SimHash operator groups texts whose fingerprints of five-word shingles
link.  Texts of Jaccard similarity 0.8 differ in ten of 64 bits on average,
and random texts in as few as that too often for any grid to part them, so
MinHash bands propose what the fingerprints miss.  Both only propose: whether
two texts are near copies is settled on the shingles of both whole texts.  Equal
texts share one node, so exact copies cost nothing however many there are, and
rows, not identifiers, are kept: a missing or repeated doc_id loses no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import attach, beside, cut, give_back, key_of, unused, with_texts
from lexiprint.llm.simhash import candidates, components, majority

SEED = 42
WORDS = 5
SIMILARITY = 0.8
#: Two texts of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Texts compared with each other in one piece, and bytes of their shingles; fuller cells are compared piece by piece.
PIECE, PIECE_BYTES = 1024, 16 << 20
#: Candidates of at most so many identifiers are sent to every task.
SENT = 1_000_000
CACHE = 300_000
_CHUNK = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FOLD = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)


class _Hashes(dict):
    """Word -> its XXH64."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, known: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's word shingles; a shorter text is one shingle, no word none."""
    w = (text or "").lower().split()
    h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = _mixed(out + h[j : j + len(out)])
    return np.unique(out)


def bands(found: np.ndarray) -> np.ndarray:
    """Hash of each band of the MinHash signature; texts without words share all bands."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(found), _CHUNK):
        part = found[at : at + _CHUNK, None] * _TIMES + _PLUS
        np.minimum(low, (part >> np.uint64(32)).min(axis=0), out=low)
    return _mixed((low.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + _BAND)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = _Hashes()
        for b in batches:
            found, prints, size = np.empty((b.num_rows, BANDS), dtype=np.uint64), np.empty(b.num_rows, dtype=np.uint64), np.empty(b.num_rows, dtype=np.int64)
            for n, t in enumerate(b.column("text").to_pylist()):
                hashes = shingles(t, known, words)
                found[n], prints[n], size[n] = bands(hashes), majority(hashes), hashes.nbytes
                if len(known) > CACHE:
                    known.clear()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS, dtype=np.int32)), pa.array(found.ravel().view(np.int64)))
            yield beside(b, ["row", "node", "doc_id"], bands=lists, fp=pa.array(prints.view(np.int64)), bytes=pa.array(size))

    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        known = _Hashes()
        for b in batches:
            got = []
            for t in b["text"]:
                got.append(shingles(t, known, words).tobytes())
                if len(known) > CACHE:
                    known.clear()
            yield pd.DataFrame({"node": b["node"], "set": got})

    return run


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (first, other) that connect what is connected by pairs of at least ``similarity``.

    Each set that is reached is compared with all that are not reached yet,
    so every pair is compared or is connected already.
    """
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            own, mine = sets[at], sizes[left]
            due = left[np.minimum(mine, len(own)) >= similarity * np.maximum(mine, len(own))]
            if not len(due):
                continue
            if len(own):
                both = np.concatenate([sets[i] for i in due])
                place = np.minimum(np.searchsorted(own, both), len(own) - 1)
                starts = np.cumsum(sizes[due]) - sizes[due]
                common = np.add.reduceat((own[place] == both).astype(np.int64), starts)
                near = due[common >= similarity * (sizes[due] + len(own) - common)]
            else:
                near = due
            front += near.tolist()
            out += [(int(root), int(i)) for i in near]
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _links(similarity: float):
    def of(run: pd.DataFrame) -> pd.DataFrame:
        run = run.drop_duplicates("node")
        node = run["node"].to_numpy()
        found = linked([np.frombuffer(s, dtype=np.uint64) for s in run["set"]], similarity)
        return pd.DataFrame({"a": node[[a for a, _ in found]], "b": node[[b for _, b in found]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        kept: list[pd.DataFrame] = []
        key = ["cell", "left", "right"]
        for b in batches:
            for name, part in b.groupby(key, sort=False):
                if kept and name != tuple(kept[0].iloc[0][key]):
                    yield of(pd.concat(kept, ignore_index=True))
                    kept = []
                kept.append(part)
        if kept:
            yield of(pd.concat(kept, ignore_index=True))

    return run


def links(nodes: DataFrame, texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, piece: int = PIECE) -> DataFrame:
    """``a, b``: links that connect all near copies among ``nodes`` (``node, bands, bytes``); ``texts`` has ``node, text``, repeats allowed.

    ``bands`` are the cells in which a node seeks partners and ``bytes`` the
    size of its shingles.  Cells with the same texts count once.  A cell of more
    than ``piece`` texts or ``PIECE_BYTES`` is cut in pieces and every two
    pieces meet in a task of their own.
    """
    kind = dict(nodes.dtypes)["node"]
    cells = nodes.select("node", "bytes", F.explode("bands").alias("cell"))
    # two sums of hashes stand for the cell's set of nodes
    who = [F.sum(F.xxhash64(F.lit(n), "node").cast("decimal(20,0)")).alias(f"who{n}") for n in (0, 1)]
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *who).filter("n > 1")
    pieces = F.greatest(F.ceil(F.col("n") / piece), F.ceil(F.col("bytes") / PIECE_BYTES)).cast("int").alias("pieces")
    single = cut(sizes.groupBy("n", "bytes", "who0", "who1").agg(F.min("cell").alias("cell")).select("cell", "n", pieces))
    cells = cells.drop("bytes")
    held = attach(cells, single, "cell", "n", BANDS * nodes.count()).filter("pieces is not null")
    held = cut(held.withColumn("own", F.pmod(F.xxhash64("node"), "pieces").cast("int")))
    wanted = cut(held.select(F.col("node").alias("_n")).distinct())
    few = wanted.count() <= SENT
    chosen = texts.join(F.broadcast(wanted) if few else wanted, F.col("node") == F.col("_n"), "left_semi")
    sets = cut(chosen.mapInPandas(_sets(words), f"node {kind}, set binary").dropDuplicates(["node"]))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("cell", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "node")
    dealt = spread.join(sets, "node").repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right", "node")
    return dealt.select("cell", "left", "right", "node", "set").mapInPandas(_links(similarity), f"a {kind}, b {kind}").distinct()


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: of every group that links of ``similarity`` connect, one row stays.

    It is the row of the smallest doc_id, null last, and of several such rows
    the text of least hash.  A row is known by 128 bits of its identifier and
    text, so rows without an identifier stay unless their text is a copy, and
    different texts under one doc_id are different documents.  Texts without
    words are copies of each other.  All columns come back as they were.
    """
    node, row = unused(docs, "_node", "_row")
    text = F.col("text").cast("string")
    keyed = with_texts(docs).withColumn(node, key_of(F.coalesce(text, F.lit("")))).withColumn(row, key_of(F.col("doc_id"), F.hex(node)))
    need = keyed.select(F.col(row).alias("row"), F.col(node).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = cut(need.mapInArrow(_sketches(words), "row binary, node binary, doc_id long, bands array<long>, fp long, bytes long"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node", "row")).alias("first")
    nodes = cut(rows.groupBy("node").agg(first, *(F.any_value(c).alias(c) for c in ("bands", "fp", "bytes"))))
    grouped = nodes.select("node", "bands", "bytes").join(candidates(nodes), "node", "left")
    by_print = F.transform(F.coalesce("groups", F.array().cast("array<bigint>")), lambda g: F.xxhash64(F.lit("simhash"), g))
    cells = F.concat("bands", by_print)
    found = components(links(cut(grouped.select("node", "bytes", cells.alias("bands"))), need.select("node", "text"), words, similarity))
    parts = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    kept = parts.select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(*(F.col(f"`{c}`") for c in docs.columns))
