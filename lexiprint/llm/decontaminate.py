"""Benchmark decontamination by a BM25 index of the test items.

Every window of every document queries the index.  Scores are BM25 divided by
what the item scores against itself, so one threshold fits items of any length.
Retrieval is block-max WAND carried out for all windows of a batch at once:

* An item's terms of least weight, together below half the threshold, are its
  light terms.  They are left out of the lists that are walked first, which
  drops almost all postings of frequent words; their sum is kept per block.
* Postings are cut in blocks of items with the largest weight per term and
  block.  A block is opened for a window only if these maxima and the light
  remainder can reach the threshold; nothing that could reach it is skipped.
* In opened blocks each item gets its exact score from all its terms.

A document with an item above the threshold is then verified on its whole
text: word shingles of the item's question and of its answer must occur in it.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import give_back, with_texts

K1, B = 1.2, 0.75
#: Share of its own score that an item must reach in a window to be retrieved.
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
#: Longer items are indexed in segments of so many words.
SEGMENT = 128
BLOCK = 16
#: Characters of benchmark text in one index; more are matched in several passes over the corpus.
INDEX_CHARS = 32 << 20
#: Words of documents matched in one go, and cached tokens of a worker.
AT_ONCE, CACHE = 300_000, 400_000
_EDGE = string.punctuation + "“”‘’«»„¡¿…–—"
_ANSWER = re.compile(r"(?is)\banswer\s*:\s*|(?<=\?)\s+(?=\S)|\n\s*a\s*[:.)]\s*")


def normal(token: str) -> str:
    return token.lower().strip(_EDGE)


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def question_answer(text: str | None) -> tuple[str, str]:
    """Question and answer: parted by an answer mark or a question mark, or else before the last sentence."""
    text = (text or "").strip()
    marks = list(_ANSWER.finditer(text))
    if marks:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    cuts = list(re.finditer(r"(?<=[.!])\s+(?=\S)", text))
    return (text[: cuts[-1].start()], text[cuts[-1].end() :]) if cuts else (text, "")


def shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit codes of all runs of ``size`` ids (the whole, if shorter); runs with unknown words are left out."""
    if not len(ids):
        return np.array([], dtype=np.uint64)
    size = min(size, len(ids))
    code = np.full(len(ids) - size + 1, size, dtype=np.uint64)
    known = np.ones(len(code), dtype=bool)
    for j in range(size):
        part = ids[j : j + len(code)]
        known &= part >= 0
        code = (code * np.uint64(0x9E3779B97F4A7C15) + (part + 2).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code >> np.uint64(29))
    return code[known]


@dataclass
class Index:
    terms: dict[str, int]
    items: list  # item identifiers
    entry_item: np.ndarray  # entry (segment) -> item
    light: np.ndarray  # block -> largest sum of light terms
    heavy_at: np.ndarray  # term -> first of its (block, maximum) pairs
    heavy_block: np.ndarray
    heavy_max: np.ndarray
    all_at: np.ndarray  # (block * terms + term), sorted -> postings
    all_keys: np.ndarray
    posts_entry: np.ndarray
    posts_weight: np.ndarray
    stride: int
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    short: dict[int, list[tuple[int, int]]]  # item -> question (0) or answer (1) shorter than a shingle, and its words


def build_index(items: list[tuple], df: dict[str, int], n: int, mean: float, longest: int = SEGMENT, threshold: float = THRESHOLD) -> Index:
    """Index of (identifier, text) pairs with document frequencies, count, mean and largest length over all items."""
    terms: dict[str, int] = {}
    entries: list[tuple[int, Counter]] = []
    names, parts = [], []
    for name, text in items:
        w = words_of(text)
        if not w:
            continue
        ids = [terms.setdefault(x, len(terms)) for x in w]
        for at in range(0, len(ids), SEGMENT):
            piece = ids[at : at + SEGMENT] if at + SEGMENT <= len(ids) or not at else ids[-SEGMENT:]
            entries.append((len(names), Counter(piece)))
        names.append(name)
        parts.append(tuple(map(words_of, question_answer(text))))
    number = lambda ws: np.array([terms.get(x, -1) for x in ws], dtype=np.int64)
    idf = {t: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w, t in terms.items()}
    entries.sort(key=lambda x: sum(x[1].values()))
    blocks = -(-len(entries) // BLOCK)
    light = np.zeros(max(1, blocks))
    heavy: dict[tuple[int, int], float] = defaultdict(float)
    posts = []
    for e, (_, counts) in enumerate(entries):
        size = sum(counts.values())
        raw = {t: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)) for t, tf in counts.items()}
        own = sum(raw.values())
        block, rest = e // BLOCK, 0.0
        for t, x in sorted(raw.items(), key=lambda x: (x[1], x[0])):
            weight = x / own
            posts.append((block * len(terms) + t, e, weight))
            if rest + weight < threshold / 2:
                rest += weight
            else:
                heavy[t, block] = max(heavy[t, block], weight)
        light[block] = max(light[block], rest)
    pairs = sorted((t, b, w) for (t, b), w in heavy.items())
    posts.sort()
    keys = np.array([p[0] for p in posts], dtype=np.int64)
    unique, first = np.unique(keys, return_index=True)
    return Index(
        terms=terms,
        items=names,
        entry_item=np.array([e[0] for e in entries], dtype=np.int64),
        light=light,
        heavy_at=np.searchsorted([p[0] for p in pairs], np.arange(len(terms) + 1)),
        heavy_block=np.array([p[1] for p in pairs], dtype=np.int64),
        heavy_max=np.array([p[2] for p in pairs]),
        all_keys=unique,
        all_at=np.append(first, len(posts)),
        posts_entry=np.array([p[1] for p in posts], dtype=np.int64),
        posts_weight=np.array([p[2] for p in posts]),
        stride=min(SEGMENT, max(16, longest)),
        questions=[np.unique(shingles(number(q))) for q, _ in parts],
        answers=[np.unique(shingles(number(a))) for _, a in parts],
        short={i: [(which, len(x)) for which, x in enumerate(p) if 0 < len(x) < SHINGLE] for i, p in enumerate(parts) if any(0 < len(x) < SHINGLE for x in p)},
    )


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counted pieces: its owner and its number in the owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sum_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=weights, minlength=len(unique))


def retrieve(index: Index, window: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, entries and scores at or above the threshold; ``window, term`` are distinct pairs of known terms."""
    size = index.heavy_at[term + 1] - index.heavy_at[term]
    owner, nth = _spread(size)
    at = index.heavy_at[term][owner] + nth
    blocks = len(index.light)
    open_keys, reach = _sum_by(window[owner] * blocks + index.heavy_block[at], index.heavy_max[at])
    open_keys = open_keys[reach + index.light[open_keys % blocks] >= threshold - 1e-9]
    open_window, block = np.divmod(open_keys, blocks)
    # all terms of the windows with open blocks, looked up in these blocks
    order = np.argsort(window, kind="stable")
    window, term = window[order], term[order]
    low, high = np.searchsorted(window, open_window), np.searchsorted(window, open_window, side="right")
    owner, nth = _spread(high - low)
    key = block[owner] * len(index.terms) + term[low[owner] + nth]
    where = np.minimum(np.searchsorted(index.all_keys, key), len(index.all_keys) - 1)
    hit = index.all_keys[where] == key
    owner, where = owner[hit], where[hit]
    inner, nth = _spread(index.all_at[where + 1] - index.all_at[where])
    post = index.all_at[where][inner] + nth
    n = len(index.entry_item)
    pairs, score = _sum_by(open_window[owner[inner]] * n + index.posts_entry[post], index.posts_weight[post])
    enough = score >= threshold - 1e-9
    return pairs[enough] // n, pairs[enough] % n, score[enough]


class _Terms(dict):
    """Token -> term of the index, -1 for other words, -2 for tokens without a word."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms

    def __missing__(self, token: str) -> int:
        w = normal(token)
        self[token] = found = self.terms.get(w, -1) if w else -2
        return found


class Matcher:
    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> None:
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.known = _Terms(index.terms)

    def ids(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        ids = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return ids[ids != -2]

    def _verify(self, ids: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's shingles in the document; 1 for a part without words."""
        have = {SHINGLE: shingles(ids)} if len(ids) >= SHINGLE else {len(ids): shingles(ids)}
        shorter = dict(self.index.short.get(item, []))
        out = []
        for which, want in enumerate((self.index.questions[item], self.index.answers[item])):
            size = shorter.get(which, SHINGLE)
            if size not in have:
                have[size] = shingles(ids, size) if len(ids) >= size else np.array([], dtype=np.uint64)
            out.append(float(np.isin(want, have[size]).mean()) if len(want) else 1.0)
        return tuple(out)

    def _group(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float]]:
        index, sizes = self.index, np.array([len(d) for d in docs])
        doc, at = _spread(sizes)
        ids = np.concatenate(docs)
        pieces = -(-sizes // index.stride) + 1  # one more, so windows of different documents never meet
        first = np.cumsum(pieces) - pieces
        piece = first[doc] + at // index.stride
        known = ids >= 0
        keys = piece[known] * len(index.terms) + ids[known]
        keys = np.unique(np.concatenate([keys, keys - len(index.terms)]))  # window p holds the pieces p and p + 1
        window, entry, score = retrieve(index, keys // len(index.terms), keys % len(index.terms), self.threshold)
        owner = np.searchsorted(first, np.maximum(window, 0), side="right") - 1
        # a window that begins in the spare piece before a document belongs to that document
        owner = np.where((window >= 0) & (owner + 1 < len(first)) & (window == first[np.minimum(owner + 1, len(first) - 1)] - 1), owner + 1, owner)
        best: dict[tuple[int, int], float] = {}
        for d, e, s in zip(owner.tolist(), index.entry_item[entry].tolist(), score.tolist()):
            best[d, e] = max(best.get((d, e), 0.0), s)
        for (d, item), s in sorted(best.items()):
            q, a = self._verify(docs[d], item)
            if q >= self.overlap and a >= self.overlap:
                yield d, item, s, q, a

    def match(self, texts: list[str | None]) -> Iterator[tuple[int, object, float, float, float]]:
        """Number of the text, item, score, question's and answer's overlap of every verified pair."""
        held, first, total = [], 0, 0
        for n, text in enumerate(texts):
            held.append(self.ids(text))
            total += len(held[-1])
            if total >= AT_ONCE or n + 1 == len(texts):
                for d, item, *rest in self._group(held):
                    yield first + d, self.index.items[item], *rest
                held, first, total = [], n + 1, 0
                if len(self.known) > CACHE:
                    self.known = _Terms(self.index.terms)


def _indexes(benchmark: DataFrame, threshold: float, chars: int) -> Iterator[Index]:
    """Indexes over parts of the items of at most about ``chars`` characters, with statistics of all items."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not size[0]:
        return
    parts = -(-int(size[1] or 1) // chars)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                w = words_of(t)
                yield pd.DataFrame({"term": [*sorted(set(w)), None], "size": [0] * len(set(w)) + [len(w)]})

    stats = items.mapInPandas(counted, "term string, size long").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("size").alias("longest")).cache()
    n, words, longest = stats.filter("term is null").select("n", "size", "longest").first()
    for part in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if parts == 1:
            df = {r["term"]: r["n"] for r in stats.filter("term is not null").collect()}
        else:
            own = items.sparkSession.createDataFrame([(w,) for w in {w for r in mine for w in words_of(r["text"])}], "own string")
            df = {r["term"]: r["n"] for r in stats.join(F.broadcast(own), F.col("term") == F.col("own")).collect()}
        index = build_index([(r["item_id"], r["text"]) for r in mine], df, n, max(1.0, words / n), longest, threshold)
        if index.items:
            yield index
    stats.unpersist()


OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Every document and item of which the document holds question and answer, with the best window's score.

    Null and empty texts hold nothing; items without words are never found.  An
    item without a separate answer is verified on its question.  Repeated
    documents come back repeated.  Items without an identifier are found like
    any other, with a null item_id.  The index goes to every task; it is built
    from at most ``index_chars`` characters, and a larger benchmark is matched
    part after part.
    """
    need = with_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in _indexes(benchmark, threshold, index_chars):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            give_back()
            matcher = Matcher(index, threshold, overlap)
            for b in batches:
                found = list(zip(*matcher.match(b.column("text").to_pylist()))) or [()] * 5
                ids = b.column("doc_id").take(pa.array(found[0], pa.int64()))
                more = [pa.array(x, kind) for x, kind in zip(found[1:], (pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([ids, *more], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = need.mapInArrow(run, OUT)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], OUT) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose whole text holds a benchmark item; no row is shuffled."""
    for index in _indexes(benchmark, THRESHOLD, INDEX_CHARS):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            give_back()
            matcher = Matcher(index)
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[n for n, *_ in matcher.match(b.column("text").to_pylist())]] = False
                yield b.filter(pa.array(clean))

        docs = with_texts(docs).mapInArrow(run, docs.schema)
    return docs
