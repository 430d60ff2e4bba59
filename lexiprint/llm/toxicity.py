"""A convolutional text classifier for toxicity, trained in numpy and applied by Spark.

A word's vector is the sum of hashed embeddings of the word and of its
beginnings.  Filters of several widths run over the words, each filter keeps its
largest response in the document, and a logistic layer turns these into a
score.  Training sees a bounded sample of labelled documents; scoring reads
every whole text.  Because a filter is linear, its share of each word is
computed once per distinct word and a window's response is a sum of shares.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import beside, cut, give_back, with_texts

#: At most so many labelled documents of each label are learned from, those of least hash,
#: and of these as many as have so many words together; longer ones than LONGEST words are left to the scores.
SAMPLE = {1: 3000, 0: 6000}
SAMPLE_WORDS, LONGEST = 4_000_000, 20_000
BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Lengths of the beginnings that are embedded beside the word.
STARTS = (4, 5)
PARTS = 1 + len(STARTS)
EPOCHS = 3
#: Documents of a step at most, and words beyond which it takes no more.
BATCH, BATCH_WORDS = 64, 30_000
#: Score from which a document is predicted toxic whatever its language.
THRESHOLD = 0.3
#: Positives a language needs for a threshold of its own.
LEAST_POSITIVES = 15
#: Rows with this remainder of crc32(doc_id) modulo 4 are never learned from.
HELD_OUT = 2
#: Labels of at most so many documents are sent to every task.
SENT = 1_000_000
#: Words whose filter shares a worker keeps, and words scored in one go.
KEPT, AT_ONCE = 120_000, 200_000
_STRIP = string.punctuation + "“”‘’«»„¡¿…–—"


def word_buckets(token: str) -> tuple[int, ...]:
    """Buckets of the normalised word and of its beginnings; bucket 0 is padding."""
    w = token.lower().strip(_STRIP)
    if not w:
        return (0,) * PARTS
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) + 1 for x in (w, *(f"{n}^{w[:n]}" for n in STARTS)))


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def padding(self) -> int:
        return max(self.filters) - 1


def _join(docs: list[np.ndarray], padding: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents behind each other, each padded, and start and end of the windows of each (one at least)."""
    sizes = np.array([max(1, len(d)) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes + padding)[:-1]]).astype(np.int64)
    joined = np.zeros((int((sizes + padding).sum()), *docs[0].shape[1:]), dtype=docs[0].dtype)
    for a, d in zip(starts, docs):
        joined[a : a + len(d)] = d
    return joined, np.stack([starts, starts + sizes], axis=1)


def _largest(out: np.ndarray, spans: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(out, spans.ravel(), axis=0)[::2]


def _vectors(model: Model, words: np.ndarray) -> np.ndarray:
    x = model.embedding[words[:, 0]]
    for part in range(1, PARTS):
        x += model.embedding[words[:, part]]
    return x


def _forward(model: Model, words: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Scores' logits, the windows and responses by width, and the word vectors.  ``words``: (n, PARTS) buckets, padded."""
    x = _vectors(model, words)
    pooled, kept = [], {}
    for width, f in model.filters.items():
        window = np.concatenate([np.roll(x, -j, axis=0) for j in range(width)], axis=1)
        out = window @ f.reshape(-1, f.shape[2])
        kept[width] = (window, out)
        pooled.append(np.maximum(_largest(out, spans) + model.bias[width], 0))
    pooled = np.concatenate(pooled, axis=1)
    return pooled @ model.weight + model.offset, kept, pooled


def loss(model: Model, words: np.ndarray, spans: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Mean weighted logistic loss of a batch."""
    logit = _forward(model, words, spans)[0].astype(np.float64)
    return float((weights * (np.logaddexp(0, logit) - labels * logit)).mean())


@dataclass
class Gradients:
    """Derivatives of ``loss``; of the embedding only the ``touched`` rows."""

    touched: np.ndarray
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float


def gradients(model: Model, words: np.ndarray, spans: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Gradients:
    """Derivatives through the sigmoid, the largest responses and the sums of hashed vectors; padding has none."""
    logit, kept, pooled = _forward(model, words, spans)
    g = ((1 / (1 + np.exp(-logit)) - labels) * weights / len(labels)).astype(model.embedding.dtype)
    d_pooled = g[:, None] * model.weight * (pooled > 0)
    rows, parts, filters, bias = [], [], {}, {}
    for place, (width, (window, out)) in enumerate(kept.items()):
        d = d_pooled[:, place * FILTERS : (place + 1) * FILTERS]
        best = np.stack([a + out[a:b].argmax(axis=0) for a, b in spans])
        picked = window[best.ravel()].reshape(*best.shape, -1)
        filters[width] = np.einsum("bf,bfw->wf", d, picked).reshape(width, DIM, FILTERS)
        bias[width] = d.sum(0)
        back = d[:, :, None] * model.filters[width].reshape(-1, FILTERS).T[None]
        for j in range(width):
            where = (best + j).ravel()
            part = back[:, :, j * DIM : (j + 1) * DIM].reshape(-1, DIM)
            rows += [words[where, n] for n in range(PARTS)]
            parts += [part] * PARTS
    touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.zeros((len(touched), DIM), dtype=model.embedding.dtype)
    np.add.at(total, inverse, np.concatenate(parts))
    total[touched == 0] = 0
    return Gradients(touched, total, filters, bias, pooled.T @ g, float(g.sum()))


def _batches(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Runs of ``order`` of at most ``BATCH`` documents that end once they have ``BATCH_WORDS`` words."""
    first, held = 0, 0
    for n, i in enumerate(order, 1):
        held += len(docs[i])
        if n - first == BATCH or held >= BATCH_WORDS or n == len(order):
            yield order[first:n]
            first, held = n, 0


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on documents given as (n, PARTS) bucket arrays; ``weights`` undo uneven sampling of the labels.

    The first coordinate starts at each bucket's smoothed log-odds in the
    sample and the first filter of each width reads it, so rare words start
    near zero; all weights are then trained by gradients through the maxima.
    """
    rng = np.random.default_rng(seed)
    labels = labels.astype(np.float32)
    seen = np.zeros((2, BUCKETS), dtype=np.float64)
    for d, y in zip(docs, labels):
        seen[int(y), np.unique(d)] += 1
    share = [(seen[y] + 2 * (seen.sum(0) + 1) / (len(docs) + 2)) / ((labels == y).sum() + 2) for y in (0, 1)]
    odds = np.log(share[1]) - np.log(share[0])
    trust = seen.sum(0) / (seen.sum(0) + 5)
    e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    e[:, 0] = np.clip(odds * trust, -3, 3) / 2
    e[0] = 0
    f = {w: rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        f[w][:, 0, : FILTERS // 2] += np.float32(0.7 / w)
    weight = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    for n in range(len(WIDTHS)):
        weight[n * FILTERS : n * FILTERS + FILTERS // 2] += np.float32(0.3)
    model = Model(e, f, {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}, weight, -2.0)
    state: dict = {}
    rows_seen = np.zeros(BUCKETS, dtype=np.float32)
    steps = 0

    def adam(name, value, grad, rate=0.01):
        m, v = state.get(name, (0, 0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        state[name] = m, v
        return value - rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)

    for _ in range(epochs):
        for chosen in _batches(rng.permutation(len(docs)), docs):
            words, spans = _join([docs[i] for i in chosen], model.padding)
            g = gradients(model, words, spans, labels[chosen], weights[chosen])
            steps += 1
            rows_seen[g.touched] += (g.embedding * g.embedding).sum(axis=1)
            model.embedding[g.touched] -= 0.1 * g.embedding / (np.sqrt(rows_seen[g.touched])[:, None] + 1e-4)
            model.weight = adam("w", model.weight, g.weight + 1e-4 * model.weight).astype(np.float32)
            model.offset = float(adam("o", model.offset, g.offset))
            for width in WIDTHS:
                model.filters[width] = adam(("f", width), model.filters[width], g.filters[width] + 1e-5 * model.filters[width]).astype(np.float32)
                model.bias[width] = adam(("b", width), model.bias[width], g.bias[width]).astype(np.float32)
    return model


def _logits(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    out = []
    for at in range(0, len(docs), BATCH):
        out.append(_forward(model, *_join(docs[at : at + BATCH], model.padding))[0])
    return np.concatenate(out) if out else np.zeros(0)


def best_threshold(bins: list[tuple[int, int, float, float]]) -> float:
    """Threshold of best F1 over ``(toxic rows, rows, least score, largest score)`` of each bin, the middle of the gap below it."""
    bins = sorted(bins, key=lambda x: -x[2])
    toxic = np.array([x[0] for x in bins], dtype=np.float64)
    rows = np.array([x[1] for x in bins], dtype=np.float64)
    at = int((2 * np.cumsum(toxic) / (np.cumsum(rows) + toxic.sum())).argmax())
    below = bins[at + 1][3] if at + 1 < len(bins) else 0.0
    return float((bins[at][2] + below) / 2)


def calibrate(scored: DataFrame) -> dict[str, float]:
    """Thresholds of best F1 by language of all rows of ``lang, score, toxic``; '' holds for languages with few positives.

    The scores are counted in bins of a 64th of a logit, of which each keeps
    its least and largest score, so the driver sees counts only.
    """
    logit = F.log(F.greatest(F.col("score"), F.lit(1e-15)) / F.greatest(1 - F.col("score"), F.lit(1e-15)))
    binned = scored.select(F.coalesce("lang", F.lit("")).alias("lang"), "score", "toxic", F.floor(logit * 64).alias("bin"))
    # at most about 4,400 bins a language
    got = binned.groupBy("lang", "bin").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    whole: dict[int, tuple[int, int, float, float]] = {}
    own: dict[str, list[tuple[int, int, float, float]]] = {}
    for r in got:
        one = (r["toxic"], r["n"], r["low"], r["high"])
        t, n, low, high = whole.get(r["bin"], (0, 0, 1.0, 0.0))
        whole[r["bin"]] = t + one[0], n + one[1], min(low, one[2]), max(high, one[3])
        own.setdefault(r["lang"], []).append(one)
    enough = lambda bins: sum(x[0] for x in bins) >= LEAST_POSITIVES
    found = {"": best_threshold(list(whole.values())) if enough(whole.values()) else THRESHOLD}
    return found | {name: best_threshold(own[name]) for name in sorted(own) if name and enough(own[name])}


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [np.array([word_buckets(w) for w in (t or "").split()], dtype="<i4").tobytes() for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "toxic": b["toxic"], "fold": b["fold"], "size": [len(r) // (4 * PARTS) for r in rows], "words": rows})


def _known(labels: DataFrame) -> DataFrame:
    """``_id, _toxic`` of the labelled documents that are not held out; repeated labels count once, the larger."""
    known = labels.filter(f"doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 4 <> {HELD_OUT}")
    return known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame | None]:
    """The trained network, and ``_id, _toxic`` of all labelled documents that it neither saw nor are held out.

    At most ``SAMPLE`` documents of each label, those whose identifiers have
    the least hash, are trained on, less a fifth; none of more than ``LONGEST``
    words, and in the order of the hash only as many as have ``SAMPLE_WORDS``
    words together, so what comes to the driver is bounded however long texts
    are.  Of rows with one doc_id the text
    of least hash is learned from.
    """
    give_back()
    known = _known(labels)
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if len(sizes) < 2:
        return None, None
    chosen = None
    for y, most in SAMPLE.items():
        part = known.filter(F.col("_toxic") == y).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # at most sum(SAMPLE) rows of three numbers
    chosen = cut(chosen.withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)).cast("int")))
    need = with_texts(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = need.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", F.col("_toxic").alias("toxic"), F.col("_fold").alias("fold"), "text")
    once = texts.groupBy("id").agg(F.min_by(F.struct("toxic", "fold", "text"), F.xxhash64("text")).alias("r")).select("id", "r.toxic", "r.fold", "r.text")
    coded = cut(once.mapInPandas(_encode, "id long, toxic int, fold int, size long, words binary"))
    # at most sum(SAMPLE) rows of two numbers, then at most SAMPLE_WORDS words
    sized = coded.filter(F.col("size") <= LONGEST).select("id", "size", F.xxhash64("id", F.lit(11)).alias("h")).toPandas().sort_values(["h", "id"])
    taken = sized["id"][sized["size"].cumsum() <= SAMPLE_WORDS].tolist()
    picked = docs.sparkSession.createDataFrame([(i,) for i in taken], "_id long")
    rows = coded.join(F.broadcast(picked), F.col("id") == F.col("_id"), "left_semi").toPandas().sort_values("id", ignore_index=True)
    if rows["toxic"].nunique() < 2:
        return None, None
    chosen = chosen.join(F.broadcast(picked), "_id", "left_semi")
    data = [np.frombuffer(w, dtype="<i4").reshape(-1, PARTS) for w in rows["words"]]
    y = rows["toxic"].to_numpy()
    fitted = (rows["fold"] != 0).to_numpy()
    seen = chosen.filter("_fold <> 0")
    if len(set(y[fitted])) < 2:
        fitted[:] = True
        seen = chosen
    weights = np.array([sizes[int(v)] / max(1, (y == v).sum()) for v in y])
    weights = np.minimum(weights / weights.mean(), 10).astype(np.float32)
    at = np.nonzero(fitted)[0]
    model = train([data[i] for i in at], y[at], weights[at])
    del rows, data
    give_back()
    return model, known.join(F.broadcast(seen.select(F.col("_id").alias("_seen"))), F.col("_id") == F.col("_seen"), "left_anti")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on a bounded sample and calibrate on all other labelled rows that are not held out; None without both labels."""
    model, rest = _fit(docs, labels)
    if model is None:
        return None
    rest = cut(rest)
    sent = F.broadcast(rest) if rest.count() <= SENT else rest
    need = with_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    mine = need.join(sent, F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "score": scorer.score(list(b["text"])), "toxic": b["toxic"]})

    model.thresholds = calibrate(mine.select("text", "lang", F.col("_toxic").alias("toxic")).mapInPandas(run, "lang string, score double, toxic int"))
    return model


class _Words(dict):
    """Token -> row of its filter shares; new rows are queued in ``fresh``."""

    def __init__(self) -> None:
        self.fresh: list[tuple[int, ...]] = []
        self.rows = 1

    def __missing__(self, token: str) -> int:
        self.fresh.append(word_buckets(token))
        self[token] = row = self.rows
        self.rows += 1
        return row


class Scorer:
    """Scores texts; memory holds the shares of at most about KEPT + AT_ONCE words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.flat = np.concatenate([f[j] for f in model.filters.values() for j in range(len(f))], axis=1)
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.shares = np.zeros((1, self.flat.shape[1]), dtype=np.float32)

    def _pool(self, ids: np.ndarray, spans: np.ndarray) -> np.ndarray:
        pooled, at = [], 0
        for width in self.model.filters:
            out = self.shares[ids, at : at + FILTERS]
            for j in range(1, width):
                at += FILTERS
                out[:-j] += self.shares[ids[j:], at : at + FILTERS]
            at += FILTERS
            pooled.append(_largest(out, spans) + self.model.bias[width])
        return np.concatenate(pooled, axis=1)

    def _grow(self) -> None:
        if self.words.fresh:
            self.shares = np.concatenate([self.shares, _vectors(self.model, np.array(self.words.fresh)) @ self.flat])
            self.words.fresh = []

    def _score_part(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scores of documents given by rows; long ones are pooled in overlapping pieces, so nothing is cut off."""
        pieces, owner, over = [], [], []
        for n, d in enumerate(docs):
            for a in range(0, max(1, len(d)), AT_ONCE):
                pieces.append(d[a : a + AT_ONCE + self.model.padding])
                owner.append(n)
                over.append(max(0, len(pieces[-1]) - AT_ONCE))
        pooled = np.full((len(docs), len(self.model.weight)), -np.inf, dtype=np.float32)
        ids, spans = _join(pieces, self.model.padding)
        spans[:, 1] -= over
        got = self._pool(ids, spans)
        np.maximum.at(pooled, owner, got)
        logit = np.maximum(pooled, 0) @ self.model.weight + self.model.offset
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, docs, held = [], [], 0
        for t in texts:
            tokens = (t or "").split()
            docs.append(np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
            held += len(tokens)
            if held >= AT_ONCE:
                self._grow()
                out.append(self._score_part(docs))
                docs, held = [], 0
                if self.words.rows > KEPT:
                    self._reset()
        if docs:
            self._grow()
            out.append(self._score_part(docs))
        return np.concatenate(out) if out else np.zeros(0)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        scorer = Scorer(model)
        for b in batches:
            yield beside(b, ["doc_id", "lang"], score=pa.array(scorer.score(b.column("text").to_pylist())))

    return run


def score_documents(docs: DataFrame, model: Model | None, rest: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, lang_threshold, toxic`` of every row.

    ``predicted`` compares with 0.3; ``toxic`` with the threshold calibrated
    for the row's language, or the one for all where its language has none.
    Null texts score like empty ones.  Without a model every score is 0.
    With ``rest`` (``_id, _toxic``) the thresholds are first set on its scores.
    """
    need = with_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    if model is None:
        scored = need.select("doc_id", "lang", F.lit(0.0).alias("score"))
        thresholds = {"": THRESHOLD}
    else:
        scored = need.mapInArrow(_score(model), "doc_id long, lang string, score double")
        if rest is not None:
            scored = cut(scored)
            model.thresholds = calibrate(scored.join(rest, F.col("doc_id") == F.col("_id")).select("lang", "score", F.col("_toxic").alias("toxic")))
        thresholds = model.thresholds or {"": THRESHOLD}
    limit = F.lit(thresholds[""])
    for name, t in thresholds.items():
        if name:
            limit = F.when(F.col("lang") == name, F.lit(t)).otherwise(limit)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).cast("int").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every document, once."""
    return score_documents(docs, *_fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text scores at or above the threshold of their language.

    The score stands beside the text in the same task, so no row is shuffled,
    and all columns come back as they were.
    """
    model = fit(docs, labels)
    if model is None:
        return docs
    thresholds = model.thresholds or {"": THRESHOLD}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        scorer = Scorer(model)
        for b in batches:
            limits = np.array([thresholds.get(x or "", thresholds[""]) for x in b.column("lang").to_pylist()])
            yield b.filter(pa.array(scorer.score(b.column("text").to_pylist()) < limits))

    return with_texts(docs).mapInArrow(run, docs.schema)
