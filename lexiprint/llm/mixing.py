"""Mixing documents to target domain weights with soft memberships.

A classifier trained on the labelled table gives every document a posterior
over domains.  A document's row of expected tokens per domain is its length
times the posterior.  Nonnegative rates, one a document, are fitted by
projected-gradient least squares so that the expected tokens of each domain,
summed over all documents at their rates, come to the target shares.

A step needs the domain totals only, a few numbers.  A document's rate after
any number of steps follows from its own row and those totals, so each step is
one pass of partial sums over a small table and no state per document is kept.
The squared error is weighed by the inverse of its own curvature, a matrix of a
row per domain, so that all directions have a curvature of at most 1.
"""

from __future__ import annotations

import logging
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import beside, cut, give_back, with_texts

#: Domains of the labelled table and the share of tokens of each that rates are fitted to.
TARGETS = {"good": 0.6, "poor": 0.4}
#: The same for a mixture that drops no document.
KEEPING_TARGETS = {"good": 0.9, "poor": 0.1}
#: At most so many labelled documents of each domain are learned from, those of least hash.
SAMPLE = 3000
BUCKETS = 1 << 14
EPOCHS = 6
#: Least rates: of the fit, and of a mixture that drops no document.  There is no upper bound.
LOWEST, KEEPING = 0.0, 1.0
STEPS = 60
#: The shares may miss their targets by so much; else a budget larger by LARGER is tried, BUDGETS times at most.
MISS, BUDGETS, LARGER = 5e-3, 12, 1.25
#: Pull of the rates towards 1, against the misfit of the shares.
RIDGE = 1e-3
CACHE = 300_000
SHAPES = 12
#: Rows that the mixture hands on at once, whatever the rates.
ROWS = 1000
_log = logging.getLogger(__name__)
_EDGE = string.punctuation + "“”‘’«»„¡¿…–—"
_SYMBOLS = "%&*#$@^~<>=+{}[]|\\/_"


class _Tokens(dict):
    """Token -> bucket of its word."""

    def __missing__(self, token: str) -> int:
        w = token.lower().strip(_EDGE)
        self[token] = found = zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS
        return found


def shape(text: str, tokens: list[str], ids: np.ndarray) -> list[float]:
    """Bounded figures of the whole text: length, words' length, repetition, symbols, capitals, digits, lines."""
    n, chars = max(1, len(tokens)), max(1, len(text))
    lines = text.split("\n")
    distinct = len(set(tokens))
    symbols = sum(map(text.count, _SYMBOLS))
    upper = sum(map(str.isupper, tokens))
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        1.0,
        np.log1p(n) / 10,
        min(chars / n, 20) / 20,
        distinct / n,
        len(set(lines)) / len(lines),
        min(1.0, 5 * symbols / chars),
        upper / n,
        min(1.0, text.count("|") / n),
        min(1.0, text.count("!") / n),
        min(1.0, 10 * sum(map(text.count, "0123456789")) / chars),
        min(1.0, ends / n * 5),
        min(1.0, len(lines) / n * 5),
    ]


def features(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct buckets of the whole text, their weights (of length 1), its shape, and its number of words."""
    text = text or ""
    tokens = text.split()
    ids = np.fromiter(map(known.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    counts = np.bincount(ids, minlength=1) if len(ids) > BUCKETS else None
    buckets, n = (np.nonzero(counts)[0], counts[counts > 0]) if counts is not None else np.unique(ids, return_counts=True)
    weights = np.log1p(n).astype(np.float32)
    return buckets, weights / max(1e-9, float(np.sqrt((weights * weights).sum()))), np.array(shape(text, tokens, ids), dtype=np.float32), len(tokens)


@dataclass
class Classifier:
    names: list[str]
    words: np.ndarray  # (BUCKETS, domains)
    shapes: np.ndarray  # (SHAPES, domains)

    def posterior(self, buckets: np.ndarray, weights: np.ndarray, shape: np.ndarray) -> np.ndarray:
        z = weights @ self.words[buckets] + shape @ self.shapes if len(buckets) else shape @ self.shapes
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, names: list[str], weights: np.ndarray, seed: int = 3) -> Classifier:
    """Softmax regression by Adagrad on (buckets, weights, shape) rows."""
    rng, k = np.random.default_rng(seed), len(names)
    model = Classifier(names, np.zeros((BUCKETS, k), dtype=np.float32), np.zeros((SHAPES, k), dtype=np.float32))
    past_words, past_shapes = np.full(model.words.shape, 1e-4, dtype=np.float32), np.full(model.shapes.shape, 1e-4, dtype=np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            b, w, s = rows[i]
            g = model.posterior(b, w, s).astype(np.float32)
            g[labels[i]] -= 1
            g *= weights[i]
            d = s[:, None] * g
            past_shapes += d * d
            model.shapes -= 0.1 * d / np.sqrt(past_shapes)
            if len(b):
                d = w[:, None] * g + 1e-6 * model.words[b]
                past_words[b] += d * d
                model.words[b] -= 0.05 * d / np.sqrt(past_words[b])
    return model


def domain_of(labels: DataFrame) -> DataFrame:
    """``_id, domain``: good or poor by ``quality``, one row a document; repeated labels count once, the larger."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("q"))
    return known.select("_id", F.when(F.col("q") == 1, "good").otherwise("poor").alias("domain"))


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Tokens()
    for b in batches:
        rows = [features(t, known) for t in b["text"]]
        yield pd.DataFrame({"id": b["id"], "domain": b["domain"], "buckets": [r[0].astype("<i4").tobytes() for r in rows], "weights": [r[1].astype("<f4").tobytes() for r in rows], "shape": [r[2].astype("<f4").tobytes() for r in rows]})


def fit(docs: DataFrame, domains: DataFrame, names: list[str]) -> Classifier | None:
    """Classifier of the named domains on at most ``SAMPLE`` labelled documents each; None if only one has any.

    Of rows with one doc_id the text of least hash is learned from.  A document
    comes to the driver as at most ``BUCKETS`` weights, and they are put in the
    order of the identifiers, so the model does not depend on partitions.
    """
    sizes = {r["domain"]: r["count"] for r in domains.groupBy("domain").count().collect()}
    chosen = None
    for name in names:
        part = domains.filter(F.col("domain") == name).orderBy(F.xxhash64("_id", F.lit(13)), "_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.union(part)
    # at most len(names) * SAMPLE rows of an identifier and a name
    need = with_texts(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = need.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "domain", "text")
    once = texts.groupBy("id").agg(F.min_by(F.struct("domain", "text"), F.xxhash64("text")).alias("r")).select("id", "r.domain", "r.text")
    got = once.mapInPandas(_encode, "id long, domain string, buckets binary, weights binary, shape binary").toPandas().sort_values("id")
    if got["domain"].nunique() < 2:
        return None
    rows = [(np.frombuffer(b, "<i4"), np.frombuffer(w, "<f4"), np.frombuffer(s, "<f4")) for b, w, s in zip(got["buckets"], got["weights"], got["shape"])]
    labels = np.array([names.index(x) for x in got["domain"]])
    drawn = np.bincount(labels, minlength=len(names))
    scale = np.array([sizes.get(n, 0) / max(1, drawn[i]) for i, n in enumerate(names)])
    weights = scale[labels] / (scale[labels].mean() or 1)
    model = train(rows, labels, names, np.minimum(weights, 10).astype(np.float32))
    del got, rows
    give_back()
    return model


class _Judge:
    """Words and posteriors, (n, domains), of whole texts."""

    def __init__(self, model: Classifier | None, names: list[str]) -> None:
        self.model, self.even, self.known = model, np.full(len(names), 1 / len(names)), _Tokens()

    def __call__(self, texts: list[str | None]) -> tuple[list[int], np.ndarray]:
        sizes, posts = [], np.empty((len(texts), len(self.even)))
        for i, t in enumerate(texts):
            buckets, weights, shape, n = features(t, self.known)
            posts[i] = self.model.posterior(buckets, weights, shape) if self.model else self.even
            sizes.append(n)
            if len(self.known) > CACHE:
                self.known.clear()
        return sizes, posts


def posteriors(docs: DataFrame, model: Classifier | None, names: list[str]) -> DataFrame:
    """``doc_id, tokens, p_<domain>...`` of every whole text; without a model all domains are equally likely."""
    schema = ", ".join(["doc_id long", "tokens long", *(f"p_{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        judge = _Judge(model, names)
        for b in batches:
            sizes, posts = judge(b.column("text").to_pylist())
            yield beside(b, ["doc_id"], tokens=pa.array(sizes, pa.int64()), **{f"p_{n}": pa.array(posts[:, i]) for i, n in enumerate(names)})

    return with_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Weighed residuals by step: all that a document needs to work out its rate."""

    residuals: list[np.ndarray]
    names: list[str]
    target: np.ndarray
    shares: np.ndarray
    lowest: float = LOWEST

    @property
    def miss(self) -> float:
        """Largest distance of a reached share from its target; not a number without tokens."""
        return float(np.abs(self.shares - self.target).max())

    @property
    def met(self) -> bool:
        return self.miss <= MISS

    def rates(self, posterior: np.ndarray, ahead: bool = False) -> np.ndarray:
        """Rates of documents with these posteriors (n, domains) after all steps; ``ahead``: where the next step starts.

        The gradient is taken per token, so a document's length does not
        change its rate and all documents of one posterior share one.  Steps
        start ahead of the last rates in the direction of the last change.
        """
        r = past = np.ones(len(posterior))
        for k, gap in enumerate(self.residuals):
            start = r + k / (k + 3) * (r - past)
            past, r = r, np.maximum(start - posterior @ gap - RIDGE * (start - 1), self.lowest)
        k = len(self.residuals)
        return r + k / (k + 3) * (r - past) if ahead else r


def _sums(rows: DataFrame, plan: Plan, ahead: bool = True) -> np.ndarray:
    """Expected tokens of each domain at the plan's rates."""
    columns = [f"p_{n}" for n in plan.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(columns))
        for b in batches:
            p = b[columns].to_numpy()
            total += (b["tokens"].to_numpy() * plan.rates(p, ahead)) @ p
        yield pd.DataFrame([total], columns=columns)

    parts = rows.select("tokens", *columns).mapInPandas(run, ", ".join(f"{c} double" for c in columns))
    found = parts.agg(*(F.sum(c).alias(c) for c in columns)).first()
    return np.array([found[c] or 0.0 for c in columns])


def _curvature(rows: DataFrame, names: list[str]) -> tuple[float, np.ndarray]:
    """All tokens, and the token-weighted mean of the outer products of the posteriors."""
    products = [F.sum(F.col("tokens") * F.col(f"p_{a}") * F.col(f"p_{b}")) for a in names for b in names]
    total, *flat = rows.agg(F.sum("tokens"), *products).first()
    return float(total or 0), np.array([float(x or 0) for x in flat]).reshape(len(names), -1) / max(1.0, float(total or 0))


def fit_rates(rows: DataFrame, targets: dict[str, float], steps: int = STEPS, budget: float = 1.0, lowest: float = LOWEST) -> Plan:
    """Projected gradient over ``rows`` (``tokens, p_<domain>...``) until the totals match or stand still.

    Rates are ``lowest`` at least.  The wanted totals are the target shares of
    ``budget`` times all tokens, or, with a floor that drops nothing, of
    ``budget`` times the least number that cuts no domain below the floor.
    """
    names = list(targets)
    target = np.array([targets[n] for n in names], dtype=np.float64)
    target = target / target.sum()
    total, curvature = _curvature(rows, names)
    plan = Plan([], names, target, np.full(len(names), np.nan), lowest)
    if not total:
        return plan
    weight = np.linalg.inv(curvature + 1e-6 * np.eye(len(names)))
    natural = mass = curvature.sum(axis=1)
    least = max(1.0, lowest * (natural / np.maximum(target, 1e-12))[target > 0].max())
    wanted = budget * least * target
    last = np.inf
    for _ in range(steps):
        gap = mass - wanted
        if np.abs(gap).max() < 1e-4 or np.abs(gap - last).max() < 1e-6:
            break
        last = gap
        plan.residuals.append(weight @ gap)
        mass = _sums(rows, plan) / total
    mass = _sums(rows, plan, ahead=False)
    plan.shares = mass / mass.sum()
    return plan


def meet_targets(rows: DataFrame, targets: dict[str, float], lowest: float = LOWEST) -> Plan:
    """The plan whose shares come within ``MISS`` of the targets, or of the least miss.

    With a floor above zero and soft posteriors a wanted document brings tokens
    of the other domains too and none may fall below the floor, so the least
    budget can be too small: budgets grow while that helps.  Targets against
    shares are logged, as a warning where they are out of reach.
    """
    best = fit_rates(rows, targets, lowest=lowest)
    for n in range(1, BUDGETS + 1 if lowest else 1):
        if not best.miss > MISS:
            break
        plan = fit_rates(rows, targets, budget=LARGER**n, lowest=lowest)
        if not plan.miss < 0.95 * best.miss:
            break
        best = plan
    said = ", ".join(f"{n} {s:.4f} (target {t:.4f})" for n, s, t in zip(best.names, best.shares, best.target))
    _log.log(logging.WARNING if best.miss > MISS else logging.INFO, "shares reached: %s", said)
    return best


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, lowest: float = LOWEST) -> DataFrame:
    """``doc_id, tokens, p_<domain>..., rate, share_<domain>..., met`` of every row of ``docs``.

    ``rate`` is the expected number of times the document stands in the
    mixture, ``lowest`` at least.  ``share_<domain>`` are the shares that all
    rates together reach and ``met`` says whether each is within ``MISS`` of
    its target; these are the same in every row.  Null and empty texts have no
    tokens and the rate of their posterior.  Without labels of two domains all
    posteriors are equal, the rates stay 1 and the shares are null.  Repeated
    rows come back repeated.
    """
    targets = targets or TARGETS
    names = list(targets)
    model = fit(docs, domain_of(labels), names)
    rows = cut(posteriors(docs, model, names))
    if model is None:
        return rows.withColumns({"rate": F.lit(1.0)} | {f"share_{n}": F.lit(None).cast("double") for n in names} | {"met": F.lit(False)})
    plan = meet_targets(rows, targets, lowest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posterior = np.stack([b.column(f"p_{n}").to_numpy() for n in names], axis=1)
            yield beside(b, rows_columns, rate=pa.array(plan.rates(posterior)))

    rows_columns = rows.columns
    schema = ", ".join(["doc_id long", "tokens long", *(f"p_{n} double" for n in names), "rate double"])
    shares = {f"share_{n}": F.lit(float(s)) for n, s in zip(names, plan.shares)}
    return rows.mapInArrow(run, schema).withColumns(shares | {"met": F.lit(plan.met)})


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, lowest: float = KEEPING) -> DataFrame:
    """``docs`` mixed: each row as often as its rate says, the fraction settled by a hash of its identifier.

    With ``lowest`` 1 every document stays and those of wanted domains are
    repeated; where that cannot reach the targets, a warning says what was
    reached.  The classifier runs beside the text again, so no text is
    shuffled and repeated identifiers cannot multiply.  All columns come back
    as they were.
    """
    targets = targets or KEEPING_TARGETS
    names = list(targets)
    model = fit(docs, domain_of(labels), names)
    if model is None:
        return docs
    plan = meet_targets(cut(posteriors(docs, model, names)), targets, lowest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        judge = _Judge(model, names)
        for b in batches:
            rate = plan.rates(judge(b.column("text").to_pylist())[1])
            luck = np.array([zlib.crc32(f"mix {i}".encode()) / 2**32 for i in b.column("doc_id").to_pylist()])
            times = np.floor(rate).astype(int) + (luck < rate % 1)
            places = np.repeat(np.arange(b.num_rows), times)
            for at in range(0, len(places), ROWS):
                yield b.take(pa.array(places[at : at + ROWS]))

    return with_texts(docs).mapInArrow(run, docs.schema)
