"""Texts as paths of clause vectors where no sentence encoder is at hand.

A clause's vector is drawn from the normal distribution with a seed from its
digest: equal clauses have equal vectors, to the last bit, and others have
unrelated ones.  A document is one row, so its path is worked out beside its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexiprint.functions import text as T

DIM = 384
LEAST_WORDS = 3
# What ends a sentence, and what parts clauses in it.
# the look at the next character gives most places up at once
SENTENCE = r"(?=\s)(?<=[.!?])\s+"
CLAUSE = r"(?i)(?=[\s—])(?:(?<=[,;:])\s+|\s*—\s*|\s+(?:but|and|or|yet|so|however|therefore|thus|although|while)\s+)"
#: Vectors that a worker keeps.
KEPT = 20_000
FEATURES = ["concept_jump_mean", "concept_jump_variance", "path_tortuosity", "turning_angle_mean", "return_rate"]
_SCHEMA = ", ".join(["doc_id long", "waypoints long", *(f"{f} double" for f in FEATURES)])


def clauses_of(text: Column) -> Column:
    """Clauses of three words and more, without the words that join them."""
    parts = F.flatten(F.transform(F.split(text, SENTENCE), lambda s: F.transform(F.split(s, CLAUSE), T.strip)))
    return F.filter(parts, lambda c: F.size(T.ws_words(c)) >= LEAST_WORDS)


#: Seeded anew for each clause: a new generator would first gather entropy that the seed then replaces, which takes far longer than the draw.
_GENERATOR = np.random.RandomState(0)


def hash_vector(clause: str, dim: int = DIM) -> np.ndarray:
    _GENERATOR.seed(int(hashlib.md5(clause.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16))
    return _GENERATOR.randn(dim)


def path_features(x: np.ndarray) -> tuple[float, float, float, float, float]:
    """Mean and variance of jumps, tortuosity, mean turning angle and return rate of points in order; 0s, and 1 for the third, below two.

    A point from the third on returns if one before its predecessor lies within
    half the mean jump.
    """
    if len(x) < 2:
        return 0.0, 0.0, 1.0, 0.0, 0.0
    steps = np.diff(x, axis=0)
    size = np.linalg.norm(steps, axis=1)
    far, mean = float(np.linalg.norm(x[-1] - x[0])), float(size.mean())
    straight = size.sum() / far if far > 1e-6 else size.sum() * 10
    both = (size[:-1] > 1e-6) & (size[1:] > 1e-6)
    cosine = np.einsum("ij,ij->i", steps[:-1][both], steps[1:][both]) / (size[:-1][both] * size[1:][both])
    angles = np.arccos(np.clip(cosine, -1, 1))
    square, back = np.einsum("ij,ij->i", x, x), 0
    for at in range(2, len(x), 512):
        rows = np.arange(at, min(at + 512, len(x)))
        gap = square[rows, None] + square - 2 * x[rows] @ x.T
        near = (gap < (mean / 2) ** 2 + 1e-6) & (np.arange(len(x)) < rows[:, None] - 1)
        for i, row in zip(rows, near):
            back += bool(len(j := np.nonzero(row)[0]) and (np.linalg.norm(x[i] - x[j], axis=1) < mean / 2).any())
    return mean, float(size.var()), float(straight), float(angles.mean()) if len(angles) else 0.0, back / max(len(x) - 2, 1)


@F.pandas_udf(ArrayType(DoubleType()))
def path_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``path_features`` of arrays of clauses."""
    known: dict[str, np.ndarray] = {}
    for b in batches:
        found = []
        for clauses in b:
            x = np.stack([known[c] if c in known else known.setdefault(c, hash_vector(c)) for c in clauses]) if clauses is not None and len(clauses) else np.zeros((0, DIM))
            found.append(list(path_features(x)))
            if len(known) > KEPT:
                known.clear()
        yield pd.Series(found)


def prepare_a(df: DataFrame) -> DataFrame:
    return df.withColumn("a_path", path_vector(clauses_of(F.col("text"))))


def layer_a() -> dict[str, Column]:
    """The path of a text's clauses by hash vectors."""
    return {name: F.get("a_path", F.lit(i)) for i, name in enumerate(FEATURES)}


def text_paths(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """``doc_id, waypoints`` and the path's features of every text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for b in batches:
            rows = []
            for clauses in b.column("clauses").to_pylist():
                for c in clauses:
                    if c not in known:
                        known[c] = hash_vector(c, dim)
                x = np.stack([known[c] for c in clauses]) if clauses else np.zeros((0, dim))
                rows.append((len(x), *path_features(x)))
                if len(known) > KEPT:
                    known.clear()
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), clauses_of(T.text_of("text")).alias("clauses")).mapInArrow(run, _SCHEMA)
