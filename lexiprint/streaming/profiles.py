"""Running profiles and drift over streams of fingerprints.

A running mean is a grouped average with Spark's state.  Drift needs each
model's first sample and last distance, which a small state per model keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiprint.operators import profiles as P
from lexiprint.operators.registry import extract

OUT = "model string, ts long, drift double, level string, change boolean"
STATE = "base array<double>, last double"
LEVELS = [(0.25, "critical"), (0.15, "high"), (0.10, "medium"), (0.05, "low")]


def running_components(stream: DataFrame) -> DataFrame:
    """``model, dim, n, mean`` of ``model, vec``, brought up to date by every batch."""
    return P.long_form(stream, "model").groupBy("model", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


def level(distance: float) -> str:
    return next((name for least, name in LEVELS if distance >= least), "none")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    base, last = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values("ts")
    out = []
    for ts, vec in zip(rows["ts"], rows["vec"]):
        vec = np.asarray(vec, dtype=float)
        if base is None:
            base = vec.tolist()
        now = float(np.linalg.norm(vec - np.asarray(base)))
        out.append((key[0], int(ts), now, level(now), last is not None and abs(now - last) > 0.10))
        last = now
    state.update((base, last))
    yield pd.DataFrame(out, columns=["model", "ts", "drift", "level", "change"])


def drift_stream(samples: DataFrame) -> DataFrame:
    """Drift of every sample (``model, ts, vec``) from the model's first; samples of a batch are taken in order of time."""
    return samples.select("model", F.col("ts").cast("long"), F.col("vec").cast("array<double>")).groupBy("model").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def feature_stream(docs: DataFrame, groups: list[str]) -> DataFrame:
    """Features of a stream of documents; without state, so rows leave with the batch they came in."""
    return extract(docs, groups)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``start, key, n, mean`` of ``ts, key, value`` in tumbling or sliding windows; rows later than ``late`` are let go."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "key", "n", "mean")
