"""Drift of models over a stream of samples, by event time.

Samples may come out of order and over any number of batches.  Each waits in
its model's state until the watermark has passed it and is then taken in order
of time by a timer, so results do not depend on how the stream was cut; rows
behind the watermark are late and let go.  State is bounded: what waits is
within the allowed lateness, and of the past a model keeps its baseline, its last
distance and the last ``KEPT`` distances.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiprint.streaming.profiles import level

#: Distances whose mean is the trend.
KEPT = 7
#: A jump of the distance by more than this is a change.
JUMP = 0.10
#: Samples of a model that wait together, and rows that leave together, at most.
CHUNK = 4096
OUT = "model string, ts timestamp, kind string, drift double, level string, change boolean, recent double"
#: The state store that timers and several states a key need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Drift(StatefulProcessor):
    """Samples, resets and silences of one model in order of time, in microseconds.

    A call of the state store costs far more than a sample does, so samples
    wait in sorted chunks, and a model has one timer, for what is due next.
    """

    def __init__(self, kept: int, idle: int) -> None:
        self.kept, self.idle = kept, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by the time of a chunk's first sample and the chunk's number
        self.waiting = handle.getMapState("waiting", "us long, chunk long", "us array<long>, n array<long>, vec array<array<double>>, reset array<boolean>")
        self.model = handle.getValueState("model", "base array<double>, last double, us long, told boolean, recent array<double>")
        # the time of the earliest timer, in milliseconds, or -1, and how many chunks there have been
        self.due = handle.getValueState("due", "ms long, chunks long")

    def _put(self, samples: list[tuple]) -> None:
        """Sorted samples wait in further chunks."""
        for at in range(0, len(samples), CHUNK):
            part = samples[at : at + CHUNK]
            self.waiting.updateValue((part[0][0], self.chunks), tuple([s[i] for s in part] for i in range(4)))
            self.chunks += 1

    def _wake(self, us: int, ms: int) -> int:
        """A timer for ``us``, unless there is one at ``ms`` that comes no later; the time of the earlier."""
        at = -(-us // 1000)
        if 0 <= ms <= at:
            return ms
        self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, self.chunks = self.due.get() if self.due.exists() else (-1, 0)
        for b in rows:
            samples = sorted(zip(b["us"].tolist(), b["n"].tolist(), (list(map(float, v)) for v in b["vec"]), map(bool, b["reset"].tolist())))
            if samples:
                self._put(samples)
                ms = self._wake(samples[0][0], ms)
        self.due.update((ms, self.chunks))
        return iter(())

    def _ready(self, at: int, later: list[int]) -> Iterator[tuple]:
        """All samples up to ``at`` in order, which then wait no more; the times of what still waits go to ``later``.

        A chunk is opened when the samples before its first have been taken.
        """
        keys, opened = sorted((int(us), int(n)) for us, n in self.waiting.keys()), []
        later += [us for us, _ in keys if us > at]
        for us, n in [k for k in keys if k[0] <= at]:
            while opened and opened[0][0] < us:
                yield heapq.heappop(opened)
            for s in zip(*self.waiting.getValue((us, n))):
                heapq.heappush(opened, (s[0], s[1], list(s[2]), s[3]))
            self.waiting.removeKey((us, n))
        while opened and opened[0][0] <= at:
            yield heapq.heappop(opened)
        if opened:
            later.append(opened[0][0])
            self._put(sorted(opened))

    def _silence(self, name: str, model: tuple, before: int) -> tuple[tuple, list[tuple]]:
        """The model, and a row if its last sample was followed by none for so long, told once."""
        base, last, us, told, recent = model
        if base is None or told or us + self.idle >= before:
            return model, []
        return (base, last, us, True, recent), [(name, pd.Timestamp(us + self.idle, unit="us"), "silent", last, level(last), False, sum(recent) / len(recent))]

    def _take(self, name: str, model: tuple, sample: tuple) -> tuple[tuple, tuple]:
        base, last, _, _, recent = model
        us, _, vec, reset = sample
        if base is None or reset:
            base, last, recent = vec, None, []
        now = math.dist(vec, base)
        recent = [*recent, now][-self.kept :]
        row = name, pd.Timestamp(us, unit="us"), "reset" if reset else "sample", now, level(now), last is not None and abs(now - last) > JUMP, sum(recent) / len(recent)
        return (base, now, us, False, recent), row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all that the watermark has passed, in order
        at, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        model = (None, None, None, True, [])
        if self.model.exists():
            base, last, us, told, recent = self.model.get()
            model = (list(base), last, us, told, list(recent))
        self.chunks, later = self.due.get()[1], []
        for s in self._ready(at, later):
            model, silent = self._silence(key[0], model, s[0])
            model, row = self._take(key[0], model, s)
            out += [*silent, row]
            if len(out) >= CHUNK:
                yield _frame(out)
                out = []
        model, silent = self._silence(key[0], model, at + 1)
        if out := out + silent:
            yield _frame(out)
        if model[0] is not None:
            self.model.update(model)
        if not model[3]:
            later.append(model[2] + self.idle)
        self.due.update((self._wake(min(later), -1) if later else -1, self.chunks))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def drift_events(samples: DataFrame, late: str = "1 hour", idle: str = "1 day", kept: int = KEPT) -> DataFrame:
    """``model, ts, kind, drift, level, change, recent``: each sample's distance from its model's baseline, in order of time.

    ``samples`` is a stream of ``model, ts, n, vec, reset``; ``n`` tells samples of
    one time apart.  The first sample of a model, and any with ``reset``, is the
    baseline from then on.  ``recent`` is the mean of the last ``kept``
    distances since.  A row of kind ``silent`` says that nothing came for ``idle``
    after a sample.  Rows come out once the watermark, ``late`` behind the
    latest time, has passed them.  Rows without model, time or vector take no part.
    """
    spark = samples.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    idle_us = int(pd.Timedelta(idle) / pd.Timedelta("1us"))
    good = samples.filter("model is not null and ts is not null and vec is not null").withWatermark("ts", late)
    rows = good.select("model", "ts", F.unix_micros("ts").alias("us"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("vec").cast("array<double>").alias("vec"), F.coalesce("reset", F.lit(False)).alias("reset"))
    return rows.groupBy("model").transformWithStateInPandas(Drift(kept, idle_us), OUT, "append", "eventTime")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What the stream gives until its source is read, as a table at ``path``; run again, it goes on where it ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
