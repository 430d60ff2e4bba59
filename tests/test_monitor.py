"""The event-driven drift monitor: order, resets, silences, late rows, and cuts of the stream that change nothing."""

import datetime as dt
import random
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest

from lexiprint.plans import streams
from lexiprint.streaming import monitor as M

SCHEMA = "model string, ts timestamp, n long, vec array<double>, reset boolean"
START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def plain(rows, late, idle, kept):
    """All rows at once; the end of the stream is the latest time."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None]
    mark, out = max(r[1] for r in rows) - late, []
    for m in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == m), key=lambda r: r[:2])
        base = last = None
        recent = []
        for i, (ts, _, vec, reset) in enumerate(mine):
            if ts > mark:
                break
            if base is None or reset:
                base, last, recent = vec[0], None, []
            now = abs(vec[0] - base)
            recent = [*recent, now][-kept:]
            out.append((m, ts, "reset" if reset else "sample", round(now, 9), last is not None and abs(now - last) > M.JUMP, round(sum(recent) / len(recent), 9)))
            last = now
            ends = ts + idle
            if ends <= mark and (i + 1 == len(mine) or mine[i + 1][0] > ends):
                out.append((m, ends, "silent", round(now, 9), False, round(sum(recent) / len(recent), 9)))
    return sorted(out)


def run(spark, tmp_path, name, parts, late="2 hours", idle="5 hours"):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/{name}/in")
    got = M.run_to_end(M.drift_events(stream, late, idle), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/progress")
    return sorted((r["model"], r["ts"], r["kind"], round(r["drift"], 9), r["change"], round(r["recent"], 9)) for r in got.collect())


def samples(n=60):
    r = random.Random(3)
    return [(f"m{r.randrange(3)}", START + HOUR * r.choice([0.5, 1, 9]) * i / 2 + dt.timedelta(microseconds=r.randrange(999)), i, [r.random()], r.random() < 0.1) for i in range(n)]


def test_order_and_cuts_change_nothing(spark, tmp_path):
    rows = sorted(samples(), key=lambda r: r[1])
    extra = [(None, START, 1, [1.0], False), ("m1", None, 1, [1.0], False), ("m1", START, 1, None, False)]
    want = plain(rows, 2 * HOUR, 5 * HOUR, M.KEPT)
    assert {w[2] for w in want} == {"sample", "reset", "silent"}
    mixed = rows + extra
    random.Random(1).shuffle(mixed)
    assert run(spark, tmp_path, "one", [mixed]) == want
    # several batches, each in disorder
    thirds = [rows[:20], rows[20:40], rows[40:]]
    for t in thirds:
        random.Random(2).shuffle(t)
    assert run(spark, tmp_path, "three", thirds) == want


def test_late_rows_are_let_go_and_a_rerun_goes_on(spark, tmp_path):
    rows = [("a", START + i * HOUR, i, [0.1 * i], False) for i in range(10)]
    first = run(spark, tmp_path, "again", [rows])
    assert [r[1].hour for r in first] == list(range(8))
    second = run(spark, tmp_path, "again", [[("a", START + HOUR / 2, 99, [9.0], False), ("a", START + 30 * HOUR, 100, [0.0], False)]])
    assert not any(r[3] == 9.0 for r in second) and len([r for r in second if r[2] == "sample"]) == 10
    assert [r[2] for r in second].count("silent") == 1


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view events as from '{sf}/events.parquet'")
    want = db.sql(streams.ORACLES["monitored_drift"])
    got = streams.QUERIES["monitored_drift"](spark, sf).select(want.columns)
    rows = sorted(map(tuple, got.collect()), key=str)
    expected = sorted(want.fetchall(), key=str)
    assert len(rows) == len(expected) > 100 and {r[2] for r in rows} == {"sample", "reset", "silent"}
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4:6] == b[4:6] for a, b in zip(rows, expected))


class Calls:
    """A handle whose states are kept here and whose calls are counted."""

    def __init__(self):
        self.n, self.held, self.timers = 0, {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return State(self, name)

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.n += 1
        self.timers.append(ms)


class State:
    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def _at(self):
        self.calls.n += 1
        return self.calls.held.setdefault(self.name, {})

    def updateValue(self, key, value):  # noqa: N802
        self._at()[key] = value

    def getValue(self, key):  # noqa: N802
        return self._at()[key]

    def removeKey(self, key):  # noqa: N802
        del self._at()[key]

    def keys(self):
        return list(self._at())

    def iterator(self):
        return list(self._at().items())

    def exists(self):
        return bool(self._at())

    def get(self):
        return self._at()[0]

    def update(self, value):
        self._at()[0] = value


def test_calls_of_the_state_do_not_grow_with_the_samples():
    def calls(n):
        handle, drift = Calls(), M.Drift(M.KEPT, 10**9)
        drift.init(handle)
        batch = pd.DataFrame({"us": [i * 1000 for i in range(n)][::-1], "n": range(n), "vec": [[float(i)] for i in range(n)][::-1], "reset": False})
        list(drift.handleInputRows(("a",), iter([batch]), None))
        mark = SimpleNamespace(getCurrentWatermarkInMs=lambda: n // 2)
        got = pd.concat(drift.handleExpiredTimer(("a",), mark, None))
        assert got["drift"].tolist() == list(range(n // 2 + 1)) and handle.timers[-1] == n // 2 + 1
        return handle.n

    assert calls(1000) == calls(10) < 30


def test_many_samples_of_a_model_and_copies_of_one(spark, tmp_path):
    r = random.Random(5)
    rows = [("m", START + dt.timedelta(seconds=r.randrange(90_000)), i, [r.random()], r.random() < 0.01) for i in range(12_000)]
    assert run(spark, tmp_path, "many", [rows]) == plain(rows, 2 * HOUR, 5 * HOUR, M.KEPT)
    twice = [("a", START, 1, [0.0], False), ("a", START + HOUR, 2, [0.5], False), ("a", START + HOUR, 2, [0.5], False), ("a", START + 9 * HOUR, 3, [0.0], False)]
    assert [x[2] for x in run(spark, tmp_path, "twice", [twice])].count("sample") == 3
