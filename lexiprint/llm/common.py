"""Small helpers shared by the operators: shared folders, heavy keys, joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy when it holds more than this share of the rows, so there are never more than 1,000.
HEAVY_SHARE = 1e-3
#: So many rows of one key a task joins without help.
LIGHT = 100_000
#: Rows with whole texts that a task hands to Python at once.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none a temporary folder is set for a local master;
    on a cluster it would be another folder for each executor, so that fails.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lexiprint-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``fresh_dir`` that nothing reads any more; one that cannot be removed stays."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not below the shared folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_texts(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches bounded for rows that hold whole texts.

    Spark's default of 10,000 rows would keep hundreds of megabytes of long
    texts in a Python worker.  A smaller setting of the session is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return docs


def unused(df: DataFrame, *names: str) -> list[str]:
    """The ``names``, each lengthened until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def key_of(*columns: Column) -> Column:
    """128 bits that tell rows apart by their ``columns``, nulls included."""
    parts = [p for c in columns for p in (c.isNull().cast("string"), F.octet_length(c.cast("string")).cast("string"), c.cast("string"))]
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def kept_in_worker() -> dict:
    """What a worker keeps for its later tasks, by name.

    Functions sent by value have no module of their own in the worker, so a
    module made for the purpose holds it.
    """
    return sys.modules.setdefault("_lexiprint_worker", types.ModuleType("_lexiprint_worker")).__dict__


def give_back(keep: str | None = None) -> None:
    """Returns what this Python worker does not need to the system; of what it kept for later tasks only ``keep`` stays.

    A worker outlives its task; what one stage leaves in it would count beside
    the memory of the next.
    """
    kept = kept_in_worker()
    for name in [n for n in kept if n != keep and not n.startswith("__")]:
        del kept[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it keep their own ways
        ctypes.CDLL(None).malloc_trim(0)


def beside(batch: pa.RecordBatch, kept: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The ``kept`` columns of ``batch`` as they are, identifiers and nulls to the last bit, and ``more`` behind them."""
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more.values()], names=[*kept, *more])


def attach(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``lookup``, which has one row per ``key`` and in ``count`` the key's rows.

    Keys with more than a thousandth of ``total`` rows, at most a thousand of
    them, are sent to every task; the others are joined by a shuffle.  So no
    task receives all rows of a heavy key.  Rows with a null key keep nulls.
    """
    floor = max(1.0, total * HEAVY_SHARE)
    values = [c for c in lookup.columns if c not in (key, count)]
    heavy = F.broadcast(lookup.filter(F.col(count) > floor).select(F.col(key).alias("_k"), F.lit(True).alias("_heavy"), *values))
    light = lookup.filter(F.col(count) <= floor).select(F.col(key).alias("_k"), *values)
    with_heavy = rows.join(heavy, rows[key] == F.col("_k"), "left").drop("_k")
    found = with_heavy.filter("_heavy").drop("_heavy")
    rest = with_heavy.filter("_heavy is null").drop("_heavy", *values)
    return found.unionByName(rest.join(light, rest[key] == F.col("_k"), "left").drop("_k"))


def attach_any(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per ``key``), whose keys may be as heavy as they like in ``rows``.

    Both are read twice, so they are to be cheap to read.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    most, total = counts.agg(F.max("_rows"), F.sum("_rows")).first()
    if (most or 0) <= LIGHT:
        return rows.join(lookup, key, "left")
    return attach(rows, lookup.join(counts, key), key, "_rows", total)
