"""Counts, means and co-moments of vectors by key: summed in each task, merged in any order.

Numbers of one key travel as one row a task, a matrix of all pairs of
components, where exploding a vector of d components would make d * d / 2 rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of matrices that a task holds before it sends them; merging takes any number of parts.
HELD = 64 << 20
_REST = "n long, mean array<double>, comoment array<double>"


def _merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _table(held: dict, key: str, kind: pa.DataType) -> pa.RecordBatch:
    names, parts = zip(*held.items())
    lists = [pa.array([x.ravel() for x in column], pa.list_(pa.float64())) for column in ([p[1] for p in parts], [p[2] for p in parts])]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], kind), pa.array([p[0] for p in parts], pa.int64()), *lists], names=[key, "n", "mean", "comoment"])


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def moments(vectors: DataFrame, key: str = "model") -> DataFrame:
    """``<key>, n, mean, comoment`` of ``<key>, vec``: one row a key and length of its vectors.

    ``comoment`` is the matrix of summed products of deviations, row by row.
    Vectors that are null, empty or hold nulls take no part; a null key is one
    of its own.
    """
    kind = vectors.schema[key].dataType.simpleString()
    good = vectors.select(key, F.col("vec").cast("array<double>").alias("vec")).filter(F.size("vec") > 0).filter(~F.exists("vec", lambda x: x.isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, arrow = 0, None
        for b in batches:
            arrow = b.column(key).type
            names = np.array(b.column(key).to_pylist(), dtype=object)
            lengths = b.column("vec").value_lengths().to_numpy()
            codes = {k: i for i, k in enumerate(dict.fromkeys(zip(names.tolist(), lengths.tolist())))}
            which = np.array([codes[k] for k in zip(names.tolist(), lengths.tolist())])
            for k, i in codes.items():
                x = _matrix(b.column("vec").filter(pa.array(which == i)))
                mean = x.mean(axis=0)
                part = (len(x), mean, (x - mean).T @ (x - mean))
                if k in held:
                    held[k] = _merge(held[k], part)
                else:
                    held[k], size = part, size + 8 * k[1] * (k[1] + 1)
            if size > HELD:
                yield _table(held, key, arrow)
                held, size = {}, 0
        if held:
            yield _table(held, key, arrow)

    return merged(good.mapInArrow(run, f"`{key}` {kind}, {_REST}"), key)


def merged(parts: DataFrame, key: str = "model") -> DataFrame:
    """``parts``, rows of ``moments`` of any pieces of the data, as one row a key and length."""
    kind = parts.schema[key].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        n, d = rows["n"].to_numpy(), len(rows["mean"][0])
        means, products = (np.stack([np.array(x.as_py()) for x in rows[c]]) for c in ("mean", "comoment"))
        mean = n @ means / n.sum()
        gap = means - mean
        whole = products.sum(axis=0).reshape(d, d) + (gap * n[:, None]).T @ gap
        return pa.table({key: rows[key].slice(0, 1), "n": [int(n.sum())], "mean": pa.array([mean], pa.list_(pa.float64())), "comoment": pa.array([whole.ravel()], pa.list_(pa.float64()))})

    return parts.select(key, "n", "mean", "comoment").groupBy(key, F.size("mean")).applyInArrow(run, f"`{key}` {kind}, {_REST}")


def covariances(found: DataFrame, key: str = "model", least: int = 2) -> DataFrame:
    """``<key>, i, j, cov`` (i <= j) of rows of ``moments`` with ``least`` vectors."""
    d = F.size("mean")
    cells = found.filter(F.col("n") >= least).select(key, "n", d.alias("d"), F.posexplode("comoment").alias("at", "c"))
    i, j = F.floor(F.col("at") / F.col("d")).cast("int"), (F.col("at") % F.col("d")).cast("int")
    return cells.select(key, i.alias("i"), j.alias("j"), (F.col("c") / (F.col("n") - 1)).alias("cov")).filter("i <= j")
