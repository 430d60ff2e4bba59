"""Approximate nearest neighbours by cross-polytope hashing.

A hash function turns unit vectors by a pseudo-rotation, three rounds of random
signs and a Hadamard transform, and takes them to the nearest signed axis.  A
table strings two functions together, so it has the square of twice the
dimensions as buckets.  A query probes the buckets whose axes lie nearest to it
in sum.  Vectors of a probed bucket are candidates and are ranked by their inner
product with the query in double precision.

A query probes as many buckets whatever the number of vectors, so whether it
meets a vector depends on these two alone and not on what else the table holds.
The more evenly spread vectors there are, the nearer the nearest of them lie and
the fewer probes would do: a caller whose vectors are known to be so may pass
``probes_for`` their number.

Buckets are dealt to tasks by cells of neighbouring buckets, more cells the more
vectors there are; cells are cut in pieces of bounded size, so one of any
fullness is spread over tasks, and nothing is dropped from it.  A vector
travels once a table; to send pairs of identifiers instead and fetch vectors
for each pair would move more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import cut

#: Tables, and functions strung together in each.
TABLES, FUNCTIONS = 8, 2
#: Buckets that a query probes in each table, and the least that ``probes_for`` gives.
PROBES, LEAST_PROBES = 1280, 32
#: Nearest axes of one function that probes are made of.
AXES = 64
TOP = 20
SEED = 17
#: Vectors that a cell should hold, and the least cells of a table.
CELL, LEAST_CELLS = 4096, 32
#: Vectors and queries of a cell that meet in one task at most, and queries multiplied at once there.
PIECE, QUERIES, AT_ONCE = 8192, 1 << 16, 1024
#: Cells whose sizes are sent to every task at most.
SENT = 1_000_000


def probes_for(n: int, probes: int = PROBES) -> int:
    """Buckets that suffice among ``n`` evenly spread vectors if ``probes`` do among 500."""
    return max(LEAST_PROBES, round(probes * (500 / max(n, 1)) ** 0.25))


def signs(tables: int, dim: int, seed: int = SEED) -> np.ndarray:
    """(tables, 3, size) random signs; size is the power of two from ``dim`` on."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the rows."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def rotate(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of the unit rows of ``x``, padded with zeros."""
    out = np.zeros((len(x), table.shape[1]))
    out[:, : x.shape[1]] = x
    for s in table:
        out = hadamard(out * s)
    return out


def signed_axes(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How far each row of ``x`` lies along each signed axis: the axes' positive ends, then the negative ones."""
    turned = rotate(x / np.linalg.norm(x, axis=1, keepdims=True), table)
    return np.concatenate([turned, -turned], axis=1)


def bucket(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Bucket of each row by the functions of one table: the nearest axes as digits."""
    code = np.zeros(len(x), dtype=np.int64)
    for table in tables:
        code = code * 2 * tables.shape[2] + signed_axes(x, table).argmax(axis=1)
    return code


def probed(x: np.ndarray, tables: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` buckets of greatest sum over the functions, a row each; its own bucket is among them."""
    codes = np.zeros((len(x), 1), dtype=np.int64)
    far = np.zeros((len(x), 1))
    for table in tables:
        along = signed_axes(x, table)
        axes = np.argsort(-along, axis=1, kind="stable")[:, :AXES]
        far = (far[:, :, None] + np.take_along_axis(along, axes, axis=1)[:, None]).reshape(len(x), -1)
        codes = (codes[:, :, None] * along.shape[1] + axes[:, None]).reshape(len(x), -1)
        if far.shape[1] > probes:
            best = np.argpartition(-far, probes - 1, axis=1)[:, :probes]
            far, codes = np.take_along_axis(far, best, axis=1), np.take_along_axis(codes, best, axis=1)
    return codes


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that can take part; single precision stays single."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def _packed(v: pd.Series) -> np.ndarray:
    """The vectors' bytes in their own precision, which travel faster than lists."""
    out = np.empty(len(v), dtype=object)
    out[:] = [x.tobytes() for x in v]
    return out


def _unpacked(v: pd.Series, dim: int) -> np.ndarray:
    data = b"".join(v)
    return np.frombuffer(data, dtype=f"<f{len(data) // (dim * len(v))}").reshape(-1, dim).astype(np.float64)


def _hashed(turns: np.ndarray, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _packed(b["v"])
            for n, tables in enumerate(turns if len(b) else []):
                code = bucket(_matrix(b["v"]), tables)
                yield pd.DataFrame({"tab": n, "cell": code // width, "code": (code % width).astype(np.int32), "vec_id": b["vec_id"], "v": v})

    return run


def _probing(turns: np.ndarray, width: int, probes: int, step: int = 128):
    """A row for each query, table and probed cell, with the probed codes in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.iloc[at : at + step]
                x = _matrix(b["v"])
                v = _packed(b["v"])
                for n, tables in enumerate(turns):
                    codes = np.sort(probed(x, tables, probes), axis=1)
                    cell = codes // width
                    starts = np.ones(codes.shape, dtype=bool)
                    starts[:, 1:] = cell[:, 1:] != cell[:, :-1]
                    first = np.nonzero(starts.ravel())[0]
                    ends = np.append(first[1:], codes.size) * 4
                    data = (codes % width).astype("<i4").tobytes()
                    parts = [data[i:j] for i, j in zip((first * 4).tolist(), ends.tolist())]
                    row = first // codes.shape[1]
                    yield pd.DataFrame({"tab": n, "cell": cell.ravel()[first], "codes": parts, "vec_id": b["vec_id"].to_numpy()[row], "v": v[row]})

    return run


def best(query: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int, may: np.ndarray | None = None) -> pd.DataFrame:
    """Each query's ``top`` rows by inner product, itself left out, ties to smaller ids.

    ``may`` (queries, rows) marks the candidates.  A matrix product picks the
    rows within rounding of the best; these are multiplied out one by one, so
    equal vectors have equal scores.
    """
    rough = query @ x.T
    rough[query_ids[:, None] == ids[None]] = -np.inf
    if may is not None:
        rough[~may] = -np.inf
    slack = np.linalg.norm(query, axis=1) * np.linalg.norm(x, axis=1).max(initial=0) * 1e-9
    limit = np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top] if len(ids) > top else np.full(len(query), -np.inf)
    q, c = np.nonzero((rough >= (limit - slack)[:, None]) & (rough > -np.inf))
    score = (query[q] * x[c]).sum(axis=1)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    keep = nth < top
    return pd.DataFrame({"query_id": query_ids[q[keep]], "vec_id": ids[c[keep]], "score": score[keep]})


_FOUND = "query_id long, ids binary, scores binary"


def _rows(found: list[pd.DataFrame]) -> pd.DataFrame:
    """A row a query with its neighbours' identifiers and scores as bytes, of frames sorted by query."""
    out: dict[str, list] = {"query_id": [], "ids": [], "scores": []}
    for f in found:
        q = f["query_id"].to_numpy()
        first = np.nonzero(np.append(True, q[1:] != q[:-1]))[0] if len(q) else np.array([], dtype=int)
        ids, scores = f["vec_id"].to_numpy().astype("<i8").tobytes(), f["score"].to_numpy().astype("<f8").tobytes()
        for i, a, b in zip(q[first].tolist(), (first * 8).tolist(), (np.append(first[1:], len(q)) * 8).tolist()):
            out["query_id"].append(i)
            out["ids"].append(ids[a:b])
            out["scores"].append(scores[a:b])
    return pd.DataFrame(out).astype({"query_id": "int64"})


def _merged(met: DataFrame, top: int) -> DataFrame:
    """``query_id, vec_ids, scores``: the best of what was found for each query in all its cells, a vector once.

    A piece of a cell gives a query ``top`` neighbours at most, so what comes
    together for a query are its probed cells, and those of over ``PIECE``
    vectors once for each piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            for parts in b["parts"]:
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<i8")
                scores = np.frombuffer(b"".join(p["scores"] for p in parts), dtype="<f8")
                order = np.lexsort((ids, -scores))
                _, first = np.unique(ids[order], return_index=True)
                order = order[np.sort(first)][:top]
                kept.append((ids[order], scores[order]))
            yield pd.DataFrame({"query_id": b["query_id"], "vec_ids": [k[0] for k in kept], "scores": [k[1] for k in kept]})

    together = met.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("parts"))
    return together.mapInPandas(run, "query_id long, vec_ids array<long>, scores array<double>")


def _meet(top: int, width: int, dim: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return _rows([])
        x, ids, codes = _unpacked(rows["v"], dim), rows["vec_id"].to_numpy(), rows["code"].to_numpy()
        found = []
        for at in range(0, len(queries), AT_ONCE):
            q = queries.iloc[at : at + AT_ONCE]
            asked = np.zeros((len(q), width), dtype=bool)
            asked[np.repeat(np.arange(len(q)), q["codes"].map(len) // 4), np.frombuffer(b"".join(q["codes"]), "<i4")] = True
            found.append(best(_unpacked(q["v"], dim), q["vec_id"].to_numpy(), x, ids, top, asked[:, codes]))
        return _rows(found)

    return run


def _cut_up(hashed: DataFrame, probing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by cell, piece and part: each piece of a cell's vectors meets each part of its queries.

    Cells are so many that an even one is a single piece, and since a query
    probes fewer buckets the more there are, it has about 100 * probes queries
    at most, one part.  Only cells fuller than that are cut.
    """
    keys = ["tab", "cell"]
    n = lambda rows, most, name: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # a row for each cell that both sides know, at most tables times the cells, of which there are about n / CELL
    sizes = cut(n(hashed, PIECE, "pieces").join(n(probing, QUERIES, "parts"), keys))
    sizes = F.broadcast(sizes) if sizes.count() <= SENT else sizes
    spread = hashed.join(sizes, keys).withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = probing.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), "parts").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return spread.drop("pieces", "parts"), sent.drop("pieces", "parts")


def neighbours(queries: DataFrame, vectors: DataFrame, top: int = TOP, tables: int = TABLES, probes: int = PROBES, functions: int = FUNCTIONS, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found for each query.

    Both sides have ``vec_id`` and ``embedding``; vectors that are null, zero,
    or hold null or non-finite components take no part.  Vectors of one length
    are searched among themselves, a pass for each length.  A row is never a
    candidate of its own identifier.  Rows of one identifier count once, by the
    best score of their vectors, whether among the queries or the candidates.  A query with fewer
    than ``top`` found candidates is answered from all vectors.  ``probes`` are
    the buckets that a query probes in each table.
    """
    all_rows, asked = usable(vectors), usable(queries)
    # a row for each length
    sizes = sorted((r["dim"], r["count"]) for r in all_rows.groupBy(F.size("v").alias("dim")).count().collect())
    found = [_of_length(asked, all_rows, dim, n, top, tables, probes, functions, seed) for dim, n in sizes]
    if not found:
        return vectors.sparkSession.createDataFrame([], _RANKED)
    return reduce(DataFrame.unionByName, found)


_RANKED = "query_id long, rank int, vec_id long, score double"


def _of_length(queries: DataFrame, vectors: DataFrame, dim: int, n: int, top: int, tables: int, probes: int, functions: int, seed: int) -> DataFrame:
    """``neighbours`` among the ``n`` usable vectors of length ``dim``."""
    rows = vectors.filter(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    asked = queries.filter(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    turns = np.stack(np.split(signs(tables * functions, dim, seed), tables))
    buckets = (2 * turns.shape[3]) ** functions  # a power of two
    width = buckets
    while width > 1 and (buckets // width < LEAST_CELLS or buckets // width * CELL < n):
        width //= 2
    probes = min(probes, buckets)
    hashed = cut(rows.mapInPandas(_hashed(turns, width), "tab int, cell long, code int, vec_id long, v binary"))
    probing = cut(asked.mapInPandas(_probing(turns, width, probes), "tab int, cell long, codes binary, vec_id long, v binary"))
    spread, sent = _cut_up(hashed, probing)
    keys = ["tab", "cell", "piece", "part"]
    met = sent.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(_meet(top, width, dim), _FOUND)
    found = cut(_merged(met, top))
    answered = found.filter(F.size("vec_ids") >= top)
    scant = cut(asked.join(answered.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if short := scant.count():
        found = answered.unionByName(_merged(_exhaustive(scant, short, rows, n, top), top))
    ranked = found.select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _exhaustive(scant: DataFrame, short: int, rows: DataFrame, n: int, top: int) -> DataFrame:
    """Every row against the ``short`` queries that the tables leave short: blocks of rows meet blocks of queries."""
    pieces, parts = -(-n // (8 * PIECE)), -(-short // AT_ONCE)
    sent = scant.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    spread = rows.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(pieces))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(queries: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(x):
            return _rows([])
        return _rows([best(_matrix(queries["v"]), queries["vec_id"].to_numpy(), _matrix(x["v"]), x["vec_id"].to_numpy(), top)])

    keys = ["piece", "part"]
    return sent.withColumn("piece", F.col("piece").cast("long")).groupBy(*keys).cogroup(spread.withColumn("part", F.col("part").cast("long")).groupBy(*keys)).applyInPandas(run, _FOUND)


def nearest(vectors: DataFrame) -> DataFrame:
    """Neighbours of the vectors whose identifier is divisible by 20, among all vectors."""
    return neighbours(vectors.filter("vec_id % 20 = 0"), vectors)
