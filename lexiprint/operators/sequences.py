"""What follows a point on its path, and where a path comes back to itself, for paths of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.functions import text as T

#: Points that a span of positions should hold, and spans at least where there is more than one.
SPAN, LEAST_SPANS = 50_000, 8
#: Points of a cell that are compared with each other in one task; fuller cells are compared piece by piece.
PIECE = 2048


def dot(a: Column, b: Column) -> Column:
    return T.sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def span_of(at: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted ``bounds`` are at or below ``at``: a tree of comparisons, so few are made for a row."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(at >= F.lit(float(bounds[half])), span_of(at, bounds[half + 1 :], first + half + 1)).otherwise(span_of(at, bounds[:half], first))


def longest_of(points: DataFrame) -> int:
    """Points of the longest path."""
    return points.groupBy("path").count().agg(F.max("count")).first()[0] or 0


def spans_for(longest: int) -> int:
    return 1 if longest <= SPAN else max(LEAST_SPANS, -(-longest // SPAN))


def following(points: DataFrame, k: int, value: str = "vec", spans: int | None = None) -> DataFrame:
    """``points`` (``path, pos`` and ``value``) with ``after``: the ``value`` of the next ``k`` points of the path, or fewer.

    A window over whole paths would bring a path to one task.  Positions are
    cut at quantiles; points are ordered within path and span, and what the
    last of a span need comes from the first ``k`` of the next spans, over a
    row per path and span.  Positions are numbers and differ within a path; a
    null path is one of its own.  There are as many ``spans`` as the longest
    path needs for ``SPAN`` points in each, and one, without a further
    exchange, if no path is longer than that.
    """
    if spans is None:
        spans = spans_for(longest_of(points))
    if spans == 1:
        whole = Window.partitionBy("path").orderBy("pos")
        ahead = F.filter(F.array(*(F.lead(F.struct(F.col(value).alias("x")), i).over(whole) for i in range(1, k + 1))), lambda s: s.isNotNull())
        return points.withColumn("after", F.transform(ahead, lambda s: s["x"]))
    (bounds,) = points.agg(F.percentile_approx(F.col("pos").cast("double"), [i / spans for i in range(1, spans)], 16 * spans)).first()
    spanned = points.withColumn("span", span_of(F.col("pos").cast("double"), sorted(set(bounds or []))))
    inside = Window.partitionBy("path", "span").orderBy("pos")
    ranked = spanned.withColumn("nth", F.row_number().over(inside)).filter(F.col("nth") <= k)
    heads = ranked.groupBy("path", "span").agg(F.sort_array(F.collect_list(F.struct("nth", F.col(value).alias("x")))).alias("h")).withColumn("h", F.transform("h", lambda s: s["x"]))
    by_span = Window.partitionBy("path").orderBy("span")
    empty = F.slice("h", 1, 0)
    later = heads.select(F.col("path").alias("_path"), F.col("span").alias("_span"), F.slice(F.concat(*(F.coalesce(F.lead("h", i).over(by_span), empty) for i in range(1, k + 1))), 1, k).alias("later"))
    own = F.filter(F.array(*(F.lead(F.struct(F.col(value).alias("x")), i).over(inside) for i in range(1, k + 1))), lambda s: s.isNotNull())
    joined = spanned.withColumn("own", F.transform(own, lambda s: s["x"])).join(later, F.col("path").eqNullSafe(F.col("_path")) & (F.col("span") == F.col("_span")))
    return joined.withColumn("after", F.slice(F.concat("own", "later"), 1, k)).drop("own", "later", "span", "_path", "_span")


def decay(points: DataFrame) -> DataFrame:
    """``path, n, decay_k1, decay_k2, decay_k3``: mean cosine of a point with the ones one, two and three further.

    Only points with three others behind them count; fewer than four give 0s.
    A vector without length has the cosine 0 with any.
    """
    norm = lambda v: F.sqrt(dot(v, v))
    cosine = lambda a, b: F.when(norm(a) * norm(b) > 0, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)
    got = following(points.select("path", "pos", "vec"), 3)
    whole = F.size("after") == 3
    lags = [F.avg(F.when(whole, cosine(F.col("vec"), F.get("after", i)))) for i in range(3)]
    return got.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(x, F.lit(0.0)).alias(f"decay_k{i + 1}") for i, x in enumerate(lags)))


def _within(x: np.ndarray, pos: np.ndarray, after: np.ndarray, r: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which points have a later one and which an earlier one nearer than ``r``, direct neighbours and those of the same ``own`` left out."""
    early, late = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
    square = (x * x).sum(axis=1)
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        far = square[part, None] + square - 2 * x[part] @ x.T
        slack = 1e-9 * (square[part, None] + square + 1)
        met = (far <= r * r + slack) & (pos > after[part, None])
        # only what may be near is measured
        i, j = np.nonzero(met if own is None else met & (own != own[part, None]))
        near = np.sqrt(((x[i + at] - x[j]) ** 2).sum(axis=1)) < r
        early[i[near] + at] = True
        late[j[near]] = True
    return early, late


def _near(radius: str):
    """Points of a cell that have a later or an earlier one within the path's radius, but for direct neighbours."""

    def run(rows: pa.Table) -> pa.Table:
        x = np.array(rows["vec"].to_pylist(), dtype=np.float64)
        pos, after, own = (rows[c].to_numpy() for c in ("pos", "next_pos", "own"))
        same = rows["left"][0].as_py() == rows["right"][0].as_py()
        early, late = _within(x, pos, after, rows[radius][0].as_py(), None if same else own)
        found = [(p, True) for p in pos[early].tolist()] + [(p, False) for p in pos[late].tolist()]
        return pa.table({"path": pa.array([rows["path"][0].as_py()] * len(found), rows.schema.field("path").type), "pos": pa.array([p for p, _ in found], pa.float64()), "early": pa.array([e for _, e in found], pa.bool_())})

    return run


def _near_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, early, late``: how many points of a whole path, a row, have a later and an earlier one within its radius."""
    for b in batches:
        values = lambda c: [x.values.to_numpy() for x in b.column(c)]
        counts: list[tuple[int, int]] = []
        for r, pos, after, x in zip(b.column("radius").to_pylist(), values("at"), values("next_at"), values("x")):
            counts.append(tuple(len(np.unique(pos[m])) for m in _within(x.reshape(len(pos), -1), pos, after, r)))
        early, late = list(zip(*counts)) or [(), ()]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(early, pa.int64()), pa.array(late, pa.int64())], names=["path", "early", "late"])


def returns(points: DataFrame, piece: int = PIECE) -> DataFrame:
    """``path, n, return_rate, orbit_rate`` of ``path, pos, vec``: how often a path comes back within half its mean jump.

    ``return_rate`` is the share of points with a later one that near, their
    direct successor left out; a path without jumps takes 0.1 as its radius.
    ``orbit_rate`` is the share of the points from the third on with an
    earlier one that near, their direct predecessor left out.  Fewer than
    three points give 0s.  Vectors that are null or of another length than
    the path's first take no part, but count as points.

    A path of up to ``piece`` points is one row and its points are compared with
    each other.  In a longer one two pivots, its first point and the one farthest from it, give
    each point two distances; points within the radius differ by it at most in
    both.  So points are dealt to cells of that size, each to its own and the
    next in either direction, and only points of a cell meet; a cell of more than
    ``piece`` points is cut in pieces and every two pieces meet in a task of
    their own.
    """
    kind = points.schema["path"].dataType.simpleString()
    pos = F.col("pos").cast("double")
    vec = F.col("vec").cast("array<double>")
    base = points.select("path", pos.alias("pos"), vec.alias("vec"))
    longest = longest_of(base)
    ahead = following(base.withColumn("both", F.struct("pos", "vec")), 1, value="both", spans=spans_for(longest))
    length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    ahead = ahead.withColumns({"next_pos": F.get("after", F.lit(0))["pos"], "jump": length(F.col("vec"), F.get("after", F.lit(0))["vec"])}).drop("after", "both")
    stats = ahead.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.avg("jump").alias("jump"), F.min_by("vec", "pos").alias("p1"))
    on = lambda side: F.col("path").eqNullSafe(F.col(side))
    radius = F.when(F.col("jump") > 0, F.col("jump") / 2).otherwise(0.1)
    first = stats.filter("n >= 3").select(F.col("path").alias("_path"), radius.alias("radius"), "p1", "n")
    every = ahead.join(first, on("_path")).drop("_path").filter(F.size("vec") == F.size("p1"))
    no_later = F.coalesce("next_pos", F.lit(float("inf")))
    lists = every.filter(F.col("n") <= piece).groupBy("path").agg(F.first("radius").alias("radius"), F.collect_list(F.struct("pos", no_later.alias("next_pos"), "vec")).alias("z"))
    side = lambda k: F.transform("z", lambda p: p[k])
    marks = lists.select("path", "radius", side("pos").alias("at"), side("next_pos").alias("next_at"), F.flatten(side("vec")).alias("x")).mapInArrow(_near_whole, f"path {kind}, early long, late long")
    if longest > piece:
        marks = marks.unionAll(_near_by_cells(every.filter(F.col("n") > piece), piece, length, on, kind))
    marks = marks.withColumnRenamed("path", "_path")
    both = stats.select("path", "n", "jump").join(marks, on("_path"), "left")
    share = lambda c, of: F.coalesce(F.col(c), F.lit(0)) / F.greatest(of, F.lit(1))
    # without jumps the second kind has a radius of 0
    return both.select("path", "n", F.when(F.col("n") >= 3, share("early", F.col("n"))).otherwise(0.0).alias("return_rate"), F.when((F.col("n") >= 3) & (F.col("jump") > 0), share("late", F.col("n") - 2)).otherwise(0.0).alias("orbit_rate"))


def _near_by_cells(met: DataFrame, piece: int, length, on, kind: str) -> DataFrame:
    """``path, early, late`` as of ``_near_whole``, by the cells of ``returns``."""
    met = met.withColumn("d1", length(F.col("vec"), F.col("p1")))
    second = met.groupBy("path").agg(F.max_by("vec", "d1").alias("p2")).withColumnRenamed("path", "_path")
    met = met.join(second, on("_path")).drop("_path").withColumn("d2", length(F.col("vec"), F.col("p2")))
    # a little wider than the radius, so that rounding parts no pair
    cell = lambda d: F.floor(F.col(d) / (F.col("radius") * (1 + 1e-9)))
    near = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1))
    dealt = met.select("path", "pos", "next_pos", "vec", "radius", cell("d1").alias("a0"), cell("d2").alias("b0")).withColumn("a", near("a0")).withColumn("b", near("b0")).drop("a0", "b0")
    full = dealt.groupBy("path", "a", "b").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select(F.col("path").alias("_path"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.ceil(F.col("m") / piece).cast("int").alias("pieces"))
    cut = dealt.join(full, on("_path") & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).withColumn("own", F.pmod(F.xxhash64("pos"), F.col("pieces")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("path", "a", "b", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "pos", F.coalesce("next_pos", F.lit(float("inf"))).alias("next_pos"), "vec", "radius")
    found = spread.groupBy("path", "a", "b", "left", "right").applyInArrow(_near("radius"), f"path {kind}, pos double, early boolean").distinct()
    return found.groupBy("path").agg(F.count_if("early").alias("early"), F.count_if(~F.col("early")).alias("late"))
