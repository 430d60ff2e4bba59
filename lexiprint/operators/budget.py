"""Rows in order as long as their running cost stays within a budget.

No window goes over all rows: costs are summed over spans of the order, cut at
quantiles; the spans before the one in which the budget runs out are taken
whole, and only that span is cut again, until it is small enough for a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.operators.sequences import span_of

#: Spans that rows are cut in at once, and rows that a window may hold.
SPANS, LIGHT = 256, 100_000


def _spans(rows: DataFrame, by: str) -> Column:
    (bounds,) = rows.agg(F.percentile_approx(F.col(by).cast("double"), [i / SPANS for i in range(1, SPANS)], 16 * SPANS)).first()
    # the double next to each bound ends a span too, so a value that holds many rows has one of its own
    return span_of(F.col(by).cast("double"), sorted({x for b in bounds or [] for x in (b, math.nextafter(b, math.inf))}))


def _blocks(part: DataFrame, by: str, tie: str, light: int) -> DataFrame:
    """``part``, whose rows have a ``_span`` of ``by``, with ``_sub``: spans of over ``light`` rows cut again, by ``tie`` if they hold one value."""
    sizes = part.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"), F.min(by).alias("_low"), F.max(by).alias("_high")).filter(F.col("_n") > light)
    # at most SPANS rows
    heavy = {r["_span"]: r["_low"] == r["_high"] for r in sizes.collect()}
    if not heavy:
        return part.withColumn("_sub", F.lit(0))
    single = [k for k, one in heavy.items() if one]
    key = F.when(F.col("_span").isin(single), F.col(tie)).otherwise(F.col(by)).cast("double") if single else F.col(by).cast("double")
    keyed = part.withColumn("_key", F.when(F.col("_span").isin(list(heavy)), key))
    bounds = keyed.filter("_key is not null").groupBy("_span").agg(F.percentile_approx("_key", [i / SPANS for i in range(1, SPANS)], 16 * SPANS).alias("_bounds"))
    placed = keyed.join(F.broadcast(bounds), "_span", "left")
    return placed.withColumn("_sub", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))), F.lit(0))).drop("_bounds", "_key")


def within(rows: DataFrame, order: str, tie: str, cost: Column, budget: int, light: int = LIGHT) -> DataFrame:
    """``rows`` in order of ``order``, then ``tie``, both numbers, with ``running``: the cost so far, as long as it is ``budget`` at most.

    ``cost`` is a whole number; null and negative costs are 0.  The first row
    beyond the budget ends it, whatever comes behind.  Rows without order or
    tie take no part; rows equal in both are taken in the order of their hash.
    Both are below 2**53.
    """
    columns = rows.columns
    spent = F.greatest(F.coalesce(cost.cast("long"), F.lit(0)), F.lit(0))
    left = rows.filter(F.col(order).isNotNull() & F.col(tie).isNotNull()).withColumns({"_cost": spent, "_hash": F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in columns))})
    taken, before = [], 0
    while left.limit(light + 1).count() > light:
        ends = left.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in (order, tie, "_hash") for n, f in (("low", F.min), ("high", F.max)))).first()
        by = next((c for c in (order, tie, "_hash") if ends[f"low_{c}"] < ends[f"high_{c}"]), None)
        if by is None:
            break
        spanned = left.withColumn("_span", _spans(left, by))
        # at most twice SPANS rows
        sums = sorted((r["_span"], r["c"]) for r in spanned.groupBy("_span").agg(F.sum("_cost").alias("c")).collect())
        start, at = before, None
        for span, c in sums:
            if start + c > budget:
                at = span
                break
            start += c
        whole = spanned if at is None else spanned.filter(F.col("_span") < at)
        if sums and (at is None or at > sums[0][0]):
            taken.append((whole, before, by))
        if at is None:
            left = None
            break
        left, before = spanned.filter(F.col("_span") == at).drop("_span"), start
    keys = [F.col(order), F.col(tie), F.col("_hash")]
    out = []
    for part, start, by in taken:
        # a window a block, and what came before it from the sums, at most SPANS * SPANS rows
        blocks = _blocks(part, by, tie if by == order else "_hash", light)
        inner = Window.partitionBy("_span", "_sub").orderBy(*keys)
        totals = blocks.groupBy("_span", "_sub").agg(F.sum("_cost").alias("_c"))
        ahead = totals.select("_span", "_sub", (F.coalesce(F.sum("_c").over(Window.orderBy("_span", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(start)).alias("_ahead"))
        out.append(blocks.withColumn("_run", F.sum("_cost").over(inner)).join(F.broadcast(ahead), ["_span", "_sub"]).withColumn("running", F.col("_run") + F.col("_ahead")))
    if left is not None:
        small = left.withColumn("running", F.sum("_cost").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before))
        out.append(small.filter(F.col("running") <= budget))
    picked = [p.select(*(F.col(f"`{c}`") for c in columns), F.col("running").cast("long")) for p in out]
    found = picked[0]
    for p in picked[1:]:
        found = found.unionByName(p)
    return found
