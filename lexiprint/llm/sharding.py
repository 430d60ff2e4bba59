"""Contiguous shards of least maximal size over ordered atomic groups.

Rows of a group are never parted.  Groups stand in the order of a long key; a
binary search finds the smallest capacity with which a greedy fill needs no
more than the wanted shards, and the cuts fall where that fill cuts.

The driver never sees the groups.  It holds sums over intervals of the key and
bounds each greedy cut from below and above; only intervals in which a cut can
still fall are summed again in finer intervals, until the cuts are exact.
DataFrame operations only.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import LIGHT, cut

SHARDS = 24
#: Bits by which the first sums split the key's range, and by which an interval is split again.
FIRST, FINER = 12, 6
#: Blocks by which positions in a shard are counted.
BLOCKS = 4096


class Cell(NamedTuple):
    """An interval of 2**shift keys from ``low`` on, its size, and whether it is one group (then ``low`` is its key)."""

    low: int
    shift: int
    size: int
    single: bool


def _sums(groups: DataFrame, shift: int, wanted: list[int] | None = None, coarser: int = 0) -> list[Cell]:
    """Sums over the non-empty intervals of 2**shift keys.

    With ``wanted`` only of intervals inside those intervals of 2**coarser
    keys: at most ``len(wanted) * 2**(coarser - shift)`` rows come back.
    """
    if wanted is not None:
        spark = groups.sparkSession
        inside = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "prefix long"))
        groups = groups.join(inside, F.shiftright("key", coarser) == F.col("prefix"), "left_semi")
    sums = groups.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    return sorted(Cell(r["least"] if r["n"] == 1 else r["prefix"] << shift, shift, int(r["size"]), r["n"] == 1) for r in sums.collect())


def _bounds(cells: list[Cell]) -> tuple[list[int], list[bool]]:
    return [0, *accumulate(c.size for c in cells)], [c.single for c in cells]


def _fill(ends: list[int], single: list[bool], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Lower and upper bounds of what the first 1, 2, ... shards hold when filled greedily."""
    total, low, high, lows, highs = ends[-1], 0, 0, [], []
    for _ in range(shards):
        low = ends[bisect_right(ends, low + capacity) - 1]
        reach = high + capacity
        at = bisect_right(ends, reach) - 1
        high = total if reach >= total else ends[at] if single[at] else reach
        lows.append(low)
        highs.append(high)
    return lows, highs


def _search(ends: list[int], single: list[bool], shards: int, least: int) -> tuple[int, int]:
    """Largest capacity surely too small (or ``least`` - 1) and smallest surely enough."""
    total = ends[-1]

    def first(ok, lo: int, hi: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
        return lo

    enough = first(lambda c: _fill(ends, single, c, shards)[0][-1] >= total, least, max(least, total))
    maybe = first(lambda c: _fill(ends, single, c, shards)[1][-1] >= total, least, enough)
    return maybe - 1, enough


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, first: int = FIRST, finer: int = FINER) -> tuple[int, list[int]]:
    """The least capacity and the keys at which shards 1, 2, ... begin (fewer if fewer shards are filled).

    ``groups`` has one row per group: ``key`` (long, not null) and ``size``
    (long, positive).  A group larger than the mean size sets the capacity.
    """
    lo, hi, most, total = groups.agg(F.min("key"), F.max("key"), F.max("size"), F.sum("size")).first()
    if lo is None:
        return 0, []
    least = max(int(most), -(-int(total) // shards))
    cells = _sums(groups, max(0, (int(hi) - int(lo)).bit_length() - first))
    while True:
        ends, single = _bounds(cells)
        below, enough = _search(ends, single, shards, least)
        windows = []
        for c in {max(below + 1, least), enough}:
            windows.append(_fill(ends, single, c, shards))
        lows = [min(w[0][i] for w in windows) for i in range(shards)]
        highs = [max(w[1][i] for w in windows) for i in range(shards)]
        open_cells = set()
        for a, b in zip(lows, highs):
            at = bisect_right(ends, a) - 1
            while at < len(cells) and ends[at] <= b:
                if not single[at]:
                    open_cells.add(at)
                at += 1
        if not open_cells:
            break
        again: dict[int, list[int]] = {}
        for i in open_cells:
            again.setdefault(cells[i].shift, []).append(cells[i].low >> cells[i].shift)
        fine = [c for shift, wanted in again.items() for c in _sums(groups, max(0, shift - finer), wanted, shift)]
        cells = sorted([c for i, c in enumerate(cells) if i not in open_cells] + fine)
    lows, _ = _fill(ends, single, enough, shards)
    cuts = [cells[ends.index(x)].low for x in lows if x < ends[-1]]
    return enough, cuts


def even_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[int]]:
    """As ``minimax_cuts``, and the same again for the groups on either side of one that sets the capacity alone."""
    capacity, cuts = minimax_cuts(groups, shards)
    most, key, total = groups.agg(F.max("size"), F.max_by("key", "size"), F.sum("size")).first()
    if capacity != most or shards < 3:
        return capacity, cuts
    # a group above the mean size takes a shard of its own on its side as well
    own = F.col("size") * shards > int(total)
    sides = [groups.filter(F.col("key") < key), groups.filter(F.col("key") > key)]
    (left, left_own, _), (right, right_own, after) = (s.agg(F.coalesce(F.sum(F.when(~own, F.col("size"))), F.lit(0)), F.count(F.when(own, 1)), F.min("key")).first() for s in sides)
    is_left, is_right, rest = bool(left or left_own), after is not None, shards - 1
    if not is_left and not is_right:
        return capacity, cuts
    first = left_own + round((rest - left_own - right_own) * left / max(1, left + right))
    first = min(max(first, int(is_left)), rest - int(is_right))
    found = [even_cuts(s, n) if n else (0, []) for s, n in zip(sides, (first, rest - first))]
    if max(c for c, _ in found) > capacity:
        return capacity, cuts
    return capacity, [*found[0][1], *([key] if is_left else []), *([after] if is_right else []), *found[1][1]]


def assign_shards(rows: DataFrame, group_cols: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` (``doc_id, size`` and the group columns) with ``shard`` and a gapless ``slot``.

    Groups are the rows that agree on ``group_cols``; their order is the order
    of a 64-bit hash of these, so a row knows its place without a join and a
    group of any number of rows costs one partial sum per task.  Groups whose
    hashes agree stay together as well.  Positions in a shard are counted by
    blocks of identifiers; a block with more rows than a task should hold, as
    one of a null or often repeated identifier, is dealt to several by the
    places of its rows.
    """
    keyed = cut(rows.withColumns({"key": F.xxhash64(*group_cols), "place": F.monotonically_increasing_id()}))
    groups = cut(keyed.groupBy("key").agg(F.sum("size").cast("long").alias("size")))
    _, cuts = even_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    placed = keyed.withColumns({"shard": shard, "block": F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(BLOCKS)).cast("int")})
    keys = ["shard", "block", "part"]
    # at most shards * BLOCKS rows
    full = cut(placed.groupBy("shard", "block").agg(F.ceil(F.count(F.lit(1)) / LIGHT).alias("parts")).filter("parts > 1"))
    if full.count():
        placed = placed.join(F.broadcast(full), ["shard", "block"], "left").withColumn("part", F.coalesce(F.pmod("place", "parts"), F.lit(0)).cast("int")).drop("parts")
    else:
        placed = placed.withColumn("part", F.lit(0))
    counted = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # a row more for every LIGHT rows of full blocks
    before = counted.selectExpr(*keys, "sum(n) over (partition by shard order by block, part) - n as before")
    slot = F.expr("row_number() over (partition by shard, block, part order by doc_id, text_crc32, size, place)")
    return placed.withColumn("at", slot).join(F.broadcast(before), keys).withColumn("slot", F.col("before") + F.col("at") - 1)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents in shards of near equal bytes; equal texts share a shard.

    A null text counts as empty.  A null doc_id is a row like any other, and
    repeated rows have a slot each.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    placed = assign_shards(rows, ["text_hash", "text_crc32", "size"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
