"""Runs of repeated words: all maximal periodic stretches of a text.

A run is a stretch of consecutive words that has a smallest period q, is at
least ``exponent`` periods long and cannot be extended to either side.  They
are found as Kolpakov and Kucherov do: the text is parsed into the longest
factors that occur earlier (Lempel and Ziv), read off a suffix automaton; a run
that is the leftmost of its kind crosses or touches the border of a factor and
is found there from longest common extensions to both sides (Main); any other
lies strictly inside a factor and is copied from the factor's earlier
occurrence.  A text is one row, so it is worked on by itself; no exchange.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import beside, with_texts

#: A run has at least so many periods, and so many words.
EXPONENT, LEAST = 4, 6
#: From so many words in two neighbouring factors on, extensions are worked out together and not period by period.
LONG = 48


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Factor(NamedTuple):
    """Words ``start`` to ``start + length``, which occur ``back`` words earlier too; 0 for a word that is new."""

    start: int
    length: int
    back: int


class SuffixAutomaton:
    """Every stretch of ``words`` (numbers) leads from state 0 to a state that knows where the stretch ends first.

    Most states have one way on, so the first way of a state is kept in
    arrays and only further ones in a dictionary.
    """

    def __init__(self, words: list[int]) -> None:
        n = len(words)
        root: dict[int, int] = {}
        link, length, ends = array("q", [-1]), array("q", [0]), array("q", [-1])
        word, to, more = array("q", [-1]), array("q", [0]), {0: root}
        last = 0
        for at in range(n):
            w = words[at]
            new = len(link)
            link.append(0)
            length.append(at + 1)
            ends.append(at)
            word.append(-1)
            to.append(0)
            p, last = last, new
            while p > 0 and word[p] != w:
                if word[p] < 0:
                    word[p], to[p] = w, new
                elif (ways := more.get(p)) is None:
                    more[p] = {w: new}
                elif w in ways:
                    break
                else:
                    ways[w] = new
                p = link[p]
            if p > 0:
                q = to[p] if word[p] == w else more[p][w]
            else:
                q = root.get(w)
                if q is None:
                    root[w] = new
                    continue
            if length[q] == length[p] + 1:
                link[new] = q
                continue
            copy = len(link)
            link.append(link[q])
            length.append(length[p] + 1)
            ends.append(ends[q])
            word.append(word[q])
            to.append(to[q])
            if q in more:
                more[copy] = more[q].copy()
            while p > 0:
                if word[p] == w:
                    if to[p] != q:
                        break
                    to[p] = copy
                elif (ways := more.get(p)) is not None and ways.get(w) == q:
                    ways[w] = copy
                else:
                    break
                p = link[p]
            if p == 0 and root.get(w) == q:
                root[w] = copy
            link[q] = link[new] = copy
        self.ends, self.word, self.to, self.more = ends, word, to, more

    def factors(self, words: list[int]) -> list[Factor]:
        """Each factor is the longest stretch that also starts earlier (it may overlap itself), or one new word."""
        ends, word, to, more = self.ends, self.word, self.to, self.more
        root, none = more[0], {}
        out, at, n = [], 0, len(words)
        while at < n:
            state, size = root[words[at]], 1
            if ends[state] >= at:
                out.append(Factor(at, 1, 0))
                at += 1
                continue
            while at + size < n:
                w = words[at + size]
                after = to[state] if word[state] == w else more.get(state, none).get(w, 0)
                if not after or ends[after] - size >= at:
                    break
                state = after
                size += 1
            out.append(Factor(at, size, at - (ends[state] - size + 1)))
            at += size
        return out


def common_prefixes(pattern: list[int], text: list[int]) -> list[int]:
    """How far ``text`` from each place on agrees with the beginning of ``pattern``."""
    both = [*pattern, -1, *text]
    n = len(both)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and both[k] == both[i + k] and both[k] >= 0:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out[len(pattern) + 1 :]


def _at_border(words: list[int], low: int, b: int, high: int, exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Runs that cross or touch ``b``, the border of the factors [low, b) and [b, high).

    Only periods below (high - low) / (exponent - 1) come into question, as a
    run's second period cannot begin before the left factor unless the left
    factor reached further.
    """
    n = len(words)
    periods = range(1, (high - low - 1) // (exponent - 1) + 1)
    if high - low < LONG:
        for p in periods:
            # a period to the left of the border, then one to the right of it
            for i in (b - p, b):
                if i < 0 or i + p > n:
                    continue
                e = i
                while e + p < n and words[e] == words[e + p]:
                    e += 1
                s = i
                if e - s < (exponent - 1) * p and not (s and words[s - 1] == words[s - 1 + p]):
                    continue
                while s and words[s - 1] == words[s - 1 + p]:
                    s -= 1
                if e - s >= (exponent - 1) * p:
                    key = (s, e + p)
                    found[key] = min(p, found.get(key, p))
        return
    most = len(periods)
    # so far the extensions are to be known; one that reaches the end of it goes on word by word
    reach = exponent * most
    left, right = words[max(0, b - most - reach) : b], words[b : b + most + reach]
    ahead = common_prefixes(right, [*left[len(left) - min(len(left), most) :], *right])
    behind = common_prefixes(left[::-1], [*right[:most][::-1], *left[::-1]])
    before, after = min(len(left), most), min(len(right), most)
    for p in periods:
        for i, lp, ls in ((b - p, ahead[before - p] if p <= before else None, behind[after + p] if after + p < len(behind) else 0), (b, ahead[before + p] if before + p < len(ahead) else 0, behind[after - p] if p <= after else None)):
            if lp is None or ls is None or lp + ls < (exponent - 1) * p:
                continue
            s, e = i - ls, i + lp
            while s and words[s - 1] == words[s - 1 + p]:
                s -= 1
            while e + p < n and words[e] == words[e + p]:
                e += 1
            key = (s, e + p)
            found[key] = min(p, found.get(key, p))


def find_runs(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """All runs of ``words``, numbers from 0 on, by start and period.  ``exponent`` is a whole number from 2 on."""
    if len(words) < max(least, exponent):
        return []
    ends: dict[int, dict[int, int]] = {}
    starts: list[int] = []

    def keep(s: int, e: int, q: int) -> None:
        if s not in ends:
            ends[s] = {}
            insort(starts, s)
        ends[s][e] = min(q, ends[s].get(e, q))

    low = 0
    factors = SuffixAutomaton(words).factors(words)
    for b, size, back in [*factors, Factor(len(words), 0, 0)]:
        high = b + size
        if high - low >= exponent:
            found: dict[tuple[int, int], int] = {}
            _at_border(words, low, b, high, exponent, found)
            for (s, e), q in found.items():
                keep(s, e, q)
        if back and starts:
            at = bisect_right(starts, b - back)
            while at < len(starts) and starts[at] < high - back:
                s = starts[at]
                for e, q in list(ends[s].items()):
                    if e < high - back:
                        keep(s + back, e + back, q)
                at += 1
        low = b
    return sorted(Run(s, e - s, q) for s in starts for e, q in ends[s].items() if e - s >= least)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for a, b in sorted((r.start + r.period, r.start + r.length) for r in runs):
        if b > at:
            out += words[at : max(at, a)]
            at = b
    return out + words[at:]


def numbered(words: list[bytes]) -> list[int]:
    """The same number for equal words, from 0 on."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each whole text, and the text without their repetitions.

    Words stand between white space of ASCII; ``start`` is a word's number
    from 0.  Runs are sorted by start, then period; ``collapsed`` joins the kept
    words by one space.  Null and empty texts have no words, no runs and the
    collapsed text ''.  Every row gives a row, repeated or without identifier.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, kept = [], [], []
            for text in b.column("text").to_pylist():
                words = (text or b"").split()
                runs = find_runs(numbered(words), exponent, least)
                sizes.append(len(words))
                found.append([r._asdict() for r in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield beside(b, ["doc_id"], n_words=pa.array(sizes, pa.int64()), runs=pa.array(found, kind), collapsed=pa.array(kept, pa.binary()))

    rows = with_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def stretched(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with periods put into a tenth of the texts, by the checksum of the identifier.

    With h the checksum, g = h / 10, n words, a = g % n and p = 1 + (n - a) / (3 + g % 8)
    (whole divisions), the words from a on repeat the first p of them if h % 10 is 0.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = ids.withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    chosen = F.col("h") % 10 == 0
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    split = keyed.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", F.col("n"))).cast("int"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    # at most 11 copies of the p words
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast((n - a) div p + 1 as int)")))
    periodic = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return placed.select("doc_id", F.when(chosen & (F.col("n") > 0), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """Digests of the runs of the ``stretched`` documents, and the run of greatest exact length / period."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # runs come by start and period, so only a greater one takes the place of one before it
    longest = F.aggregate("runs", none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    found = periodic_runs(stretched(docs)).withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
