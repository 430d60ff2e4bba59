"""Collocations: phrases whose words stand together more often than their frequencies tell.

Texts are cut at punctuation into pieces.  Equal pieces are dealt to the same
block of bounded bytes and become one piece with a multiplicity, so a passage that stands
everywhere is counted once.  A block counts its n-grams by multiplicity, as places in its sorted vocabulary, and sends
them, packed, to buckets by hash; in a bucket duckdb sums them, on disk where they do not fit
its memory, and answers each block which of its n-grams are frequent.  Frequent
words come first, then pairs of such words, then longer phrases all whose pairs
are frequent: no other phrase can be frequent, so nothing is lost and what
travels stays small.  For the scores each phrase asks for the frequencies of
both its parts at every cut by a shuffled lookup; parts of a frequent phrase are
frequent, so each is found.  Only the frequent phrases reach plain rows.
"""

from __future__ import annotations

import json
import math
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiprint.llm.common import attach_any, cut, with_texts

#: Occurrences that make a phrase a candidate, its words at most, and phrases reported of each language.
LEAST, WORDS, TOP = 100, 5, 2000
#: Parts of a language's phrases that are ranked on their own first.
PARTS = 64
#: Bytes of text in a block, and blocks whose n-grams a bucket sums.
BLOCK, SHARED = 8 << 20, 2
#: Memory of duckdb in a bucket; the rest is on the worker's own scratch disk, as Spark's sorts are, and goes with the task.
MEMORY = "256MB"
#: Bytes of text whose pieces a task holds to count repetitions before it sends them.
HELD_BYTES = 16 << 20
#: Stands for "all words" among the n-grams of a language; no n-gram is empty.
ALL = b""
UNKNOWN = "und"
#: A to Z in lower case, what ends a piece as a line's end, and tabs as spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

#: An odd number that spreads hashes.
_MIX = np.uint64(0x9E3779B97F4A7C15)

_SENT = "block long, bucket long, body binary"
_ANSWER = "block long, body binary"
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])


def split_pieces(text: bytes | None) -> Iterator[bytes]:
    """The pieces of a text that hold words, one space between words."""
    for part in (text or b"").translate(_PLAIN).split(b"\n"):
        words = part.split(b" ")
        piece = b" ".join(filter(None, words))
        if piece:
            yield piece


def _body(rows: pa.Table) -> bytes:
    """``lang, gram, n`` rows, sorted by language, as compressed bytes: languages with their rows, lengths, numbers, all grams."""
    langs, gram = rows["lang"].combine_chunks().dictionary_encode(), rows["gram"].combine_chunks()
    ends = np.frombuffer(gram.buffers()[1], "<i4", len(gram) + 1, 4 * gram.offset)
    head = json.dumps(list(zip(langs.dictionary.to_pylist(), np.bincount(langs.indices.to_numpy()).tolist()))).encode()
    numbers = [np.array([len(head), len(gram)], "<i8").tobytes(), head, np.diff(ends).astype("<u4").tobytes(), rows["n"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    raw = b"".join([*numbers, memoryview(gram.buffers()[2] or b"")[ends[0] : ends[-1]]])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _read(body: bytes) -> pa.Table:
    """The rows given to ``_body``."""
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)
    head, n = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16 + head
    langs = json.loads(raw[16:at])
    ends = np.append(0, np.cumsum(np.frombuffer(raw, "<u4", n, at))).astype("<i4")
    counts = np.frombuffer(raw, np.uint8, 8 * n, at + 4 * n).reshape(8, n).T.copy().view("<i8").ravel()
    gram = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[at + 12 * n :])])
    lang = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(langs), dtype=np.int32), [k for _, k in langs]), pa.array([x for x, _ in langs], pa.string()))
    return pa.table([lang.cast(pa.string()), gram, pa.array(counts)], schema=_GRAMS)


def _dealt(part: np.ndarray, rows: pa.Table, parts: int) -> tuple[list[int], list[bytes]]:
    """``lang, gram, n`` rows by their parts: parts, and the body of each; within a part rows keep their order, which has each language together."""
    small = part.astype(np.uint16) if parts <= 1 << 16 else part
    order = np.argsort(small, kind="stable")
    rows, part = rows.take(pa.array(order)).combine_chunks(), part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    return part[starts].tolist(), [_body(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(part)])]


def _parted(counts: dict[str, Counter[bytes]], parts: int) -> tuple[list[int], list[bytes]]:
    """The pieces by hash: parts, and what falls in each."""
    found, part = {k: [] for k in _GRAMS.names}, []
    for lang, c in sorted(counts.items()):
        seed = zlib.crc32(lang.encode("utf-8", "replace"))
        ordered = sorted(c)
        part += [zlib.crc32(g, seed) % parts for g in ordered]
        found["lang"] += [lang] * len(c)
        found["gram"] += ordered
        found["n"] += [c[g] for g in ordered]
    return _dealt(np.array(part, np.int64), pa.table(found, schema=_GRAMS), parts)


def _pieces(blocks: int):
    """Pieces with their multiplicities in a part of the task's texts, packed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(split_pieces(text))
                size += len(text or b"")
                if size > HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_parted(seen, blocks), (pa.int64(), pa.binary()))], names=["block", "body"])
                    seen, size = {}, 0
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_parted(seen, blocks), (pa.int64(), pa.binary()))], names=["block", "body"])

    return run


class _Words:
    """The words of a block's distinct pieces in one language, as places in the sorted vocabulary."""

    def __init__(self, lang: str, pieces: pa.Array, times: np.ndarray):
        split = pc.split_pattern(pieces, b" ")
        encoded = pc.list_flatten(split).dictionary_encode()
        order = pc.sort_indices(encoded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        sizes = pc.list_value_length(split).to_numpy()
        self.lang, self.vocabulary, self.ids = lang, encoded.dictionary.take(order), rank[encoded.indices.to_numpy()]
        self.times = np.repeat(times, sizes)
        #: whether the next word is of the same piece
        self.goes_on = np.ones(len(self.ids), bool)
        self.goes_on[np.cumsum(sizes) - 1] = False
        seed = zlib.crc32(lang.encode("utf-8", "replace"))
        self.seed, self.hashes = np.uint64(seed), np.array([zlib.crc32(w, seed) for w in self.vocabulary.to_pylist()], np.uint64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of the ``words`` in the vocabulary, -1 where it lacks one."""
        return pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype(np.int64)

    def counted(self, code: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """The n-grams of ``size`` words that begin ``at``, told apart by ``code``: the rank of each, hashes and rows of the distinct ones."""
        _, first, rank = np.unique(code, return_index=True, return_inverse=True)
        n = np.zeros(len(first), np.int64)
        np.add.at(n, rank, self.times[at])
        words = [self.ids[at[first] + k] for k in range(size)]
        h = self.hashes[words[0]]
        for w in words[1:]:
            h = (h ^ (h >> np.uint64(29))) * _MIX + self.hashes[w]
        gram = pc.binary_join_element_wise(*(self.vocabulary.take(pa.array(w)) for w in words), b" ") if size > 1 else self.vocabulary.take(pa.array(words[0]))
        return rank, h, self.rows(gram, n)

    def rows(self, gram: pa.Array, n: np.ndarray) -> pa.Table:
        return pa.table([pa.array([self.lang]).take(pa.array(np.zeros(len(n), np.int64))), gram, pa.array(n)], schema=_GRAMS)


def _languages(bodies: list[bytes]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of ``bodies`` by language, equal n-grams or pieces once with the sum of their numbers."""
    if not bodies:
        return
    t = pa.concat_tables(map(_read, bodies)).group_by(["lang", "gram"], use_threads=False).aggregate([("n", "sum")]).rename_columns(_GRAMS.names).combine_chunks()
    langs = t["lang"].combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy()
    order, ends = np.argsort(code, kind="stable"), np.cumsum(np.bincount(code)).tolist()
    for lang, a, b in sorted(zip(langs.dictionary.to_pylist(), [0, *ends], ends)):
        yield lang, t.take(pa.array(order[a:b])).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    return t[name].combine_chunks() if t[name].num_chunks else pa.array([], t.schema.field(name).type)


def _by_language(texts: pa.Table) -> Iterator[_Words]:
    for lang, t in _languages(texts.column("body").to_pylist()):
        yield _Words(lang, _column(t, "gram"), t["n"].to_numpy())


def _packed(block: int, found: list[tuple[np.ndarray, pa.Table]], buckets: int) -> pa.Table:
    """A row for each bucket that the block's n-grams (hashes and rows, each language together) fall in."""
    ids, bodies = [], []
    if found:
        h = np.concatenate([h for h, _ in found])
        part = (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(24)) % np.uint64(buckets)
        ids, bodies = _dealt(part.astype(np.int64), pa.concat_tables([t for _, t in found]), buckets)
    return pa.table({"block": pa.array([block] * len(ids), pa.int64()), "bucket": pa.array(ids, pa.int64()), "body": pa.array(bodies, pa.binary())})


def _words(buckets: int):
    """Words of a block, and how many there are in all."""

    def run(texts: pa.Table) -> pa.Table:
        found = []
        for w in _by_language(texts):
            _, h, rows = w.counted(w.ids, np.arange(len(w.ids)), 1)
            found += [(np.array([w.seed]), w.rows(pa.array([ALL], pa.binary()), np.array([w.times.sum()]))), (h, rows)]
        return _packed(texts.column("block")[0].as_py(), found, buckets)

    return run


def _phrases(buckets: int, longest: int, pairs: bool):
    """Pairs of frequent words, or phrases of three words and more all whose pairs are frequent, in a block."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _packed(-1, [], buckets)
        frequent = {lang: _column(t, "gram") for lang, t in _languages(answers.column("body").to_pylist())}
        found = []
        for w in _by_language(texts):
            if w.lang not in frequent:
                continue
            many = len(w.vocabulary)
            if pairs:
                known = np.zeros(many, bool)
                places = w.places(frequent[w.lang])
                known[places[places >= 0]] = True
                at = np.flatnonzero(w.goes_on[:-1] & known[w.ids[:-1]] & known[w.ids[1:]])
                found.append(w.counted(w.ids[at] * many + w.ids[at + 1], at, 2)[1:])
                continue
            halves = w.places(pc.list_flatten(pc.split_pattern(frequent[w.lang], b" "))).reshape(-1, 2)
            known = halves[(halves >= 0).all(1)] @ np.array([many, 1])
            at = np.flatnonzero(w.goes_on[:-1])
            code = w.ids[at] * many + w.ids[at + 1]
            inside = np.isin(code, known)
            at, rank = at[inside], np.unique(code[inside], return_inverse=True)[1]
            pair = np.zeros(len(w.ids) + longest, bool)
            pair[at] = True
            for size in range(3, longest + 1):
                further = pair[at + size - 2]
                at = at[further]
                rank, h, rows = w.counted(rank[further] * many + w.ids[at + size - 1], at, size)
                found.append((h, rows))
        return _packed(texts.column("block")[0].as_py(), found, buckets)

    return run


def _sums(least: int):
    """The frequent n-grams of a bucket for each block that sent them, and all of them once for the block -1 that is none."""

    def sent(requests: pa.Table) -> Iterator[pa.RecordBatch]:
        for block, body in zip(requests["block"].to_pylist(), requests["body"].to_pylist()):
            for b in _read(body).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([block] * b.num_rows, pa.int64()), *b.columns], names=["block", *_GRAMS.names])

    def run(requests: pa.Table) -> pa.Table:
        blocks, bodies = [], []
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch}) as db:
            reader = pa.RecordBatchReader.from_batches(pa.schema([("block", pa.int64()), *_GRAMS]), sent(requests))
            db.register("reader", reader)
            db.execute("create table sent as select * from reader")
            db.execute("create table sums as select lang, gram, sum(n)::bigint as n from sent group by lang, gram having sum(n) >= ? or octet_length(gram) = 0", [least])
            answer = db.sql("select block, lang, gram, sums.n from sent join sums using (lang, gram) union all select -1, lang, gram, n from sums order by block, lang, gram").to_arrow_table()
        ends = pa.compute.run_end_encode(answer["block"].combine_chunks()) if len(answer) else None
        start = 0
        for block, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()) if ends else ():
            blocks.append(block)
            bodies.append(_body(answer.slice(start, end - start).select(_GRAMS.names).cast(_GRAMS)))
            start = end
        return pa.table({"block": pa.array(blocks, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return run


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column("body").to_pylist():
            yield from _read(body).to_batches()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = WORDS, block: int = BLOCK) -> DataFrame:
    """``lang, gram, n``: words and phrases of up to ``longest`` words with at least ``least`` occurrences, and '' with all words of the language.

    Words are counted whole, overlaps included, in every piece of every text.
    A null ``lang`` is ``und``; null and empty texts hold no words.
    """
    rows = with_texts(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block) or 1
    buckets = math.ceil(blocks / SHARED)
    # all three rounds read this exchange
    dealt = rows.mapInArrow(_pieces(blocks), "block long, body binary").repartition(blocks, "block")

    def summed(sent: DataFrame) -> DataFrame:
        return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sums(least), _ANSWER)

    def told(answers: DataFrame):
        return answers.filter("block >= 0").repartition(blocks, "block").groupBy("block")

    found = [summed(dealt.groupBy("block").applyInArrow(_words(buckets), _SENT))]
    if longest > 1:
        found.append(summed(dealt.groupBy("block").cogroup(told(found[0])).applyInArrow(_phrases(buckets, longest, True), _SENT)))
    if longest > 2:
        found.append(summed(dealt.groupBy("block").cogroup(told(found[1])).applyInArrow(_phrases(buckets, longest, False), _SENT)))
    each = reduce(DataFrame.union, [f.filter("block < 0") for f in found])
    return each.mapInArrow(_rows, "lang string, gram binary, n long").select("lang", F.col("gram").cast("string").alias("gram"), "n")


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of the phrases in ``frequent_phrases``, by their weakest cut, least k first.

    ``score`` is floor(1000 * a * n / (l * r)) in whole numbers of up to 38 digits.
    """
    key = F.concat_ws("\t", "lang", "gram").alias("key")
    known = phrases.select(key, F.col("n").alias("f"))
    whole = phrases.filter("gram = ''").select("lang", F.col("n").alias("all"))
    words = F.split("gram", " ")
    asked = phrases.filter("gram like '% %'").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), words.alias("w"))
    cuts = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    part = lambda start, length: F.concat_ws("\t", "lang", F.array_join(F.slice("w", start, length), " "))
    halves = cuts.select("lang", "phrase", "a", F.size("w").alias("words"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = attach_any(cut(halves), known.withColumnsRenamed({"key": "first", "f": "l"}), "first").drop("first")
    both = attach_any(cut(left), known.withColumnsRenamed({"key": "rest", "f": "r"}), "rest").drop("rest")
    told = attach_any(cut(both), whole.withColumnRenamed("all", "n"), "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    score = told.withColumn("top", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n")).withColumn("under", big("l") * big("r")).withColumn("score", F.expr("top div under"))
    least = score.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("x"))
    return least.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.n", "x.score")


def uncovered(phrases: DataFrame) -> DataFrame:
    """``phrases`` (``lang, phrase, a``) but those that stand inside a longer one with as many occurrences."""
    w = F.split("phrase", " ")
    size = F.size("w")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    covers = phrases.select("lang", F.col("a").alias("_of"), w.alias("w")).filter(size > 2).select("lang", "_of", F.explode(F.array_distinct(inner)).alias("phrase"))
    most = covers.groupBy("lang", "phrase").agg(F.max("_of").alias("_of"))
    return phrases.join(most, ["lang", "phrase"], "left").filter(F.col("_of").isNull() | (F.col("_of") < F.col("a"))).drop("_of")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = WORDS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by score, then occurrences, then name.

    A phrase has two to ``longest`` words within a piece and ``a`` >= ``least`` occurrences;
    ``l`` and ``r`` are those of its parts at the cut of least score, ``n`` all words of its language.
    A phrase is left out if it stands inside a longer one with as many occurrences.  An empty table gives none.
    """
    phrases = cut(frequent_phrases(docs, least, longest, block))
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # the best of each part of a language first, so one task meets at most PARTS * top phrases of it
    nearly = uncovered(scored(phrases)).withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = nearly.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of ``collocations`` over ``documents``.
SQL = rf"""
with lower_texts as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from lower_texts),
word_lists as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w, count(*) as m from pieces group by lang, w),
sized as (select lang, w, m, unnest(range(1, {WORDS + 1})) as k from word_lists),
grams as (select lang, k, m, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as gram from sized),
f as (select lang, k, gram, sum(m)::bigint as f from grams group by lang, k, gram),
whole as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
candidates as (select lang, k as words, gram as phrase, f as a, string_split(gram, ' ') as w from f where k > 1 and f >= {LEAST}),
cuts as (select *, unnest(range(1, words)) as at_word from candidates),
parts as (select *, array_to_string(w[1:at_word], ' ') as head, array_to_string(w[at_word + 1:], ' ') as rest from cuts),
scores as (
    select parts.lang, phrase, words, a, at_word, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
    from parts join f x on x.lang = parts.lang and x.gram = head join f y on y.lang = parts.lang and y.gram = rest join whole on whole.lang = parts.lang),
weakest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, at_word) = 1),
inner_sizes as (select lang, a, w, words, unnest(range(2, words)) as k from candidates),
inner_phrases as (select lang, a, unnest(list_transform(range(1, words - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from inner_sizes),
kept as (select * from weakest where not exists (from inner_phrases i where i.lang = weakest.lang and i.phrase = weakest.phrase and 100 * i.a >= 100 * weakest.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= {TOP}
"""
