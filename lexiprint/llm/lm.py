"""Log-probabilities of whole texts under a smoothed trigram model learnt from the corpus itself.

The model mixes each order with the one below by a Dirichlet prior: with c the
training counts, P(w | h) = (c(hw) + PRIOR * P(w | h')) / (c(h) + PRIOR), where h'
is h without its first word, down to a smoothed share of the word.  That is a
weighted backoff automaton: contexts that were seen are states, seen n-grams
are arcs with log P(w | h), and a failure arc from h to h' weighs
log(PRIOR / (c(h) + PRIOR)).  A text is scored in one walk from left to right that
carries the state, follows failure arcs where there is no arc for the next
word, and adds up what it passes.

Neither the corpus's n-grams nor the automaton is ever in one place.  Documents
are dealt to blocks of bounded bytes.  A block sends its distinct n-grams and their
training counts, packed, to buckets by hash; a bucket sums them and answers each
block with the sums of what it sent.  From the answers a block builds the part
of the automaton that its documents walk on.  A word, however frequent, is one
entry a block.  Trigrams go in a second round, without those whose count the
first one settles: a trigram of training text with a bigram that was seen once
was seen once, and is sent only if text outside training holds its bigrams too.

n-grams are known by 64-bit hashes; two of n different ones agree with
probability n**2 / 2**65 and then share their count.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprint.llm.common import give_back, with_texts

#: Weight of the lower order: so many counts of a context are as good as the order below.
PRIOR = 2.0
#: Added to each word's count in the base distribution.
BASE = 0.1
#: Bytes of text in a block, and blocks whose n-grams a bucket sums.
BLOCK, SHARED = 8 << 20, 2
#: Bytes of text that a task packs at once.
HELD_BYTES = 16 << 20
SEED = 42
#: Hash of the token that ends a text, which no word has as words hold no space.
END = xxhash.xxh64_intdigest(b" ", SEED)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each n-gram of hash ``a`` followed by the word ``b``."""
    h = a * _TIMES + b
    h = (h ^ (h >> np.uint64(32))) * _TIMES
    h = (h ^ (h >> np.uint64(29))) * _TIMES
    return h ^ (h >> np.uint64(32))


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed; sorted 64-bit ones by their differences."""
    planes = []
    for x in arrays:
        if x.dtype == np.uint64 and len(x):
            x = np.diff(x, prepend=np.uint64(0))
        planes.append(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    raw = b"".join(planes)
    head = np.array([len(arrays), *(v for x in arrays for v in (len(x), x.itemsize))], dtype="<i8").tobytes()
    return head + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpacked(body: bytes) -> list[np.ndarray]:
    """The arrays given to ``packed``."""
    count = int(np.frombuffer(body, "<i8", 1)[0])
    shape = np.frombuffer(body, "<i8", 2 * count, 8).reshape(count, 2).tolist()
    total, out, at = sum(n * size for n, size in shape), [], 0
    raw = pa.decompress(body[8 * (2 * count + 1) :], total, "zstd", asbytes=True) if total else b""
    for n, size in shape:
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        x = np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()
        out.append(np.cumsum(x, dtype=np.uint64) if size == 8 else x)
        at += n * size
    return out


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents packed by block, some megabytes of text at a time."""

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("block")
        block = rows["block"].to_numpy()
        starts = _starts(block).tolist()
        bodies = []
        for a, e in zip(starts, [*starts[1:], len(block)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(a, e - a))
            bodies.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int64()), pa.array(bodies, pa.binary())], names=["block", "body"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > HELD_BYTES:
            yield packs(held)
            held, size = [], 0
    if held:
        yield packs(held)


def _texts(rows: pa.Table) -> pa.Table:
    """The documents of a block."""
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in rows.column("body").to_pylist())


class Block:
    """The documents of a block as one row of hashed tokens, each text closed by its end."""

    def __init__(self, texts: pa.Table) -> None:
        whole = pc.fill_null(texts.column("text").combine_chunks(), "")
        cut = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        coded = cut.flatten().dictionary_encode()
        # blanks at the ends of a text leave empty words
        found = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in found), np.uint64, len(found))
        codes = coded.indices.to_numpy()
        real = codes != found.index(b"") if b"" in found else np.ones(len(codes), dtype=bool)
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        sizes = np.diff(np.append(0, np.cumsum(real))[ends]) + 1
        self.sizes = sizes.tolist()
        self.words = np.full(int(sizes.sum()), END, dtype=np.uint64)
        inside = np.ones(len(self.words), dtype=bool)
        inside[np.cumsum(sizes) - 1] = False
        self.words[inside] = hashes[codes[real]]
        learn = texts.column("learn").to_pylist()
        self.learn = np.repeat(np.array(learn, dtype=bool), self.sizes)
        ends = np.cumsum(self.sizes) - 1
        # places where a bigram and where a trigram begins
        self.two = np.ones(len(self.words), dtype=bool)
        self.two[ends] = False
        self.three = self.two.copy()
        self.three[:-1] &= self.two[1:]
        self.pairs = joined(self.words[:-1], self.words[1:]) if len(self.words) > 1 else self.words[:0]
        self.at_two = np.nonzero(self.two)[0]
        self.grams2 = self.pairs[self.at_two]

    def grams3(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the trigrams that begin at the given places."""
        return joined(self.pairs[at], self.words[at + 2])


def _counted(grams: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``grams``, sorted, and twice the count in training text plus one if other text holds them."""
    order = np.argsort(grams)
    ranked, inside = grams[order], learn[order].astype(np.uint32)
    starts = _starts(ranked)
    if not len(starts):
        return ranked, inside
    n = np.add.reduceat(inside, starts)
    return ranked[starts], 2 * n + (np.diff(np.append(starts, len(ranked))) > n).astype(np.uint32)


def _starts(ranked: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.nonzero(np.append(True, ranked[1:] != ranked[:-1]))[0] if len(ranked) else np.array([], dtype=np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _sent(block: int, sides: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """A row for each bucket that the block's distinct n-grams fall in, the sides packed behind each other."""
    edges = [np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist() for h, _ in sides]
    full = [k for k in range(buckets) if any(e[k] < e[k + 1] for e in edges)]
    bodies = [packed(*(x[e[k] : e[k + 1]] for (h, marks), e in zip(sides, edges) for x in (h, marks))) for k in full]
    return pa.table({"block": pa.array([block] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "body": pa.array(bodies, pa.binary())})


_REQUEST = "block long, bucket long, body binary"
_ANSWER = "block long, bucket long, turn int, distinct long, total long, body binary"


def _first(buckets: int):
    """Words and bigrams of a block."""

    def run(texts: pa.Table) -> pa.Table:
        b = Block(_texts(texts))
        return _sent(texts.column("block")[0].as_py(), [_counted(b.words, b.learn), _counted(b.grams2, b.learn[b.at_two])], buckets)

    return run


def _answers(turn: int):
    """The sums of all blocks' marks, a row for each request, and a row for a block -1 that is none, with the bucket's distinct training words and their total."""

    def run(requests: pa.Table) -> pa.Table:
        bodies = [unpacked(x) for x in requests.column("body").to_pylist()]
        replies: list[list[np.ndarray]] = [[] for _ in bodies]
        distinct = total = 0
        for side in range(0, len(bodies[0]), 2):
            hashes, marks = (np.concatenate([x[side + k] for x in bodies]) for k in (0, 1))
            order = np.argsort(hashes)
            ranked = hashes[order]
            starts = _starts(ranked)
            sums = np.zeros(len(starts), dtype=np.uint64)
            if len(starts):
                m = marks[order].astype(np.uint64)
                sums = np.add.reduceat(m & ~np.uint64(1), starts) + np.maximum.reduceat(m & np.uint64(1), starts)
            if side == 0:
                distinct, total = int((sums >= 2).sum()), int((sums >> np.uint64(1)).sum())
            each = np.empty(len(hashes), dtype=np.uint64)
            each[order] = np.repeat(sums, np.diff(np.append(starts, len(hashes))))
            # four bytes hold nearly all sums; a bucket with greater ones sends them in two halves
            at = 0
            for reply, x in zip(replies, bodies):
                part = each[at : at + len(x[side])]
                reply += [part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32) if len(part) and part.max() >> np.uint64(32) else np.zeros(0, np.uint32)]
                at += len(x[side])
        n, bucket = len(bodies), requests.column("bucket")[0].as_py()
        return pa.table({
            "block": pa.array([*requests.column("block").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int64()), "turn": pa.array([turn] * (n + 1), pa.int32()),
            "distinct": pa.array([0] * n + [distinct], pa.int64()), "total": pa.array([0] * n + [total], pa.int64()), "body": pa.array([*(packed(*r) for r in replies), None], pa.binary()),
        })

    return run


def _sums(answers: pa.Table, turn: int) -> list[np.ndarray]:
    """The answers of one turn by side, in the order of the block's sorted n-grams."""
    rows = sorted((bucket, body) for bucket, t, body in zip(*(answers.column(c).to_pylist() for c in ("bucket", "turn", "body"))) if t == turn)
    parts = [unpacked(body) for _, body in rows]
    out = []
    for side in range(0, len(parts[0]) if parts else 0, 2):
        both = [x[side].astype(np.int64) + (x[side + 1].astype(np.int64) << 32 if len(x[side + 1]) else 0) for x in parts]
        out.append(np.concatenate(both))
    return out


def _settled(b: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place the word's count, the bigram's number among the distinct ones and its count, and the places of trigrams to ask for and of those seen once."""
    ones, twos = _sums(answers, 1)
    _, word = np.unique(b.words, return_inverse=True)
    c1 = (ones >> 1)[word]
    pair = np.full(len(b.words), -1, dtype=np.int64)
    mark = np.zeros(len(b.words), dtype=np.int64)
    if len(b.grams2):
        _, which = np.unique(b.grams2, return_inverse=True)
        pair[b.at_two] = which
        mark[b.at_two] = twos[which]
    at = np.nonzero(b.three)[0]
    low = np.minimum(mark[at], mark[at + 1]) >> 1
    asked = (low > 1) | ((low == 1) & (mark[at] & mark[at + 1] & 1 == 1))
    return word, c1, pair, mark >> 1, (at[asked], at[~asked & (low == 1)])


def _second(buckets: int):
    """Trigrams of a block whose counts the first answers leave open."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return _sent(-1, [], buckets)
        b = Block(_texts(texts))
        at, _ = _settled(b, answers)[4]
        return _sent(texts.column("block")[0].as_py(), [_counted(b.grams3(at), b.learn[at])], buckets)

    return run


class Automaton:
    """The part of the model that a block's documents walk on.

    States are numbers: a word that was seen, ``root`` for no context, and from
    ``width`` on a bigram that was seen.  ``into[s]`` is the log-probability of the arc
    that leads from the last state but one of its words to s; the arcs of ``root``
    lead to ``low``.  ``weight[s]`` and ``fail[s]`` are a state's failure arc.
    """

    def __init__(self, root: int, into: array, low: array, weight: array, fail: array) -> None:
        self.root, self.into, self.low, self.weight, self.fail = root, into, low, weight, fail

    def walk(self, words: list[int], twos: dict[int, int], threes: dict[int, tuple[float, int]]) -> float:
        """Log-probability of ``words``; the arcs of words (``twos``) and bigrams (``threes``) are by state * width + word."""
        two, three, into, low, weight, fail = twos.get, threes.get, self.into, self.low, self.weight, self.fail
        root, width = self.root, self.root + 1
        state, total = root, 0.0
        for w in words:
            if state > root:
                arc = three(state * width + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    continue
                total += weight[state]
                state = fail[state]
            if state < root:
                to = two(state * width + w)
                if to is not None:
                    total += into[to]
                    state = to
                    continue
                total += weight[state]
            total += into[w]
            state = low[w]
        return total


def _automata(b: Block, answers: pa.Table, distinct: int, total: int) -> Iterator[tuple[int, int, float, float]]:
    """Tokens, known tokens, base score and score of each document."""
    word, c1, pair, c2, (asked, once) = _settled(b, answers)
    n = len(b.words)
    c3 = np.zeros(n, dtype=np.int64)
    c3[once] = 1
    if len(asked):
        _, which = np.unique(b.grams3(asked), return_inverse=True)
        c3[asked] = (_sums(answers, 2)[0] >> 1)[which]
    b.pairs = b.grams2 = b.at_two = b.two = b.three = b.learn = None  # no longer needed, and as large as the words
    base = (c1 + BASE) / (total + BASE * (distinct + 1))
    # by the place of an n-gram's first word
    at2, at3 = np.nonzero(c2)[0], np.nonzero(c3)[0]
    p2 = np.zeros(n)
    p2[at2] = (c2[at2] + PRIOR * base[at2 + 1]) / (c1[at2] + PRIOR)
    log3 = np.log10((c3[at3] + PRIOR * p2[at3 + 1]) / (c2[at3] + PRIOR))
    root = int(word.max()) + 1
    width = root + 1
    states = width + int(pair.max()) + 1
    state = width + pair
    into, weight, fail, low = np.zeros(states), np.zeros(states), np.full(states, root), np.full(width, root)
    logs = np.log10(base)
    into[word], weight[word], low[word] = logs, np.log10(PRIOR / (c1 + PRIOR)), np.where(c1 > 0, word, root)
    into[state[at2]], weight[state[at2]], fail[state[at2]] = np.log10(p2[at2]), np.log10(PRIOR / (c2[at2] + PRIOR)), word[at2 + 1]
    automaton = Automaton(root, *(array(kind, x.tobytes()) for kind, x in (("d", into), ("q", low), ("d", weight), ("q", fail))))
    keys2, to2 = word[at2] * width + word[at2 + 1], state[at2]
    keys3, to3 = state[at3] * width + word[at3 + 2], state[at3 + 1]
    ends = np.cumsum(b.sizes)
    first2, first3 = np.append(0, np.searchsorted(at2, ends)).tolist(), np.append(0, np.searchsorted(at3, ends)).tolist()
    known = np.add.reduceat((c1 > 0).astype(np.int64), ends - b.sizes).tolist()
    for i, (size, e) in enumerate(zip(b.sizes, ends.tolist())):
        two, three = slice(first2[i], first2[i + 1]), slice(first3[i], first3[i + 1])
        twos = dict(zip(keys2[two].tolist(), to2[two].tolist()))
        threes = dict(zip(keys3[three].tolist(), zip(log3[three].tolist(), to3[three].tolist())))
        yield size, known[i], float(logs[e - size : e].sum()), automaton.walk(word[e - size : e].tolist(), twos, threes)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(texts: pa.Table, answers: pa.Table) -> pa.Table:
    names = [f.split()[0] for f in _SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
    if not len(texts):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    give_back()
    distinct, total = (texts.column(c)[0].as_py() or 0 for c in ("distinct", "total"))
    texts = _texts(texts)
    size, known, base, score = zip(*_automata(Block(texts), answers, distinct, total))
    learn = texts.column("learn").to_pylist()
    held = [not x for x in learn]
    return pa.table([texts.column("doc_id"), held, size, known, [total] * len(learn), base, score], names=names).cast(pa.schema(list(zip(names, kinds))))


def trigram_scores(docs: DataFrame, learn: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    The model is learnt from the rows whose column ``learn`` is true; the
    others, with null too, are held out.  Words stand between white space of
    ASCII, A to Z in lower case, and every text ends with a token of its own; ``n_known``
    counts tokens seen in training.  ``base_score`` is the log10-probability by
    the base distribution alone, ``score`` by the model.  A null or empty text
    has its end only.  Repeated rows are learnt from and scored each; without
    training text every word has the base probability 1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(learn).cast("boolean"), F.lit(False)).alias("learn"))
    blocks = math.ceil((rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0) / block) or 1
    buckets = math.ceil(blocks / SHARED)
    placed = with_texts(rows).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    dealt = placed.mapInArrow(_dealt, "block long, body binary").repartition(blocks, "block")
    by_bucket = lambda requests: requests.repartition(buckets, "bucket").groupBy("bucket")
    ones = by_bucket(dealt.groupBy("block").applyInArrow(_first(buckets), _REQUEST)).applyInArrow(_answers(1), _ANSWER)
    # both rounds read this exchange, and all of them that of the texts; nothing is filtered or left out behind it, or it would be made again
    replies = ones.repartition(blocks, "block")
    asked = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_second(buckets), _REQUEST)
    threes = by_bucket(asked).applyInArrow(_answers(2), _ANSWER)
    whole = ones.filter("block < 0").agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total"))
    with_totals = dealt.withColumns({"distinct": whole.select("distinct").scalar(), "total": whole.select("total").scalar()})
    return with_totals.groupBy("block").cogroup(replies.union(threes).repartition(blocks, "block").groupBy("block")).applyInArrow(_scores, _SCORES)


def document_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents; those whose identifier's checksum leaves 0 when divided by 10 are held out, as is a missing identifier."""
    return trigram_scores(docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 != 0).alias("learn")), "learn")


#: DuckDB SQL of ``document_scores`` over ``documents``: checksums bit by bit, the model as joins of counts.
SQL = rf"""
with docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words,
        row_number() over () as row_no,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) as crc
    from documents),
marked as (select *, coalesce(crc % 10 = 0, true) as held_out from docs),
tokens as (select row_no, held_out, unnest(list_append(words, ' ')) as w, unnest(range(1, len(words) + 2)) as place from marked),
three as (
    select row_no, held_out, place, w, lag(w) over p as v, lag(w, 2) over p as u
    from tokens window p as (partition by row_no order by place)),
c1 as (select w, count(*) as n from three where not held_out group by w),
c2 as (select v, w, count(*) as n from three where not held_out and v is not null group by v, w),
c3 as (select u, v, w, count(*) as n from three where not held_out and u is not null group by u, v, w),
whole as (select coalesce(sum(n), 0)::bigint as n, count(*) as distinct_words from c1),
counted as (
    select three.*, coalesce(a.n, 0) as n_w, coalesce(b.n, 0) as n_v, coalesce(c.n, 0) as n_vw, coalesce(d.n, 0) as n_uv, coalesce(e.n, 0) as n_uvw
    from three left join c1 a on a.w = three.w left join c1 b on b.w = three.v
        left join c2 c on c.v = three.v and c.w = three.w left join c2 d on d.v = three.u and d.w = three.v
        left join c3 e on e.u = three.u and e.v = three.v and e.w = three.w),
base as (select counted.*, (n_w + {BASE}) / (whole.n + {BASE} * (distinct_words + 1)) as p1 from counted, whole),
two as (select *, (n_vw + {PRIOR} * p1) / (n_v + {PRIOR}) as p2 from base),
scored as (select *, (n_uvw + {PRIOR} * p2) / (n_uv + {PRIOR}) as p3 from two)
select doc_id, any_value(marked.held_out) as held_out, count(*) as n_tokens, count(*) filter (where n_w > 0) as n_known, any_value(whole.n) as train_tokens,
    sum(log10(p1)) as base_score, sum(log10(p3)) as score
from scored join marked using (row_no), whole group by row_no, doc_id
"""
