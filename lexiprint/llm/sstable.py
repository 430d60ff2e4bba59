"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    block*        entries, compressed as a whole
    index         first key, offset, length and first token position of each block
    bloom         bit array over the keys
    footer        places of index and bloom, counts, magic

An entry is: bytes shared with the key before it, bytes of key that follow,
the rest of the key, the number of ids, and the ids as little-endian unsigned
32-bit integers.  Keys are 9 bytes: 0 for a null identifier or else 1, then
the identifier with its sign bit flipped, big endian, so byte order is numeric
order and nulls come first.  Numbers are little endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiprint.llm.common import fresh_dir, give_back, kept_in_worker, with_texts

END = 2
TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"LXSST001"
_FOOTER = "<QQQQQQI4x8s"  # index at, its length, bloom at, its length, rows, ids, hashes, magic
_INDEX = "<9sQIQI"  # first key, offset, length, ids before, rows
#: Uncompressed bytes at which a block is closed; a longer document has a block of its own.
BLOCK = 1 << 18
BLOOM_BITS = 10
#: Bytes that a generation of a worker's cache may take, about; it keeps two.
CACHE = 128 << 20
#: Bytes of a cached piece beside its text and ids: two objects and a place in the table.
_ENTRY = 200
#: Bytes of a piece's character with its share of ids; there are fewer ids than characters.
_EACH = 3
#: Bytes of text for each shard file, unless the session's shuffle partitions are more.
SHARD = 256 << 20
#: Marks that are runs of their own behind a letter and before white space.
_ENDS = tuple(".,;:!?")
#: White space that is no single space or line break, or stands at an end.
_ODD = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  |\n\n| \n|\n |^[ \n]|[ \n]$"
#: Bytes of text encoded in one go.
AT_ONCE = 8 << 20
#: Pieces encoded together.
_LINES = 20_000


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((int(doc_id) + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _bloom_hashes(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(hashes)]


def write_table(out, rows: Iterable[tuple[int | None, bytes]], block: int = BLOCK) -> tuple[int, int]:
    """Write ``rows`` (identifier and id bytes, in key order) to a binary stream; rows and ids written.

    Memory holds one block, the index and the keys' hashes.
    """
    packer = zstandard.ZstdCompressor(level=1)
    index, keys, at, n_rows, n_ids = [], [], 0, 0, 0
    buffer, held, first, before, last, started = [], 0, b"", 0, b"", 0

    def close() -> None:
        nonlocal buffer, held, at, last, started
        if started:
            data = packer.compress(b"".join(buffer))
            out.write(data)
            index.append(struct.pack(_INDEX, first, at, len(data), before, started))
            at += len(data)
        buffer, held, last, started = [], 0, b"", 0

    for doc_id, ids in rows:
        key = key_of(doc_id)
        if held >= block:
            close()
        if not started:
            first, before = key, n_ids
        shared = len(os.path.commonprefix([last, key]))
        entry = bytes([shared, len(key) - shared]) + key[shared:] + struct.pack("<I", len(ids) // 4)
        buffer += [entry, ids]
        held += len(entry) + len(ids)
        last, started = key, started + 1
        keys.append((zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1))
        n_rows, n_ids = n_rows + 1, n_ids + len(ids) // 4
    close()
    table = b"".join(index)
    hashes = max(1, round(BLOOM_BITS * 0.69))
    bits = max(64, -(-n_rows * BLOOM_BITS // 8) * 8)
    pair = np.array(keys, dtype=np.uint64).reshape(-1, 2)
    marks = np.zeros(bits, dtype=bool)
    for i in range(hashes):
        marks[(pair[:, 0] + np.uint64(i) * pair[:, 1]) % np.uint64(bits)] = True
    bloom = np.packbits(marks, bitorder="little").tobytes()
    out.write(table + bloom + struct.pack(_FOOTER, at, len(table), at + len(table), len(bloom), n_rows, n_ids, hashes, MAGIC))
    return n_rows, n_ids


class Table:
    """Reader of one shard file from any seekable binary stream."""

    def __init__(self, stream) -> None:
        self.stream = stream
        end = stream.seek(0, 2)
        stream.seek(end - struct.calcsize(_FOOTER))
        at, size, self.bloom_at, self.bloom_size, self.rows, self.ids, self.hashes, magic = struct.unpack(_FOOTER, stream.read(struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.index = list(struct.iter_unpack(_INDEX, self._read(at, size)))
        self.firsts = [x[0] for x in self.index]
        self._bloom: bytes | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def may_hold(self, doc_id: int | None) -> bool:
        """False: the identifier is surely absent."""
        if self._bloom is None:
            self._bloom = self._read(self.bloom_at, self.bloom_size)
        return all(self._bloom[h >> 3] >> (h & 7) & 1 for h in _bloom_hashes(key_of(doc_id), len(self._bloom) * 8, self.hashes))

    def block(self, n: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, ids of the shard before it, and id bytes of each entry."""
        _, at, size, before, _ = self.index[n]
        data, pos, key = zstandard.ZstdDecompressor().decompressobj().decompress(self._read(at, size)), 0, b""
        while pos < len(data):
            shared, more = data[pos], data[pos + 1]
            key = key[:shared] + data[pos + 2 : pos + 2 + more]
            pos += 2 + more
            (count,) = struct.unpack_from("<I", data, pos)
            pos += 4
            yield key, before, data[pos : pos + 4 * count]
            pos, before = pos + 4 * count, before + count

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """Ids of the document by Bloom filter and binary search in the index; the first row of equal keys."""
        key = key_of(doc_id)
        if not self.index or not self.may_hold(doc_id):
            return None
        n = max(0, bisect_right(self.firsts, key) - 1)
        while n and self.firsts[n] == key:  # equal keys may begin in the block before
            n -= 1
        while n < len(self.index) and self.firsts[n] <= key:
            for found, _, ids in self.block(n):
                if found == key:
                    return np.frombuffer(ids, dtype="<u4")
            n += 1
        return None


def splits_at_spaces(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer is of the byte-level kind that ``Encoder`` may hand pieces of a text."""
    rules = json.loads(tokenizer.to_str())
    before = rules.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(plain and not rules.get("normalizer") and not rules.get("truncation") and len(tokenizer.encode("\n", add_special_tokens=False).ids) == 1)


class Encoder:
    """Texts to ids by the tokenizers library as it stands, with a bounded cache.

    In a text whose white space is single spaces and single line breaks, the
    byte-level rule never joins characters across them: a space belongs to the
    word behind it, a line break is a run and an id of its own.  Such texts are
    cut there by Arrow, which also numbers their distinct pieces; a piece new
    to the worker is encoded once, many at a time with a line each, since the
    id of the break parts them again.  Other texts are encoded as a whole, and
    so are texts that hold an added token of the tokenizer, such as its mark of
    the end, and all texts if the tokenizer has other rules.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.splits = splits_at_spaces(self.tokenizer)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = "|".join([_ODD, *map(re.escape, added)])
        self.limit = cache
        if self.splits:
            (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.head = struct.pack("<I", self.line)
            self.ends = dict(zip(_ENDS, self.whole(list(_ENDS))))
            self.before: dict[str, bytes] = {}
            self._renew()

    def _renew(self) -> None:
        self.known = {"": b"", "\n": self.head}  # piece without its leading space -> ids
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: list[str], lead: str) -> Iterator[bytes]:
        """Ids of each piece behind ``lead``, which is a space or nothing."""
        for at in range(0, len(pieces), _LINES):
            text = lead + f"\n{lead}".join(pieces[at : at + _LINES])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            data, ends = ids.tobytes(), np.append(np.nonzero(ids == self.line)[0], len(ids)) * 4
            yield from map(data.__getitem__, map(slice, [0, *(ends[:-1] + 4).tolist()], ends.tolist()))

    def _learn(self, pieces: set[str]) -> None:
        """Make all ``pieces`` known: from the generation before, or encoded anew.

        A last comma, full stop or the like behind a Latin letter is a run of
        its own, so the piece before it serves with any of them.
        """
        known, before = self.known, self.before
        old = pieces.intersection(before)
        known.update(zip(old, map(before.__getitem__, old)))
        new = pieces - old
        ended = [p for p in new if p.endswith(_ENDS) and "A" <= p[-2:-1] < "\u0250" and p[-2].isalpha()]
        stems = {p[:-1] for p in ended}.difference(known)
        old = stems.intersection(before)
        known.update(zip(old, map(before.__getitem__, old)))
        new = new.difference(ended) | (stems - old)
        broken = [p for p in new if p[:1] == "\n"]
        spaced = list(new.difference(broken))
        known.update(zip(spaced, self._lines(spaced, " ")))
        filled = [p for p in broken if p != "\n"]
        known.update(zip(filled, map(self.head.__add__, self._lines([p[1:] for p in filled], ""))))
        known.update((p, known[p[:-1]] + self.ends[p[-1]]) for p in ended)
        for some in (pieces, stems):
            self.held += _ENTRY * len(some) + _EACH * sum(map(len, some))

    def batch(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """Little-endian id bytes of each text, none of them null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.splits:
            return self.whole(texts.to_pylist())
        out: list[bytes] = [b""] * len(texts)
        odd = pc.match_substring_regex(texts, pattern=self.odd)
        if whole := pc.indices_nonzero(odd).to_pylist():
            for n, data in zip(whole, self.whole([texts[n].as_py() for n in whole])):
                out[n] = data
        rest = pc.indices_nonzero(pc.invert(odd))
        if not len(rest):
            return out
        # a break before the text keeps its first word from being one with a space
        lined = pc.replace_substring(pc.binary_join_element_wise("\n", texts.take(rest), ""), pattern="\n", replacement=" \n")
        cut = pc.split_pattern(lined, pattern=" ")
        coded = cut.flatten().dictionary_encode()
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if self.held > self.limit:
            self.before = self.known
            self._renew()
        self._learn(set(pieces).difference(self.known))
        found = list(map(self.known.__getitem__, pieces))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        pool, start = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        count = size[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.repeat(start[which] - ends[:-1], count) + np.arange(ends[-1])]
        edges = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        for n, a, b in zip(rest.to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
            out[n] = ids[a + 1 : b].tobytes()
        return out


def worker_encoder(path: str, cache: int = CACHE) -> Encoder:
    """The process's encoder for ``path``, so that a worker's later tasks find its cache warm."""
    kept = kept_in_worker()
    if path not in kept:
        kept[path] = Encoder(path, cache)
    kept[path].limit = cache
    return kept[path]


def _open_dir(uri: str):
    files, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return files, path.rstrip("/")


def _parts(batches: Iterator[pa.RecordBatch], size: int = AT_ONCE) -> Iterator[tuple[list, pa.StringArray]]:
    """Identifiers and texts in parts of about ``size`` bytes, or one longer text; null texts are empty."""
    ids, held, total = [], [], 0
    for b in batches:
        texts, names, at = pc.fill_null(b.column("text"), ""), b.column("doc_id").to_pylist(), 0
        for n, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
            total += length
            if total >= size or n == len(names):
                ids += names[at:n]
                held.append(texts.slice(at, n - at))
                at = n
            if total >= size:
                yield ids, pa.concat_arrays(held)
                ids, held, total = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(held)


def _writer(uri: str, tokenizer: str, end: int, cache: int, at_once: int):
    tail = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep=tokenizer)
        place = TaskContext.get().partitionId()
        files, path = _open_dir(uri)
        encoder = worker_encoder(tokenizer, cache)
        rows = ((i, data + tail) for ids, texts in _parts(batches, at_once) for i, data in zip(ids, encoder.batch(texts)))
        first = next(rows, None)
        if first is None:
            return
        temp = f"{path}/_{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as out:
            n_rows, n_ids = write_table(out, chain([first], rows))
        # an attempt's file counts only if its row reaches the manifest
        name = f"{uuid.uuid4().hex}.sst"
        files.move(temp, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "place": pa.array([place], pa.int32()), "first_key": [key_of(first[0])], "n_rows": [n_rows], "n_ids": [n_ids]})

    return run


def write_shards(docs: DataFrame, uri: str, shards: int, tokenizer: str | None = None, end: int = END, cache: int = CACHE, at_once: int = AT_ONCE) -> DataFrame:
    """Encode whole texts and write them as shard files below ``uri``; the manifest.

    The manifest has a row per file: ``file, place, first_key, n_rows, n_ids,
    start``, with the place among the files and the ids of all files before.
    It is written to ``uri/manifest`` and names exactly one complete file for
    each range, whatever attempts were lost or repeated.  Rows are ranged by
    identifier, text and position, so rows of one identifier, or of none, may
    fill several files.  ``cache`` and ``at_once`` bound a worker's memory, in bytes.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    files, place = _open_dir(uri)
    files.create_dir(place, recursive=True)
    need = with_texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"hash": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ranged = need.repartitionByRange(shards, "doc_id", "hash", "at").sortWithinPartitions("doc_id", "hash", "at").select("doc_id", "text")
    written = ranged.mapInArrow(_writer(uri, path, end, cache, at_once), "file string, place int, first_key binary, n_rows long, n_ids long")
    written.write.mode("overwrite").parquet(f"{uri}/manifest")
    manifest = docs.sparkSession.read.parquet(f"{uri}/manifest")
    # a row per file
    return manifest.selectExpr("*", "sum(n_ids) over (order by place) - n_ids as start")


def _reader(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open_dir(uri)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                with files.open_input_file(f"{path}/{name}") as f:
                    table = Table(f)
                    for n in range(len(table.index)):
                        rows = [(id_of(k), start + at, len(ids) // 4, zlib.crc32(ids)) for k, at, ids in table.block(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digest(manifest: DataFrame, uri: str, shards: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    return manifest.select("file", "start").repartition(shards, "file").mapInArrow(_reader(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, shards: int | None = None, cache: int = CACHE, at_once: int = AT_ONCE) -> DataFrame:
    """Write ``docs`` as shard files in the shared folder and return the digest read from them.

    Null texts are empty: such a document has the end id only.  Null
    identifiers come first; repeated rows have an entry each, equal
    identifiers in the order of a hash of their texts.  An empty table gives no
    file and an empty result.  Unless ``shards`` is given there are as many as
    the session's shuffle partitions, or as ``SHARD`` bytes a file need.
    """
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    uri = fresh_dir(spark, "tokens")
    return read_digest(write_shards(docs, uri, shards, cache=cache, at_once=at_once), uri, shards)
