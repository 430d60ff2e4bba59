import functools
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from data import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiprint.llm import sstable
from lexiprint.llm.common import fresh_dir

PATH = public_tokenizers.path(sstable.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


@functools.cache
def _both():
    return Tokenizer.from_file(PATH), sstable.Encoder(PATH)


@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r 　ab'sé1.,!<|>​"), max_size=20), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_like_whole_texts(texts):
    whole, encoder = _both()
    got = encoder.batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_table_round_trip_and_lookup():
    rows = [(None, b""), (None, b"\1\0\0\0")] + [(i * 3 - 500, np.arange(i % 17, dtype="<u4").tobytes()) for i in range(1000)] + [(9000, b"")] * 3
    out = io.BytesIO()
    assert sstable.write_table(out, rows, block=300) == (len(rows), sum(len(x) // 4 for _, x in rows))
    t = sstable.Table(out)
    back = [(sstable.id_of(k), ids) for n in range(len(t.index)) for k, _, ids in t.block(n)]
    assert back == rows and len(t.index) > 20
    assert all(t.get(i).tobytes() == ids for i, ids in rows[2:])
    assert t.get(None) is not None and len(t.get(None)) == 0
    assert all(t.get(i * 3 - 499) is None for i in range(1000))
    assert sum(t.may_hold(i * 3 - 499) for i in range(1000)) < 40


def test_documents(spark, plain):
    docs = documents(spark, extra=[(11, "<|endoftext|> a  b"), (12, "tab\t\ttwo \n three")])
    got = sorted(map(tuple, sstable.token_shards(docs, 3).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, text in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = [*plain(text), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_null_identifiers_empty_table_and_files(spark):
    assert sstable.token_shards(empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (5, "c"), (None, None), (-4, "d")], "doc_id long, text string")
    uri = fresh_dir(spark, "t")
    manifest = sstable.write_shards(docs, uri, 2)
    got = sorted(sstable.read_digest(manifest, uri, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -4, 5] and sorted(r["n_tokens"] for r in got[:2]) == [1, 3] and [r["n_tokens"] for r in got[2:]] == [2, 2]


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "a", "word", "."]), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_special_tokens_as_the_library_takes_them(text):
    whole, encoder = _both()
    assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    other = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(other)
    encoder = sstable.Encoder(other)
    assert not encoder.splits
    texts = ["Two words", " lead", "a\nb  c", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.batch(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_is_bounded():
    encoder = sstable.Encoder(PATH, cache=20_000)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(100)]
    assert [encoder.batch([t])[0] for t in texts] == encoder.whole(texts)
    assert encoder.held < 30_000 and len(encoder.known) < 150


def test_rows_of_one_identifier_fill_several_files(spark, plain):
    docs = spark.createDataFrame([(n % 2 * 7 if n % 3 else None, f"text number {n % 50}") for n in range(600)], "doc_id long, text string")
    uri = fresh_dir(spark, "hot")
    manifest = sstable.write_shards(docs, uri, 6)
    assert manifest.count() > 3
    got = sorted(sstable.read_digest(manifest, uri, 6).collect(), key=lambda r: r["start"])
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order) and [r["start"] for r in got[1:]] == [r["start"] + r["n_tokens"] for r in got[:-1]]
    want = sorted((str(i), zlib.crc32(np.array([*plain(t), 2], "<u4").tobytes())) for i, t in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want
