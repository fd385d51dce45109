import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tandem.llm import store, texts
from tandem.llm import token_shards as ts
from tandem.llm.queries import END_ID, tokenizer_file

VOCAB = tokenizer_file("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    data, lengths = ts.pack_blocks(ids)
    assert len(data) == lengths.sum()
    assert (ts.unpack_blocks(np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(256, 7, np.uint32)
    ids[3] = 2**31
    plain, _ = ts.pack_blocks(np.full(256, 7, np.uint32))
    data, _ = ts.pack_blocks(ids)
    assert len(data) <= len(plain) + 8


ALPHABET = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "don't", "中文"]), st.text(alphabet="ab'sL 1.,#\n\t é…<|>", max_size=12)), max_size=8).map("".join)
#: The tokenizer as the library loads it, apart from the encoder under test.
PLAIN = Tokenizer.from_file(VOCAB)


@given(st.lists(ALPHABET, max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_tokenizer(values):
    enc = ts.encoder(VOCAB)
    raw, offsets = texts.text_bytes(pa.chunked_array([pa.array(values, pa.string())]))
    ids, counts = enc.encode(raw, offsets)
    want = [e.ids for e in PLAIN.encode_batch(values, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


ROWS = [(5, "hello world"), (1, None), (None, "no id"), (3, ""), (5, "hello world"), (5, "another text"), (2, "long " * 30000), (-4, "é<|endoftext|>")]


def test_shards_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in ROWS], "doc_id long, text string, start string, n_tokens double").repartition(3)
    shards = ts.write_token_shards(docs, VOCAB, END_ID, store.shared_dir(spark, "t"))
    got = ts.read_token_shards(spark, shards).collect()
    assert len(got) == len(ROWS)
    order = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order]])[:-1].tolist()
    tok = PLAIN
    want = sorted((str(i), zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4").tobytes())) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    shards = ts.write_token_shards(docs, VOCAB, END_ID, store.shared_dir(spark, "t"))
    assert ts.read_token_shards(spark, shards).count() == 0


def test_random_access():
    ids = np.arange(1000, dtype=np.uint32) * 7919 % 50000
    data, lengths = ts.pack_blocks(ids)
    starts = np.cumsum(lengths) - lengths
    blob = np.frombuffer(data, np.uint8)
    assert (ts.unpack_blocks(blob, starts[1:3]) == ids[256:768]).all()


def test_span_hashes_across_spans():
    raw = np.random.default_rng(0).integers(0, 256, texts._SPAN * 2 + 500).astype(np.uint8)
    raw[texts._SPAN - 20 : texts._SPAN + 30] = raw[10:60]
    h = texts.span_hashes(raw, np.array([10, texts._SPAN - 20, 11]), np.array([60, texts._SPAN + 30, 61]))
    assert h[0] == h[1] != h[2]


@pytest.mark.parametrize("value, want", [("A-b É9_x", [b"a", b"b", "É9".encode(), b"x"]), ("", []), ("!!", [])])
def test_words(value, want):
    assert texts.words_of(value.encode()) == want
