import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tandem.llm import queries, store, token_cache
from tandem.llm.queries import tokenizer_file

BYTES, WORDS, PIECES = (tokenizer_file(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PLAIN = {BYTES: Tokenizer.from_file(BYTES), WORDS: Tokenizer.from_file(WORDS), PIECES: SentencePieceProcessor(model_file=PIECES)}


def plain_count(path, text):
    if path == PIECES:
        return len(PLAIN[path].encode(text or ""))
    return len(PLAIN[path].encode(text or "", add_special_tokens=False).ids)


ROWS = [(1, "hello world"), (2, None), (None, "no id"), (3, ""), (1, "hello world"), (4, "hello  \n world"), (5, "long words " * 60000), (6, "é<|endoftext|> x <|ENDOFTEXT|>"), (7, "\t "), (8, "中文 ABC don't")]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_counts_of_odd_rows(spark, path):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, digest int, n_tokens string").repartition(3)
    got = token_cache.count_tokens(docs, path, store.shared_dir(spark, "c")).collect()
    want = [(i, len((t or "").encode()), plain_count(path, t), plain_count(path, t) > 512) for i, t in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_each_distinct_text_is_encoded_once_and_kept(spark):
    cache = store.shared_dir(spark, "c")
    folder = f"{cache}/version={token_cache.tokenizer_version(BYTES)}"
    rows = lambda: spark.read.schema("digest binary, n_tokens long, run string").parquet(folder)
    docs = spark.createDataFrame([(k, f"text {k % 7} of a few") for k in range(3000)], "doc_id long, text string").repartition(5)
    first = token_cache.count_tokens(docs, BYTES, cache)
    assert first.count() == 3000 and rows().count() == 7
    assert token_cache.count_tokens(docs, BYTES, cache).count() == 3000 and rows().count() == 7  # nothing is encoded again
    more = spark.createDataFrame([(k, f"text {k % 9} of a few") for k in range(90)], "doc_id long, text string")
    got = token_cache.count_tokens(more, BYTES, cache).collect()
    assert rows().count() == 9 and rows().select("run").distinct().count() == 2
    assert all(r["n_tokens"] == plain_count(BYTES, f"text {r['doc_id'] % 9} of a few") for r in got)
    token_cache.count_tokens(more, WORDS, cache).count()
    assert rows().count() == 9  # another tokenizer has a folder of its own


def test_stored_counts_are_used_and_read_once(spark):
    cache = store.shared_dir(spark, "c")
    folder = f"{cache}/version={token_cache.tokenizer_version(BYTES)}"
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    stored = docs.filter("doc_id = 1").selectExpr("unhex(sha2(text, 256)) AS digest", "77L AS n_tokens")
    for run in "ab":  # two runs beside each other stored the same key
        stored.write.parquet(f"{folder}/run={run}")
    got = {r["doc_id"]: r["n_tokens"] for r in token_cache.count_tokens(docs, BYTES, cache).collect()}
    assert got == {1: 77, 2: plain_count(BYTES, "c d")}


def test_many_misses_take_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(token_cache, "FEW_MISSES", 2)
    cache = store.shared_dir(spark, "c")
    docs = spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string")
    token_cache.count_tokens(docs.filter("doc_id < 4"), BYTES, cache)
    got = token_cache.count_tokens(docs, BYTES, cache).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, plain_count(BYTES, t)) for i, t in ROWS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_cache.count_tokens(docs, BYTES, store.shared_dir(spark, "c")).collect() == []


@given(st.text(alphabet="aAé \t\n\r\f\x0b\x85\xa0 '1.<|endoftx>", max_size=30))
@settings(max_examples=300, deadline=None)
def test_folded_white_space_keeps_the_count(text):
    import re

    folded = re.sub(r"[ \t\n\x0B\f\r]+", " ", text)
    assert plain_count(WORDS, folded) == plain_count(WORDS, text)


def test_query_counts_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op12_token_counts"](spark, sf).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {(i, len((t or "").encode()), plain_count(BYTES, t), plain_count(BYTES, t) > 512) for i, t in docs.items()}
    assert len(got) == len(docs)
