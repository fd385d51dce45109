"""Token counts through a digest cache (operator 12).

A text's key is the SHA-256 of its normalised content; the cache holds (key, tokens) below a folder for each tokenizer
version, which is the SHA-256 of the tokenizer's file, the library's name and the library's version. Keys are joined
with the stored counts, each distinct key without a count is encoded once, and these counts are appended::

    <cache>/version=<64 hex digits>/run=<32 hex digits>/*.parquet    digest binary, n_tokens long

Each run appends a folder of its own, so runs beside each other never disturb one another; a key that two of them
stored has equal counts and is read once. A run that died leaves whole rows or none.

Normalised content: null is the empty text, and runs of ASCII white space become one blank where the tokenizer's own
normaliser says the same. Nothing else is folded, since a count must be that of the whole text as the library gives it:
strings of special tokens inside a text count as the library does by default, no begin, end or added token is counted,
and nothing is cut or padded. ``.json`` files are read by ``tokenizers``, ``.model`` files by ``sentencepiece``.

Texts move only for misses: as the first text of each key, combined before the shuffle, so a text that a third of the rows repeat is
sent once by each task. Where the misses are few they are broadcast (``FEW_MISSES``) and all other texts stay
where they are. Counts return to the rows by a join that broadcasts the most frequent keys.

One row comes out for each row that goes in: null ids and repeated rows too. A null or empty text has 0 bytes and 0 tokens.
An empty table gives an empty result and appends nothing. Other columns are ignored. A very long text is encoded alone, whole, in
about 40 times its size.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from importlib import metadata

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import skew, store, texts, token_shards

#: Misses that are broadcast: 32 bytes each.
FEW_MISSES = 200_000
#: A context's length, for the report.
LIMIT = 512
CACHE_SCHEMA = "digest binary, n_tokens long"


def _library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, the library's name and the library's version."""
    digest = hashlib.sha256(f"{_library(path)} {metadata.version(_library(path))}\n".encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


def _rules(path: str) -> dict:
    if _library(path) != "tokenizers":
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def normalised(text: Column, path: str) -> Column:
    """The content that decides a text's count."""
    text = F.coalesce(text, F.lit(""))
    steps = _rules(path).get("normalizer") or {}
    for step in steps.get("normalizers", [steps]):
        if step.get("type") == "Replace" and step.get("pattern") == {"Regex": r"\s+"} and step.get("content") == " ":
            return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")
    return text


class Counter:
    """Tokens of whole texts, as the library of the file's kind counts them."""

    def __init__(self, path: str):
        rules = _rules(path)
        split = rules.get("pre_tokenizer") or {}
        spans = rules.get("normalizer", 1) is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.spans = token_shards.encoder(path) if spans else None
        if _library(path) == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda items: model.encode(items, num_threads=1)
        elif not spans:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda items: model.encode_batch_fast(items, add_special_tokens=False)

    def count(self, column: pa.ChunkedArray) -> np.ndarray:
        if self.spans:
            return self.spans.encode(*texts.text_bytes(column))[1]
        return np.array([len(x) for x in self.encode([t or "" for t in column.to_pylist()])], np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def stored_counts(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row for each key of a version's folder; None where no run has stored any."""
    fs, path = store.filesystem(folder)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    kept = spark.read.schema(CACHE_SCHEMA + ", run string").parquet(folder)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, misses: DataFrame, n_misses: int, path: str, folder: str) -> DataFrame:
    """Count each key of ``misses`` (digest) once from the text of any of its rows in ``docs`` and append the counts."""
    keyed = docs.select(normalised(F.col("text"), path).alias("text")).withColumn("digest", _digest(F.col("text")))
    if n_misses <= FEW_MISSES:
        one = keyed.join(F.broadcast(misses), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    else:
        one = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for table in texts.text_slices(batches, gather=True):
            yield pa.RecordBatch.from_arrays([table["digest"].combine_chunks(), pa.array(tokens.count(table["text"]), pa.int64())], ["digest", "n_tokens"])

    run = f"{folder}/run={uuid.uuid4().hex}"
    one.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).write.parquet(run)
    return docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(run)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; ``cache`` is a folder that all executors share."""
    spark = docs.sparkSession
    texts.small_batches(spark)
    folder = f"{cache.rstrip('/')}/version={tokenizer_version(path)}"
    keys = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _digest(normalised(F.col("text"), path)).alias("digest"))
    keys = store.materialise(keys, "digests")
    distinct = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    stored = stored_counts(spark, folder)
    found = distinct.withColumn("n_tokens", F.lit(None).cast("long")) if stored is None else distinct.join(stored, "digest", "left")
    found = store.materialise(found, "found")
    r = found.agg(F.sum("copies").alias("rows"), F.count_if(F.col("n_tokens").isNull()).alias("misses")).first()
    known = found.filter("n_tokens is not null")
    if r["misses"]:
        misses = found.filter("n_tokens is null").drop("n_tokens")
        fresh = encode_misses(docs, misses.select("digest"), r["misses"], path, folder)
        known = known.unionByName(misses.join(fresh, "digest"))
    out = skew.join_counted(keys, known, ["digest"], "copies", r["rows"] or 0)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
