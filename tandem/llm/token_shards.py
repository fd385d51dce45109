"""Token-ID shards: patched frame-of-reference blocks with a block index (operator 2).

File format of one shard (little-endian; fixed values)::

    magic "PFORSHD1"
    blocks      u32 base | u16 n | u16 n_exceptions | u8 width | 3 zero bytes      (12 bytes)
                width * BLOCK / 64 words u64: the low ``width`` bits of value - base
                u8 position of each exception, zero-padded to 4 bytes | u32 value - base of each
    block index u64 start of each block
    documents   i64 doc_id | u8 has_id | u32 n_tokens, as three arrays in order
    footer      u64 n_ids | u64 n_blocks | u64 n_docs | u64 index start | magic

A block holds BLOCK ids of the concatenated documents (fewer only in a shard's last block). The width is
the bit length at a percentile of the block's offsets; wider values are exceptions, so one rare id does
not widen its block. The index makes any id range readable from its block on.

Texts are encoded with the ``tokenizers`` library, as it does by itself: the string of an added token (such as an
end mark) inside a text gives that token's id. A byte-level vocabulary is split into spans which its
pre-tokenizer always separates, and at both ends of added tokens' strings, every distinct span is encoded once for
a worker, and repeats are looked up by a 128-bit hash of the span's bytes. A very long text is held with about
40 bytes for each of its bytes.

Order and places: rows are dealt into ranges of (doc_id, hash of the text), sorted, and each range is one
shard, so only one row for each shard (its counts) reaches the driver. Null ids come first. Repeated
doc_ids stay, in the order of their texts. A null text is encoded like an empty one: the end id alone.
Extra columns are ignored. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, texts

MAGIC = b"PFORSHD1"
BLOCK = 256
HEAD = 12
FOOTER = struct.Struct("<QQQQ8s")
#: Spans a worker remembers; beyond that it keeps those that came again. Bounds its memory.
CACHE_SPANS = 150_000
#: Spans given to the tokenizer at once.
ENCODE_SPANS = 10_000


# --- patched frame of reference ------------------------------------------------------------------------------


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Encode ids (uint32); gives the bytes and each block's length in bytes."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.int64)
    m = -(-n // BLOCK)
    grid = np.empty(m * BLOCK, np.uint32)
    grid[:n] = ids
    sizes = np.full(m, BLOCK, np.int64)
    if n % BLOCK:
        sizes[-1] = n % BLOCK
        grid[n:] = ids[(m - 1) * BLOCK :].min()
    grid = grid.reshape(m, BLOCK)
    base = grid.min(axis=1)
    delta = grid - base[:, None]
    bits = _bit_lengths(delta)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, at, axis=1)[:, at].astype(np.int64)
    out_row, out_col = np.nonzero(bits > width[:, None])
    n_exc = np.bincount(out_row, minlength=m)
    pos_bytes = (n_exc + 3) // 4 * 4
    body = width * (BLOCK // 8)
    lengths = HEAD + body + pos_bytes + 4 * n_exc
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)

    head = np.zeros(m, np.dtype([("base", "<u4"), ("n", "<u2"), ("exc", "<u2"), ("width", "u1"), ("pad", "u1", 3)]))
    head["base"], head["n"], head["exc"], head["width"] = base, sizes, n_exc, width
    out[starts[:, None] + np.arange(HEAD)] = head.view(np.uint8).reshape(m, HEAD)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        low = (delta[rows].astype(np.uint64) & np.uint64((1 << w) - 1)).T.copy()
        words = np.zeros((w * BLOCK // 64, len(rows)), np.uint64)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            words[k] |= low[j] << np.uint64(shift)
            if shift + w > 64:
                words[k + 1] |= low[j] >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(rows), -1)
        out[(starts[rows] + HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    if len(out_row):
        nth = np.arange(len(out_row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        tail = (starts + HEAD + body)[out_row]
        out[tail + nth] = out_col.astype(np.uint8)
        values = delta[out_row, out_col].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(tail + pos_bytes[out_row] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes(), lengths


def unpack_blocks(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``raw`` (uint8)."""
    m = len(starts)
    if not m:
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    head = raw[starts[:, None] + np.arange(HEAD)]
    base = head[:, 0:4].copy().view("<u4")[:, 0]
    sizes = head[:, 4:6].copy().view("<u2")[:, 0].astype(np.int64)
    n_exc = head[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64)
    width = head[:, 8].astype(np.int64)
    grid = np.zeros((m, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = raw[(starts[rows] + HEAD)[:, None] + np.arange(w * BLOCK // 8)]
        words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
        mask = np.uint64((1 << w) - 1)
        values = np.empty((BLOCK, len(rows)), np.uint32)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            v = words[k] >> np.uint64(shift)
            if shift + w > 64:
                v |= words[k + 1] << np.uint64(64 - shift)
            values[j] = v & mask
        grid[rows] = values.T
    total = int(n_exc.sum())
    if total:
        row = np.repeat(np.arange(m), n_exc)
        nth = np.arange(total) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        tail = (starts + HEAD + width * (BLOCK // 8))[row]
        col = raw[tail + nth].astype(np.int64)
        grid[row, col] = raw[(tail + ((n_exc + 3) // 4 * 4)[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
    grid += base[:, None]
    if (sizes == BLOCK).all():
        return grid.reshape(-1)
    return grid.reshape(-1)[(np.arange(BLOCK) < sizes[:, None]).reshape(-1)]


class ShardWriter:
    """Appends documents' ids to one shard; keeps only the open block and the indexes in memory."""

    def __init__(self, uri: str, percentile: float = 0.9):
        self.file, self.percentile = store.AtomicFile(uri), percentile
        self.file.write(MAGIC)
        self.rest = np.zeros(0, np.uint32)
        self.lengths: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_ids = 0

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, counts: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.docs.append((doc_ids.astype("<i8"), has_id.astype(np.uint8), counts.astype("<u4")))
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        data, lengths = pack_blocks(ids, self.percentile)
        if len(lengths):
            self.file.write(data)
            self.lengths.append(lengths)

    def close(self) -> tuple[int, int]:
        self._put(self.rest)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        starts = len(MAGIC) + np.cumsum(lengths) - lengths
        at = self.file.size
        n_docs = sum(len(d[0]) for d in self.docs)
        self.file.write(starts.astype("<u8").tobytes())
        for k in range(3):
            self.file.write(b"".join(d[k].tobytes() for d in self.docs))
        self.file.write(FOOTER.pack(self.n_ids, len(starts), n_docs, at, MAGIC))
        self.file.commit()
        return self.n_ids, n_docs


class ShardReader:
    """Random access to a shard by id position, through its block index."""

    def __init__(self, data: bytes):
        self.n_ids, n_blocks, self.n_docs, at, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.raw = np.frombuffer(data, np.uint8)
        self.starts = np.frombuffer(data, "<u8", n_blocks, at)
        at += 8 * n_blocks
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.has_id = np.frombuffer(data, np.uint8, self.n_docs, at)
        self.counts = np.frombuffer(data, "<u4", self.n_docs, at + self.n_docs)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first = lo // BLOCK
        got = unpack_blocks(self.raw, self.starts[first : (hi - 1) // BLOCK + 1])
        return got[lo - first * BLOCK : hi - first * BLOCK]


# --- encoding -------------------------------------------------------------------------------------------------


def _span_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a byte-level pre-tokenizer always splits: the start of a run of spaces and line ends
    behind a plain character, an ASCII letter before or behind ASCII punctuation (not behind an
    apostrophe, which may open a contraction), and the first byte of each row. Leaving a place out is
    harmless, so every doubtful one (other white space, other scripts' signs) is left out."""
    n = len(raw)
    cut = np.zeros(n, bool)
    if n > 1:
        lower = raw | 32
        letter = (lower >= 97) & (lower <= 122)
        plain = (raw > 32) & (raw < 127)
        punct = plain & ~letter & ~((raw >= 48) & (raw <= 57))
        blank = (raw == 32) | (raw == 10)
        solid = plain.copy()
        solid[1:] |= (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
        cut[1:] = (blank[1:] & solid[:-1]) | (punct[1:] & letter[:-1]) | (letter[1:] & punct[:-1] & (raw[:-1] != 39))
    rows = offsets[:-1]
    cut[rows[rows < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Whole texts to ids with a tokenizer file; remembers the spans it has met."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = [t.content.encode() for t in added]
        #: an added token that takes blanks beside it, or only whole words, is left to the tokenizer with its whole text
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added) and self.tokenizer.normalizer is None
        self.pattern = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def shrink(self) -> None:
        """Keep the spans that were met again, if these are few enough."""
        keep = np.flatnonzero(self.hits > 0)
        if len(keep) > CACHE_SPANS // 2:
            keep = keep[np.argsort(-self.hits[keep], kind="stable")[: CACHE_SPANS // 2]]
            keep.sort()
        n = self.n[keep]
        start = np.cumsum(n) - n
        ids = self.pool[np.arange(int(n.sum())) + np.repeat(self.at[keep] - start, n)]
        self.keys, self.checks, self.at, self.n, self.hits = self.keys[keep], self.checks[keep], start, n, np.zeros(len(keep), np.int64)
        self.pool = np.concatenate([ids, np.zeros(1 << 20, np.uint32)])
        self.used = len(ids)

    def _encode(self, spans: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(spans, add_special_tokens=False)]

    def direct(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(items), ENCODE_SPANS):
            found = self._encode(items[lo : lo + ENCODE_SPANS])
            ids.append(np.array([x for own in found for x in own], np.uint32))
            counts.append(np.array([len(x) for x in found], np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def added_spans(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Places of the added tokens' strings, the leftmost and longest first, none across two rows."""
        data = raw.tobytes()
        if not any(t in data for t in self.added):
            return []
        return [m.span() for a, b in zip(offsets.tolist(), offsets[1:].tolist()) for m in self.pattern.finditer(data, a, b)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows together, and the number of ids of each row."""
        import pandas as pd

        starts = _span_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        added = self.added_spans(raw, offsets)
        if added and not self.plain:
            return self.direct([raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])])
        if added:
            a, b = np.array(added, np.int64).T
            behind = np.searchsorted(a, starts) - 1
            inside = (behind >= 0) & (starts < b[behind])
            starts = np.union1d(starts[~inside], np.concatenate([a, b[b < len(raw)]]))
        ends = np.append(starts[1:], len(raw))
        key, check = (texts.span_hashes(raw, starts, ends, k) for k in (0, 1))
        codes, distinct = pd.factorize(key)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if not (check == check[first][codes]).all():  # two spans with one 64-bit hash
            return self.direct([raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])])
        slot = np.searchsorted(self.keys, distinct)
        slot[slot == len(self.keys)] = 0
        known = (self.keys[slot] == distinct) if len(self.keys) else np.zeros(len(distinct), bool)
        if known.any() and not (self.checks[slot[known]] == check[first[known]]).all():
            return self.direct([raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])])
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > CACHE_SPANS and len(self.keys):
                self.shrink()
                return self.encode(raw, offsets)
            data = raw.tobytes()
            ids, counts = self.direct([data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], ids, np.zeros(len(self.pool), np.uint32)])
            else:
                self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            order = np.argsort(np.concatenate([self.keys, distinct[new]]), kind="stable")
            for name, more in (("keys", distinct[new]), ("checks", check[first[new]]), ("at", at), ("n", counts), ("hits", np.zeros(len(new), np.int64))):
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])
            slot = np.searchsorted(self.keys, distinct)
        self.hits[slot[known]] += 1
        n, at = self.n[slot][codes], self.at[slot][codes]
        done = np.cumsum(n)
        ids = self.pool[np.arange(int(done[-1])) + np.repeat(at - (done - n), n)]
        edge = np.searchsorted(starts, offsets)
        return ids, np.diff(np.concatenate([[0], done])[edge])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- Spark ----------------------------------------------------------------------------------------------------


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str, percentile: float = 0.9) -> list[dict]:
    """Write shards in ascending doc_id order; gives each shard's file, first id place and counts."""
    store.make_dir(out_dir)
    spark = docs.sparkSession
    texts.small_batches(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{out_dir}/part-{part:06d}.pfor"
        out, enc = None, encoder(tokenizer_path)
        for table in texts.text_slices(batches):
            out = out or ShardWriter(name, percentile)
            raw, offsets = texts.text_bytes(table["text"])
            ids, counts = enc.encode(raw, offsets)
            ends = np.cumsum(counts + 1) - 1
            whole = np.full(len(ids) + len(counts), end_id, np.uint32)
            keep = np.ones(len(whole), bool)
            keep[ends] = False
            whole[keep] = ids
            doc_ids = table["doc_id"].combine_chunks()
            out.add(whole, np.asarray(doc_ids.fill_null(0), np.int64), np.asarray(doc_ids.is_valid(), bool), counts + 1)
        if out:
            n_ids, n_docs = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_ids": [n_ids], "n_docs": [n_docs]})

    found = sorted(rows.mapInArrow(write, "part long, file string, n_ids long, n_docs long").collect(), key=lambda r: r["part"])
    shards, start = [], 0
    for r in found:
        shards.append({"file": r["file"], "start": start, "n_ids": r["n_ids"], "n_docs": r["n_docs"]})
        start += r["n_ids"]
    return shards


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Ids decoded at once by a reader.
READ_IDS = 1 << 20


def read_token_shards(spark, shards: list[dict]) -> DataFrame:
    """Decode the shards again: one row per document with its place, length and the CRC-32 of its ids."""
    if not shards:
        return spark.createDataFrame([], READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(store.read_all(row["file"]))
                ends = np.cumsum(shard.counts.astype(np.int64))
                lo = 0
                while lo < shard.n_docs:
                    base = int(ends[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, base + READ_IDS)))
                    data = memoryview(shard.ids(base, int(ends[hi - 1])).astype("<u4")).cast("B")
                    edges = [0, *((ends[lo:hi] - base) * 4).tolist()]
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:])]
                    counts = shard.counts[lo:hi].astype(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=shard.has_id[lo:hi] == 0),
                            "start": pa.array(row["start"] + ends[lo:hi] - counts, pa.int64()),
                            "n_tokens": pa.array(counts, pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    lo = hi

    rows = [(s["file"], int(s["start"])) for s in shards]
    listed = spark.sparkContext.parallelize(rows, len(rows)).toDF("file string, start long")
    return listed.mapInArrow(read, READ_SCHEMA)
