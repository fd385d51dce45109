"""Benchmark decontamination with suffix arrays over the training texts (operator 3).

Documents are taken in shards of a few million bytes. Each shard gets a suffix array over word ids, built by
prefix doubling and stopped at the longest test item. Every suffix of every test item is then binary-searched
in it, all suffixes together, one word deeper at a time: the interval of suffixes that still agree gives the
longest verbatim match and all of its places. Where the match reaches the window length, its interval is every
occurrence of that window in the shard.

Words that occur in no test item get one id that matches nothing, so suffixes begin at shared words only; no
match is lost by it. Test items are written to the shared folder in blocks of about ``block_bytes`` of text (by the
executors; an item is not split), and a task reads one block after the other for each of its shards, so no process
holds more of the benchmark than one block. A benchmark of one block is read once for a task. A document longer
than a shard is a shard of its own, of about 60 bytes for each of its bytes.

A word is a run of ASCII letters (lower-cased), digits and non-ASCII characters. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. A document is contaminated
if a word of it lies in an occurrence and hits * share >= words. Null and empty texts have no words and stay.
Repeated rows are judged alike; documents without an id too. Items without an id count towards hits, not items.
Extra columns are kept by ``decontaminate`` and ignored by the reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, texts

WINDOW = 13
#: One hit word in this many contaminates.
SHARE = 20
BLOCK_BYTES = 16 << 20
#: Tasks that write the blocks, at most: a small benchmark is few blocks.
BLOCK_WRITERS = 4
#: Text bytes of one suffix array.
SHARD_BYTES = 4 << 20


def test_blocks(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """Files of test items with words, in blocks."""
    folder = store.shared_dir(benchmark.sparkSession, "benchmark")
    store.make_dir(folder)
    schema = pa.schema([("item_id", pa.string()), ("text", pa.large_string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for table in texts.text_slices(batches, step=block_bytes, gather=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as out:
                out.write_table(table.cast(schema))
            name = f"{folder}/block-{part:06d}-{k:06d}.arrow"
            file, k = store.AtomicFile(name), k + 1
            file.write(sink.getvalue().to_pybytes())
            file.commit()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    return sorted(r["file"] for r in items.coalesce(BLOCK_WRITERS).mapInArrow(write, "file string").collect())


def load_block(name: str) -> tuple[list, dict, np.ndarray, np.ndarray]:
    """A block's item ids, word numbers, item words as one array, and item starts."""
    table = pa.ipc.open_stream(store.read_all(name)).read_all()
    numbers: dict[bytes, int] = {}
    items, flat, lengths = [], [], []
    for item, text in zip(table["item_id"].to_pylist(), table["text"]):
        words = [numbers.setdefault(w, len(numbers) + 1) for w in texts.words_of(text.as_py().encode())]
        if words:
            items.append(item)
            flat.append(np.array(words, np.int32))
            lengths.append(len(words))
    return items, numbers, np.concatenate(flat) if flat else np.zeros(0, np.int32), np.cumsum([0, *lengths]).astype(np.int64)


class Blocks:
    """The blocks in order, one in memory at a time."""

    def __init__(self, files: list[str]):
        self.files, self.only = files, None

    def __iter__(self) -> Iterator[tuple]:
        for name in self.files:
            block = self.only or load_block(name)
            if len(self.files) == 1:
                self.only = block
            if block[0]:
                yield block


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes that begin with a positive id, sorted by at least ``depth`` words.

    A zero ends a suffix: it sorts before every word. Ranks double their depth in each round, and only
    suffixes that still share a rank with another are sorted again.
    """
    n = len(ids)
    places = np.flatnonzero(ids)
    rank = np.zeros(n + 1, np.int64)
    order = places[np.argsort(ids[places], kind="stable")]
    key = ids[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1] + 1 if len(order) else 0
    k = 1
    open_at = np.arange(len(order))
    while k < depth and len(open_at):
        lone = first.copy()
        lone[:-1] &= first[1:]
        open_at = open_at[~lone[open_at]] if k > 1 else np.flatnonzero(~lone)
        if not len(open_at):
            break
        who = order[open_at]
        own = rank[who]
        nxt = rank[np.minimum(who + k, n)]
        resort = np.argsort(own * np.int64(n + 2) + nxt, kind="stable")
        who, own, nxt = who[resort], own[resort], nxt[resort]
        order[open_at] = who
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        first[open_at] = new
        rank[who] = open_at[new][np.cumsum(new) - 1] + 1
        k *= 2
    return order


def longest_matches(ids: np.ndarray, order: np.ndarray, test: np.ndarray, ends: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix: length of its longest match and that match's interval of ``order``; and the
    interval after ``want`` words (empty where the match is shorter). ``ends``: end of the suffix's item."""
    n, m = len(ids), len(test)
    at = np.arange(m)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
    length = np.zeros(m, np.int64)
    want_lo, want_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    padded = np.append(ids, 0)
    live = at if len(order) else at[:0]
    depth = 0
    while len(live):
        word = test[live + depth]

        def bound(right: bool) -> np.ndarray:
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                busy = a < b
                if not busy.any():
                    return a
                mid = (a + b) >> 1
                there = padded[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, n)]
                go = busy & ((there <= word) if right else (there < word))
                a = np.where(go, mid + 1, a)
                b = np.where(busy & ~go, mid, b)

        left, right = bound(False), bound(True)
        ok = left < right
        live, left, right = live[ok], left[ok], right[ok]
        lo[live], hi[live] = left, right
        depth += 1
        length[live] = depth
        full = want[live] == depth
        want_lo[live[full]], want_hi[live[full]] = left[full], right[full]
        live = live[live + depth < ends[live]]
    return length, lo, hi, want_lo, want_hi


class _Shard:
    """A shard's words and its suffix array against one block of test items."""

    def __init__(self, table: pa.Table):
        raw, offsets = texts.text_bytes(table["text"])
        data = raw.tobytes().translate(texts.WORD_TABLE)
        self.words = [data[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.n_words + 1) - (self.n_words + 1)  # a zero stands behind each document
        self.size = int((self.n_words + 1).sum())

    def search(self, block, window: int):
        items, numbers, flat, starts = block
        get = numbers.get
        ids = np.zeros(self.size, np.int32)
        for a, ws in zip(self.first.tolist(), self.words):
            ids[a : a + len(ws)] = [get(w, 0) for w in ws]
        lengths = np.diff(starts)
        item = np.repeat(np.arange(len(items)), lengths)
        ends = starts[1:][item]
        at = np.arange(len(flat))
        size = np.minimum(window, lengths[item])
        want = np.where(at + size <= ends, size, 0)
        order = suffix_array(ids, int(lengths.max(initial=1)))
        return ids, order, item, longest_matches(ids, order, flat, ends, want), want

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


def _intervals(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the intervals, one after the other, and the interval of each."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


#: Window occurrences expanded at once.
STEP_PLACES = 1 << 20

REPORT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def _report(table: pa.Table, blocks: Blocks, window: int, share: int) -> dict:
    shard = _Shard(table)
    n = table.num_rows
    cover = np.zeros(shard.size + 1, np.int64)
    found: list[set] = [set() for _ in range(n)]
    for block in blocks:
        items = block[0]
        ids, order, item, (_, _, _, lo, hi), want = shard.search(block, window)
        hit = np.flatnonzero(hi > lo)
        weight = np.cumsum((hi - lo)[hit])
        for part in np.split(hit, np.flatnonzero(np.diff(weight // STEP_PLACES)) + 1):
            at, which = _intervals(lo[part], hi[part])
            places = order[at]
            size = want[part][which]
            np.add.at(cover, places, 1)
            np.add.at(cover, places + size, -1)
            pairs = np.unique(shard.document(places) * len(items) + item[part][which])
            for doc, k in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist()):
                found[doc].add(items[k])
    inside = np.cumsum(cover[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(inside)])
    n_hit = sums[shard.first + shard.n_words] - sums[shard.first]
    lists = [sorted(str(i) for i in s if i is not None) for s in found]
    return {
        "n_words": shard.n_words,
        "n_hit": n_hit,
        "n_items": [len(x) for x in lists],
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
        "contaminated": (n_hit > 0) & (share * n_hit >= shard.n_words),
        "item_ids": lists,
    }


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words inside a test window, the items found, and the verdict."""
    texts.small_batches(docs.sparkSession)
    files = test_blocks(benchmark, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files)
        for table in texts.text_slices(batches, step=SHARD_BYTES, gather=True):
            got = _report(table, blocks, window, share)
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().cast(pa.int64())]
                + [pa.array(got[k], t) for k, t in (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("item_ids", pa.list_(pa.string())))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, REPORT_SCHEMA)


MATCH_SCHEMA = "item_id string, item_word long, length long, doc_id long, doc_word long"


def longest_match_report(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each test suffix's longest verbatim match in each shard, with all of its places; ``least`` words or more."""
    texts.small_batches(docs.sparkSession)
    files = test_blocks(benchmark, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files)
        for table in texts.text_slices(batches, step=SHARD_BYTES, gather=True):
            shard = _Shard(table)
            doc_ids = table["doc_id"].combine_chunks()
            for block in blocks:
                items, _, _, starts = block
                _, order, item, (length, lo, hi, _, _), _ = shard.search(block, WINDOW)
                good = np.flatnonzero(length >= least)
                for part in np.array_split(good, max(1, int((hi - lo)[good].sum()) // STEP_PLACES)):
                    at, which = _intervals(lo[part], hi[part])
                    places = order[at]
                    doc = shard.document(places)
                    mine = part[which]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if items[k] is None else str(items[k]) for k in item[mine].tolist()], pa.string()),
                            pa.array(mine - starts[item[mine]], pa.int64()),
                            pa.array(length[mine], pa.int64()),
                            doc_ids.take(pa.array(doc)).cast(pa.int64()),
                            pa.array(places - shard.first[doc], pa.int64()),
                        ],
                        ["item_id", "item_word", "length", "doc_id", "doc_word"],
                    )

    return docs.select("doc_id", "text").mapInArrow(scan, MATCH_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    texts.small_batches(docs.sparkSession)
    files = test_blocks(benchmark, block_bytes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files)
        for table in texts.text_slices(batches, step=SHARD_BYTES, gather=True):
            bad = _report(table, blocks, window, share)["contaminated"]
            yield from table.filter(pa.array(~bad)).combine_chunks().to_batches()

    return docs.mapInArrow(keep, docs.schema)
