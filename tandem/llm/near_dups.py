"""Near-duplicate documents by order MinHash, verified by banded alignment (operator 5).

A text is the sequence of its words (ASCII letters lower-cased, digits, non-ASCII characters); its k-mers are all
runs of five words (one run of all words in a shorter text), labelled by their occurrence. A sketch samples,
under one of ``bands`` hash orders, the smallest few labelled k-mers and keeps them in text order, so it agrees
between texts that share most k-mers in the same order. Two texts are linked if their edit similarity is at least
0.8: the least number of words inserted, deleted or replaced is at most a fifth of the longer text's words. The
alignment of the word sequences runs in the band that such an edit can use. Classes are the connected components
of the links.

Texts with equal word sequences are one node. In a bucket (texts with one sketch) every node is first compared
with one hub. Buckets whose nodes do not share their first linked node after that are dealt again by that sketch
and the next order's sketch together, with new hubs, compared only where that node differs, and at last with every
number of further orders at once. These rounds only save work. Buckets that then still
have nodes of several components are finished exactly: all their pairs across components are compared, in pairs of
bounded blocks, each pair in the first bucket that it shares. So any two texts that agree in a sketch are aligned,
fail an exact bound (lengths, common words), or are in one class already; only nodes of a bucket that belong to
different components cost the square of their number. Two texts with a share J of common k-mers in all k-mers of
both agree in one sketch with probability of about J squared, so 16 orders miss them all in 1 of 5,000 cases at
J = 0.64 (one word in 25 replaced) and in 1 of 40 at J = 0.45 (one in 12).

A null text is its own class; texts without words are classes by their exact text, so equal empty texts are
copies. Repeated rows are copies of each other. A class is named by its smallest doc_id (null where all
are null). Rows without a doc_id are compared like all others. A very long text is handled alone: its words' hashes
and an alignment that widens its band from narrow to wide; two texts of n words need about n / 40 bytes for each of the
few integers of the widest band, and of each of the words that stand in it over 1,000 times. Extra columns, of any
name and type, are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import skew, store, texts
from .components import components

K = 5
BANDS = 16
MINIMA = 2
#: The least edit similarity is 1 - 1 / EDIT_SHARE.
EDIT_SHARE = 5
#: Orders that are joined to a bucket's own in the later rounds; the last round takes all that are left at once.
ROUNDS = ([1], list(range(2, BANDS)))
#: Nodes and words of a block in the exact last step, about; and the words counted in one matrix product.
BLOCK = 1024
BLOCK_WORDS = 1 << 19
BLOCK_CODES = 1 << 12
#: Expected number of k-mers below the bound that preselects the minima.
PRESELECT = 24
_rng = np.random.default_rng(515)
_XOR = _rng.integers(0, 2**63, 64, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = tuple(int(x) * 2 + 1 for x in _rng.integers(0, 2**62, K))


def kmers(words: np.ndarray) -> np.ndarray:
    """The k-mers of one text's word hashes (uint64 values, computed from 32 bits of each word's hash)."""
    words = words.astype(np.uint64)
    n = min(K, len(words))
    if not n:
        return words
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += (words[j : j + m] + np.uint64(j + 1)) * np.uint64(_MIX[j])
    return _finish(out)


def _finish(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    return x


class Signer:
    """Word hashes, node keys and sketches of a slice of texts."""

    def __init__(self, column: pa.ChunkedArray):
        raw, offsets = texts.text_bytes(column)
        low, starts, ends, edge = texts.word_spans(raw, offsets)
        self.raw, self.offsets, self.edge = raw, offsets, edge
        self.full = texts.span_hashes(low, starts, ends)
        self.second = texts.span_hashes(low, starts, ends, 1)
        self.words = (self.full >> np.uint64(32)).astype(np.uint32)
        self.n_words = np.diff(edge)

    def nodes(self, valid: np.ndarray) -> list[bytes | None]:
        """16 bytes for each distinct word sequence (or wordless text); None for null texts."""
        both = np.column_stack([self.full, self.second])
        out = []
        for k, ok in enumerate(valid.tolist()):
            if not ok:
                out.append(None)
            elif self.n_words[k]:
                out.append(hashlib.blake2b(both[self.edge[k] : self.edge[k + 1]].tobytes(), digest_size=16).digest())
            else:
                out.append(hashlib.blake2b(b"\0" + self.raw[self.offsets[k] : self.offsets[k + 1]].tobytes(), digest_size=16).digest())
        return out

    def sketches(self) -> np.ndarray:
        """(texts, BANDS) sketch hashes; rows of texts without words are meaningless."""
        import pandas as pd

        n_texts = len(self.n_words)
        n = np.where(self.n_words >= K, self.n_words - K + 1, np.minimum(self.n_words, 1))
        at = np.cumsum(n) - n
        total = int(n.sum())
        out = np.zeros((n_texts, BANDS), np.uint64)
        if not total:
            return out
        owner = np.repeat(np.arange(n_texts), n)
        place = np.arange(total) - at[owner]
        first = self.edge[:-1][owner] + place
        wide = self.words.astype(np.uint64)
        mers = np.zeros(total, np.uint64)
        length = np.minimum(self.n_words, K)[owner]
        for j in range(K):
            ok = length > j
            if ok.all():
                mers += (wide[first + j] + np.uint64(j + 1)) * np.uint64(_MIX[j])
            else:
                mers[ok] += (wide[first[ok] + j] + np.uint64(j + 1)) * np.uint64(_MIX[j])
        mers = _finish(mers)
        # the label: how often the k-mer stood in the text before
        twice = pd.Series(mers ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated(keep=False).to_numpy()
        if twice.any():
            some = np.flatnonzero(twice)
            nth = pd.DataFrame({"o": owner[some], "m": mers[some]}).groupby(["o", "m"], sort=False).cumcount().to_numpy()
            mers[some] = _finish(mers[some] + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        bound = np.where(n > 2 * PRESELECT, (PRESELECT / np.maximum(n, 1)) * 2.0**64, 2.0**64 - 4096).astype(np.uint64)
        near = bound[owner]
        want = np.minimum(n, MINIMA)
        for band in range(BANDS):
            value = (mers ^ _XOR[band]) * _ODD[band]
            value ^= value >> np.uint64(32)
            picked = np.flatnonzero(value <= near)
            count = np.bincount(owner[picked], minlength=n_texts)
            short = np.flatnonzero(count < want)
            if len(short):  # too few below the bound: take all of these texts
                extra = np.concatenate([np.arange(at[k], at[k] + n[k]) for k in short])
                picked = np.union1d(picked, extra)
            order = picked[np.lexsort((value[picked], owner[picked]))]
            who = owner[order]
            start = np.searchsorted(who, np.arange(n_texts))
            rank = np.arange(len(order)) - start[who]
            best = np.sort(order[rank < MINIMA])  # by place: text order again
            who = owner[best]
            nth = np.arange(len(best)) - np.searchsorted(who, np.arange(n_texts))[who]
            key = np.zeros(n_texts, np.uint64)
            np.add.at(key, who, mers[best] * np.uint64(2) ** nth.astype(np.uint64) * np.uint64(_MIX[0]) + nth.astype(np.uint64) * np.uint64(_MIX[1]))
            out[:, band] = _finish(key)
        return out


def most_edits(n: int, m: int) -> int:
    """The edits that two texts of n and m words may be apart."""
    return max(n, m) // EDIT_SHARE


class _Windows:
    """The places of each word of ``y`` inside a window that moves forward, as the bits of an integer."""

    #: Words that stand more often keep the window's bits from row to row; rarer ones are set anew.
    OFTEN = 1024
    #: Texts of up to so many words have all places of a word as one integer.
    SHORT = 4096

    def __init__(self, y: np.ndarray, reach: int):
        self.width = 2 * reach + 1
        self.whole = None
        if len(y) <= self.SHORT:
            self.whole, self.every = {}, (1 << self.width) - 1
            for j, word in enumerate(y.tolist()):
                self.whole[word] = self.whole.get(word, 0) | 1 << j
            return
        order = np.argsort(y, kind="stable")
        words = y[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(y) else np.zeros(0, np.int64)
        self.places = dict(zip(words[first].tolist(), np.split(order, first[1:]))) if len(y) else {}
        self.bits: dict[int, tuple[int, int, int]] = {}  # word: window start, places used, bits

    def at(self, word: int, start: int) -> int:
        """Bit b is set where ``word`` stands at place start + b of y, inside the window."""
        if self.whole is not None:
            bits = self.whole.get(word)
            return bits >> start & self.every if bits else 0
        places = self.places.get(word)
        if places is None:
            return 0
        if len(places) > self.OFTEN:
            was, used, bits = self.bits.get(word, (start, int(np.searchsorted(places, start)), 0))
            bits >>= start - was
            upto = int(np.searchsorted(places, start + self.width))
            if upto > used:
                bits |= self._set(places[max(used, int(np.searchsorted(places, start))) : upto] - start)
            self.bits[word] = start, upto, bits
            return bits
        lo, hi = (0, len(places)) if len(places) < 4 else np.searchsorted(places, [start, start + self.width])
        return self._set([p for p in (places[lo:hi] - start).tolist() if 0 <= p < self.width])

    @staticmethod
    def _set(bits) -> int:
        if len(bits) < 32:
            out = 0
            for b in bits:
                out |= 1 << int(b)
            return out
        flags = np.zeros(int(bits[-1]) + 1, np.uint8)
        flags[bits] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def banded_distance(x: np.ndarray, y: np.ndarray, reach: int) -> int:
    """Edit distance of two word sequences if it is at most ``reach``, else a number above ``reach``.

    One row for each word of x. Bit b of the integers is the cell at place i + b - reach of y, so the band
    stands still while the rows move; ``up`` and ``down`` are the cells that are one more, or one less, than
    the cell before them in the column. The end's diagonal never falls, so it ends the search early.
    """
    n, m = len(x), len(y)
    if abs(n - m) > reach:
        return reach + 1
    windows = _Windows(y, reach)
    every = (1 << (2 * reach + 1)) - 1
    top = 1 << (2 * reach)
    goal = m - n + reach
    up, down = every ^ ((1 << (reach + 1)) - 1) | 1 << reach, 0
    up &= every
    away = max(m - n, 0)
    for i, word in enumerate(x.tolist()):
        start = i - reach  # of the window, in places of y from 0
        same = windows.at(word, max(start, 0))
        if start < 0:
            same = same << -start & every
        flat = (((same & up) + up) ^ up) | same | down
        flat &= every
        more, less = down | every & ~(flat | up), flat & up
        if not flat >> goal & 1:
            away += 1
            if away > reach:
                return away
        shifted = flat >> 1
        up = less | every & ~(shifted | more) | top
        down = shifted & more & ~top
    return away


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two texts' word hashes have edit similarity of 0.8 or more.

    Equal ends are cut off, the words in common bound the distance from below, and the band grows from narrow to
    the widest that counts."""
    most = most_edits(len(x), len(y))
    if abs(len(x) - len(y)) > most:
        return False
    m = min(len(x), len(y))
    differ = np.flatnonzero(x[:m] != y[:m])
    head = int(differ[0]) if len(differ) else m
    x, y, m = x[head:], y[head:], m - head
    differ = np.flatnonzero(x[::-1][:m] != y[::-1][:m])
    tail = int(differ[0]) if len(differ) else m
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    longer = max(len(x), len(y))
    if longer <= most:
        return True
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(cx[ix], cy[iy]).sum()) > most:
        return False
    reach = max(32, abs(len(x) - len(y)))
    while True:
        reach = min(reach, most)
        if banded_distance(x, y, reach) <= reach:
            return True
        if reach == most:
            return False
        reach *= 4


def common_words(words: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) numbers of common words, each counted as often as both texts have it."""
    import pandas as pd

    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    rows = pd.DataFrame({"o": owner, "m": np.concatenate(words)})
    nth = rows.groupby(["o", "m"], sort=False).cumcount().to_numpy()
    code = rows.assign(nth=nth).groupby(["m", "nth"], sort=False).ngroup().to_numpy()
    shared = np.bincount(code) > 1
    owner, code = owner[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(shared.sum()), BLOCK_CODES):
        a, b = np.searchsorted(code, [lo, lo + BLOCK_CODES])
        has = np.zeros((len(words), BLOCK_CODES), np.float32)
        has[owner[a:b], code[a:b] - lo] = 1
        total += (has[left] @ has[right].T).astype(np.int64)
    return total


def block_links(words: list[np.ndarray], roots: list[bytes], sketches: np.ndarray, band: int, n_left: int) -> list[tuple[bytes, bytes]]:
    """Links of roots that join all alike texts across the first ``n_left`` texts and the others (among
    themselves where there are no others), of the pairs whose first common sketch is that of ``band``."""
    alone = n_left == len(words)
    left = np.arange(n_left)
    right = left if alone else np.arange(n_left, len(words))
    _, root = np.unique(np.array(roots, object), return_inverse=True)
    open_ = root[left][:, None] != root[right][None, :]
    if alone:
        open_ &= left[:, None] < right[None, :]
    for b in range(band):
        open_ &= sketches[left, b][:, None] != sketches[right, b][None, :]
    if not open_.any():
        return []
    n = np.array([len(w) for w in words])
    longer = np.maximum(n[left][:, None], n[right][None, :])
    open_ &= np.abs(n[left][:, None] - n[right][None, :]) <= longer // EDIT_SHARE
    if not open_.any():
        return []
    common = common_words(words, left, right)
    i, j = np.nonzero(open_ & (longer - common <= longer // EDIT_SHARE))
    best = np.argsort(-common[i, j] / longer[i, j], kind="stable")
    parent, out = list(range(int(root.max()) + 1)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left[i[best]].tolist(), right[j[best]].tolist()):
        x, y = find(root[a]), find(root[b])
        if x != y and alike(words[a], words[b]):
            parent[x] = y
            out.append((roots[a], roots[b]))
    return out


# --- Spark ----------------------------------------------------------------------------------------------------


def _with_nodes(docs: DataFrame, sketch: bool, name: str = "_node") -> DataFrame:
    """docs with the node as column ``name``, less rows that repeat an id and words inside a slice (of these the row
    with the first text stays); with ``sketch`` all rows as (doc_id, _node, _n, _sketch)."""
    texts.small_batches(docs.sparkSession)
    if sketch:
        schema = "doc_id long, _node binary, _n long, _sketch array<long>"
        docs = docs.select("doc_id", "text")
    else:
        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType(), True)])
    names = [*docs.columns, name]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in texts.text_slices(batches):
            sign = Signer(table["text"])
            keys = sign.nodes(np.asarray(table["text"].is_valid()))
            nodes = pa.array(keys, pa.binary())
            if sketch:
                flat = sign.sketches().view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), nodes, pa.array(sign.n_words, pa.int64()), lists], ["doc_id", "_node", "_n", "_sketch"])
            else:
                columns = [c.combine_chunks() for c in table.columns]
                batch = pa.RecordBatch.from_arrays([*columns, nodes], names)
                yield batch.take(pa.array(_first_of_each(table["doc_id"].to_pylist(), keys, table["text"]), pa.int64()))

    return docs.mapInArrow(scan, schema)


def _first_of_each(ids: list, keys: list, column: pa.ChunkedArray) -> list[int]:
    """Places of the rows to keep: of those with one id and node the first by text."""
    best: dict = {}
    for k, key in enumerate(zip(ids, keys)):
        if key not in best:
            best[key] = k
        elif key[1] is not None and column[k].as_py() < column[best[key]].as_py():
            best[key] = k
    return sorted(k for key, k in best.items() if key[1] is not None)


def _stars(members: DataFrame, by: list[str], turn: int) -> DataFrame:
    """(by..., node, n, root, hub, hub_n, hub_root): each member of a bucket of two or more with the bucket's
    hub, the first node in the order of this turn. ``members`` is a written table."""
    order = (F.xxhash64(F.lit(turn), "node") if turn else F.lit(0).cast("long")).alias("k")
    hubs = members.groupBy(*by).agg(F.min(F.struct(order, "node", "n", "root")).alias("h"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = store.materialise(hubs.select(*by, F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.root").alias("hub_root"), "size"), "hubs")
    return skew.join_counted(members, hubs, by, "size", members.count()).drop("size")


#: Pairs of one hub that meet its words in one task.
HUB_PAIRS = 1000


def _verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(node, hub, ok) of distinct pairs. A hub's words are sent to several tasks if it has very many pairs."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            ok = [alike(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["node", "hub", "ok"])

    hubs = store.materialise(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("size")), "hubs")
    parts = F.ceil(F.col("size") / HUB_PAIRS)
    dealt = skew.join_counted(pairs, hubs, ["hub"], "size", pairs.count()).select("node", "hub", F.pmod(F.xxhash64("node"), parts).alias("part"))
    wide = words.withColumnsRenamed({"node": "hub", "words": "wb"}).join(hubs, "hub")
    wide = wide.select("hub", "wb", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    left = dealt.join(words.withColumnRenamed("words", "wa"), "node")
    both = left.join(wide, ["hub", "part"]).select("node", "hub", "wa", "wb")
    return both.mapInArrow(check, "node binary, hub binary, ok boolean")


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the wanted nodes: the words' hashes. Texts are read by doc_id, and all rows without one."""
    texts.small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in texts.text_slices(batches):
            sign = Signer(table["text"])
            nodes = sign.nodes(np.asarray(table["text"].is_valid()))
            words = [sign.words[a:b].astype("<u4").tobytes() for a, b in zip(sign.edge, sign.edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(words, pa.binary())], ["_node", "words"])

    rows = docs.select("doc_id", "text")
    few = rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(rows.filter("doc_id is null and text is not null"))
    found = few.mapInArrow(scan, "_node binary, words binary").withColumnRenamed("_node", "node")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])  # equal nodes have equal words


def node_roots(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, root) of every node with a verified link."""
    nodes = signed.filter("_n > 0").groupBy("_node").agg(F.min("doc_id").alias("doc_id"), F.first("_n").alias("n"), F.first("_sketch").alias("sketch"))
    nodes = store.materialise(nodes.withColumnRenamed("_node", "node"), "nodes")
    by = ["band", "key"]
    members = store.materialise(nodes.select("node", "n", F.col("node").alias("root"), F.posexplode("sketch").alias("band", "key")), "members")
    first = stars = store.materialise(_stars(members, by, 0), "stars")
    near = F.abs(F.col("n") - F.col("hub_n")) <= F.floor(F.greatest("n", "hub_n") / EDIT_SHARE)
    across = F.col("root") != F.col("hub_root")

    def pairs_of(stars: DataFrame) -> DataFrame:
        return stars.filter(across & near).select("node", "hub").distinct()

    pairs = store.materialise(pairs_of(stars), "pairs")
    # later turns pair nodes of the buckets that stay open: fetch the words of all that share a bucket
    shared = stars.select("node").distinct()
    words = store.materialise(_words_of(docs, nodes.join(shared, "node", "left_semi").select("doc_id", "node")), "words")
    checked = store.materialise(_verify(pairs, words), "checked")
    for levels in ROUNDS:
        ok = checked.filter("ok")
        both = ok.select("node", "hub").unionByName(ok.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
        near_root = both.groupBy("node").agg(F.min("hub").alias("h")).select("node", F.least("node", "h").alias("root"))
        buckets = store.materialise(stars.select(*by, "node", "n").join(near_root, "node", "left").withColumn("root", F.coalesce("root", "node")), "buckets")
        still = buckets.groupBy(*by).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).filter("r0 <> r1 and size > 2").select(*by)
        again = buckets.join(still, by, "left_semi").join(nodes.select("node", "sketch"), "node")
        # the key of level t joins the next t orders' sketches to the bucket's own
        own = F.transform(F.sequence(F.lit(levels[0]), F.lit(levels[-1])), lambda t: F.element_at("sketch", (F.pmod(F.col("band") + t, F.lit(BANDS)) + 1).cast("int")))
        steps = F.transform(F.sequence(F.lit(1), F.lit(len(levels))), lambda k: F.xxhash64("key", F.slice(own, 1, k)))
        again = again.select("node", "n", "root", F.col("band"), F.posexplode(steps).alias("step", "key"))
        again = store.materialise(again.withColumn("band", F.col("band") + BANDS * F.col("step")), "again")
        if not again.limit(1).count():
            break
        stars = store.materialise(_stars(again, by, levels[0]), "stars")
        new = pairs_of(stars).join(checked.select("node", "hub"), ["node", "hub"], "left_anti")
        checked = checked.unionByName(store.materialise(_verify(new, words), "checked"))
        stars = stars.withColumn("band", F.pmod("band", F.lit(BANDS)))
    roots = store.materialise(components(_linked(checked)), "linked")
    return _finish_buckets(first.select(*by, "node", "n"), nodes.select("node", "sketch"), words, roots)


def _finish_buckets(members: DataFrame, sketches: DataFrame, words: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` (node, root) after all pairs of a bucket (band, key) that are in different components are compared.

    A component with a block or more of a bucket's nodes has blocks of its own there, which are not paired with
    each other; all others of the bucket share its mixed blocks (``own`` empty). Blocks are cut in the order of the texts'
    lengths, so most buckets are one block, whose nodes are sent once, and blocks of large buckets are paired only where
    their lengths allow an alike pair. Cuts come from the counts of each length; texts of one length are dealt by hash."""
    by = ["band", "key"]
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = store.materialise(rooted, "rooted")
    still = rooted.groupBy(*by).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).filter("r0 <> r1 and size > 2")
    rest = store.materialise(rooted.join(still.select(*by), by, "left_semi"), "rest")
    if not rest.limit(1).count():
        return roots
    groups = rest.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    groups = groups.withColumn("own", F.when((F.col("c") >= BLOCK) | (F.col("w") >= BLOCK_WORDS), F.col("root")).otherwise(F.lit(b"")))
    rest = store.materialise(rest.join(groups.select(*by, "root", "own"), [*by, "root"]), "owned")
    # blocks are filled in the order of lengths: the share of a block that the texts before a length have filled
    share = F.greatest(F.lit(1.0 / BLOCK), F.col("n") / F.lit(float(BLOCK_WORDS))) * F.col("size")
    upto = F.sum("share").over(Window.partitionBy(*by, "own").orderBy("n"))  # a row for each length
    lengths = rest.groupBy(*by, "own", "n").agg(F.count(F.lit(1)).alias("size")).withColumn("share", share).withColumn("upto", upto)
    first = F.floor(F.greatest(F.col("upto") - F.col("share"), F.lit(0.0)) + 1e-9)
    last = F.greatest(first, F.ceil(F.col("upto") - 1e-9) - 1)
    lengths = store.materialise(lengths.select(*by, "own", "n", "size", first.alias("first"), last.alias("last")), "lengths")
    place = ["own", "no"]
    dealt = skew.join_counted(rest, lengths, [*by, "own", "n"], "size", rest.count())
    dealt = dealt.select(*by, "own", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("last") - F.col("first") + 1)).alias("no"), "node", "root")

    every = lengths.select(*by, "own", "n", F.explode(F.sequence("first", "last")).alias("no"))
    every = every.groupBy(*by, *place).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = every.withColumnsRenamed({c: f"{c}2" for c in (*place, "least", "most")})
    units = every.join(other, by).filter("own < own2 or (own = own2 and own = X'' and no <= no2)")
    high, low = F.greatest("least", "least2"), F.least("most", "most2")  # where the ranges lie apart, the nearest lengths
    units = units.filter(high - low <= F.floor(high / EDIT_SHARE))
    units = store.materialise(units.withColumn("unit", F.monotonically_increasing_id()), "units")
    one = units.select(*by, *place, "unit", F.lit(0).alias("side"))
    two = units.filter("own <> own2 or no <> no2").select(*by, *[F.col(f"{c}2").alias(c) for c in place], "unit", F.lit(1).alias("side"))
    sent = dealt.join(one.unionByName(two), [*by, *place]).select("unit", "side", "band", "node", "root")
    sent = sent.join(sketches, "node").join(words, "node").select("unit", "side", "band", "root", "sketch", "words")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("side").combine_chunks()
        own = [np.frombuffer(x.as_buffer(), "<u4") for x in table["words"]]
        sketch = np.array(table["sketch"].to_pylist(), np.int64)
        n_left = int((table["side"].to_numpy() == 0).sum())
        links = block_links(own, table["root"].to_pylist(), sketch, table["band"][0].as_py(), n_left) if n_left else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    more = components(sent.groupBy("unit").applyInArrow(compare, "a binary, b binary"))
    more = more.select(F.col("node").alias("root"), F.col("root").alias("next"))
    old = roots.join(more, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    new = more.select(F.col("root").alias("node"), F.col("next").alias("root")).join(roots, "node", "left_anti")
    return old.unionByName(new)


def _linked(checked: DataFrame) -> DataFrame:
    return checked.filter("ok").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, _node) of every document, and (_node, copies, root) of every node. Null texts have no node."""
    signed = store.materialise(_with_nodes(docs, True), "signed")
    roots = store.materialise(node_roots(docs, signed), "roots").withColumnRenamed("node", "_node")
    copies = signed.filter("_node is not null").groupBy("_node").agg(F.count(F.lit(1)).alias("copies"))
    rooted = copies.join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    return signed.select("doc_id", "_node"), store.materialise(rooted, "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size."""
    rows, nodes = _classes(docs)
    total = rows.count()
    least = rows.filter("_node is not null").groupBy("_node").agg(F.min("doc_id").alias("least"))
    named = store.materialise(nodes.join(least, "_node"), "named")
    sizes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("nodes"))
    of_node = skew.join_counted(named.select("_node", "copies", "root"), store.materialise(sizes, "sizes"), ["root"], "nodes", named.count())
    of_node = store.materialise(of_node.select("_node", "copies", "class_id", "class_size"), "classes")
    found = skew.join_counted(rows.filter("_node is not null"), of_node, ["_node"], "copies", total).select("doc_id", "class_id", "class_size")
    alone = rows.filter("_node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest doc_id (null last); null texts stay.

    Of rows that agree in id and words the one with the first text stays, by the other columns' hash where texts agree
    too (maps aside)."""
    rows, nodes = _classes(docs)
    ids = rows.filter("_node is not null").groupBy("_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("k"))
    first = ids.join(nodes, "_node").groupBy("root").agg(F.min(F.struct("k", "_node")).alias("f"))
    kept = store.materialise(first.select(F.col("f._node").alias("node"), F.col("f.k.doc_id").alias("doc_id")), "kept")
    place = f"row_{secrets.token_hex(8)}"  # names no column of the caller's
    noded = _with_nodes(docs, False, place)
    key = kept.withColumnsRenamed({"node": f"{place}_node", "doc_id": f"{place}_id"})
    same = (F.col(f"{place}_node") == F.col(place)) & F.col(f"{place}_id").eqNullSafe(noded["doc_id"])
    mine = noded.filter(F.col(place).isNotNull()).join(key, same, "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy(place, "doc_id").orderBy("text", F.xxhash64(*plain)))
    once = mine.withColumn(f"{place}_nth", nth).filter(F.col(f"{place}_nth") == 1)
    every = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*every).unionByName(docs.filter("text is null"))
