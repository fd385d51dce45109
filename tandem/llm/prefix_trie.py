"""Prefix trie of conversations by a global sort (operator 11).

A conversation is the array of its turns' digests (16 bytes of the SHA-256 of role and text; texts are not moved). The arrays are
range-sorted over all tasks, ties by conv_id, so that members of a node stand side by side. Each task then sweeps its range
once: the longest common prefix (LCP) with the row before says which open nodes end and how many begin, and a stack holds the open ones with their
counts. A node that began and ended in the range is whole and is written; nodes on the path of the range's first row may have
begun before it, nodes on the path of its last row may go on behind it. These open stacks are a few rows for each task;
one task reads them in the order of the ranges, matches the stacks turn by turn, adds up the parts of each node and closes it.
Last, every node gets its parent's smallest member by a join which broadcasts the parents of very many children.

Balance: the sort key ends in conv_id, so a group of equal conversations is dealt over many tasks. A range holds one row
of the stack in memory for each turn of the current conversation, and the ids of one run of equal conversations. The hash over a node's
ending members is one stream by its definition; it is computed in the ranges, and only runs at the edges of a range pass
through the last task, as text of their ids.

Null conv_ids take no part. A null role or text is empty; a null turn comes first, and turns of equal number stand in the order of their
digests (equal rows are turns of their own). A conversation is one row with about 40 bytes for each turn, however long its texts. An empty
table gives no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import skew, store, texts
from .mixing import word_count

#: Bytes of a turn's digest.
WIDTH = 16
#: Rows of an output batch.
ROWS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


# --- turn arrays ----------------------------------------------------------------------------------------------


def _digest() -> Column:
    """Hex digest of (role, text); the role's length keeps them apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turn_arrays(conversations: DataFrame, family: Column | None = None) -> DataFrame:
    """(family, conv_id, turns): each conversation's turns in order, as (turn, digest, words); conversations of a
    family are dealt to one task, so that a join on the family needs no further shuffle."""
    family = F.col("conv_id") if family is None else family
    rows = conversations.filter("conv_id is not null").select(family.alias("family"), "conv_id", "turn", _digest().alias("digest"), word_count(F.col("text")).alias("words"))
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def share_heads(arrays: DataFrame, heads: Column, most: int) -> DataFrame:
    """Each conversation with its first ``heads`` turns (``most`` at most) replaced by those of the conversation whose id is
    its family; all of these if they are fewer, none if that conversation is absent."""
    first = arrays.filter("conv_id = family").select("family", F.slice("turns", 1, most).alias("head"))
    both = arrays.join(first, "family", "left").withColumn("n", heads.cast("int"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("n"))
    rest = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return both.select("family", "conv_id", F.concat(head, rest).alias("turns"))


# --- the sweep ------------------------------------------------------------------------------------------------


class Node:
    """An open node: what is known of its members and of its closed children."""

    __slots__ = ("ids", "turn", "words", "conv_id", "n_convs", "children", "leaves", "saved", "ends", "refs", "left")

    def __init__(self, ids, turn, words, conv_id, n_convs=0, children=0, leaves=0, saved=0, ends=None, refs=0, left=False):
        self.ids, self.turn, self.words, self.conv_id, self.n_convs = ids, turn, words, conv_id, n_convs
        self.children, self.leaves, self.saved, self.ends, self.refs, self.left = children, leaves, saved, ends, refs, left

    def close(self) -> None:
        """The node has all its members and children."""
        self.leaves = self.leaves or 1
        self.saved += (self.n_convs - 1) * self.words

    def adopt(self, child: "Node") -> None:
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two arrays share from the first on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    for lo in range(0, n, 1 << 16):  # the first differing block, then the byte
        x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        if x != y:
            m = min(len(x), len(y))
            return (lo + int(np.argmax(np.frombuffer(x, np.uint8, m) != np.frombuffer(y, np.uint8, m)))) // WIDTH
    return n // WIDTH


PART_SCHEMA = (
    "open boolean, part long, stage int, both boolean, id long, parent long, conv_id long, depth long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, words long, turn binary, ends_sha256 string, chunk binary"
)
_PART = pa.schema(
    [("open", pa.bool_()), ("part", pa.int64()), ("stage", pa.int32()), ("both", pa.bool_())]
    + [(c, pa.int64()) for c in ("id", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")]
    + [("turn", pa.binary()), ("ends_sha256", pa.string()), ("chunk", pa.binary())]
)
#: Order of a range's open rows: the path of its first row, the ids of the first run, the path of its last row, those of the last run.
FIRST, FIRST_RUN, LAST, LAST_RUN = range(4)


class Sweep:
    """One range: rows (conv_id, key, words) in order in, node rows out."""

    def __init__(self, part: int):
        self.part, self.next_id = part, part << 40
        self.stack: list[Node] = []
        self.opened: list[int] = []  # the row with which each open node began
        self.out: list[tuple] = []
        self.key: bytes | None = None
        self.run: list[int] = []
        self.first_run, self.n = True, 0

    def _push(self, turn: bytes, words: int, conv_id: int, left: bool) -> None:
        self.stack.append(Node(self.next_id, turn, words, conv_id, left=left))
        self.opened.append(self.n)
        self.next_id += 1

    def _row(self, node: Node, depth: int, parent, **more) -> None:
        row = {"part": self.part, "open": False, "id": node.ids, "parent": parent, "conv_id": node.conv_id, "depth": depth, "n_convs": node.n_convs, "n_children": node.children}
        row |= {"n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.ends} | more
        self.out.append(tuple(row.get(c) for c in _PART.names))

    def _pop(self, end: bool = False) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        node.n_convs = self.n - self.opened.pop()
        above = self.stack[-1] if self.stack else None
        if above:
            above.conv_id = min(above.conv_id, node.conv_id)
        if node.left or end:  # may go on beyond the range: its children so far, without open ones
            self._row(node, depth, None, open=True, stage=FIRST if node.left else LAST, both=node.left and end, words=node.words, turn=node.turn)
            return
        node.close()
        node.ends = node.ends or NOTHING
        above.adopt(node)
        self._row(node, depth, above.ids)

    def _end_run(self, last: bool) -> None:
        ids = ",".join(map(str, self.run)).encode()
        if self.first_run or last:
            stage = FIRST_RUN if self.first_run else LAST_RUN
            self.out.append(tuple({"open": True, "part": self.part, "stage": stage, "depth": 0, "chunk": ids}.get(c) for c in _PART.names))
        else:
            self.stack[-1].ends = hashlib.sha256(ids).hexdigest()
        self.first_run, self.run = False, []

    def add(self, conv_id: int, key: bytes, words: list[int]) -> None:
        if key != self.key:
            first = self.key is None
            if first:
                self._push(b"", 0, conv_id, True)
            else:
                self._end_run(False)
            same = 0 if first else common_prefix(self.key, key)
            while len(self.stack) > same + 1:
                self._pop()
            for d in range(same, len(key) // WIDTH):
                self._push(key[d * WIDTH : (d + 1) * WIDTH], words[d], conv_id, first)
            self.key = key
            self.stack[-1].conv_id = min(self.stack[-1].conv_id, conv_id)
        self.run.append(conv_id)
        self.n += 1

    def end(self) -> None:
        if self.key is not None:
            self._end_run(True)
            while self.stack:
                self._pop(end=True)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            columns = zip(*self.out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART)], schema=_PART)
            self.out = []


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for conv_id, key, words in zip(*(batch.column(k).to_pylist() for k in range(3))):
            run.add(conv_id, key, words)
            yield from run.batches(ROWS)
    run.end()
    yield from run.batches()


# --- stitching ------------------------------------------------------------------------------------------------


class Ends:
    """The hash over a node's ending members, fed in order."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def feed(self, ids: bytes) -> None:
        self.hash.update(b"," + ids if self.some else ids)
        self.some = True


class Stitch:
    """Open stacks of the ranges, in their order, in; whole nodes out."""

    def __init__(self):
        self.stack: list[Node] = []
        self.out: list[dict] = []

    def _close(self, keep: int) -> None:
        while len(self.stack) > keep:
            node = self.stack.pop()
            node.close()
            if self.stack:
                above = self.stack[-1]
                above.adopt(node)
                above.refs[0] += 1
            ends = node.ends.hash.hexdigest() if isinstance(node.ends, Ends) else node.ends
            self.out.append(
                {
                    "ids": node.ids, "refs": node.refs, "parent": self.stack[-1].ids[0] if self.stack else None, "conv_id": node.conv_id, "depth": len(self.stack),
                    "n_convs": node.n_convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": ends or NOTHING,
                }
            )

    def _push(self, r: dict) -> None:
        self.stack.append(Node([r["id"]], r["turn"], r["words"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], [r["n_children"]]))

    def _merge(self, node: Node, r: dict) -> None:
        node.ids.append(r["id"])
        node.refs.append(r["n_children"])
        node.conv_id = min(node.conv_id, r["conv_id"])
        node.n_convs += r["n_convs"]
        node.children += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        node.ends = node.ends or r["ends_sha256"]

    def _feed(self, ids: bytes) -> None:
        node = self.stack[-1]
        node.ends = node.ends or Ends()
        node.ends.feed(ids)

    def add(self, rows: Iterator[dict]) -> None:
        """The open rows of one range, in order."""
        same, stays, depth = True, 0, 0
        for r in rows:
            if r["stage"] == FIRST:
                depth = r["depth"]
                if same and depth < len(self.stack) and self.stack[depth].turn == r["turn"]:
                    self._merge(self.stack[depth], r)
                else:
                    same = False
                    self._close(depth)
                    self._push(r)
                stays = depth if r["both"] else stays
            elif r["stage"] == FIRST_RUN:
                self._close(depth + 1)
                self._feed(r["chunk"])
                self._close(stays + 1)
            elif r["stage"] == LAST:
                self._push(r)
            else:
                self._feed(r["chunk"])

    def end(self) -> None:
        self._close(0)


STITCHED = "ids array<long>, refs array<long>, parent long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_STITCHED = pa.schema(
    [("ids", pa.list_(pa.int64())), ("refs", pa.list_(pa.int64()))]
    + [(c, pa.int64()) for c in ("parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = Stitch()
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, part in groupby(rows, key=lambda r: r["part"]):
        whole.add(part)
        if len(whole.out) >= ROWS:
            yield pa.RecordBatch.from_pylist(whole.out, _STITCHED)
            whole.out = []
    whole.end()
    if whole.out:
        yield pa.RecordBatch.from_pylist(whole.out, _STITCHED)


# --- Spark ----------------------------------------------------------------------------------------------------

NODE = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """One row per node from (conv_id, turns): its smallest member, depth, its parent's smallest member, members, children, leaves
    below it, the words saved in its subtree by keeping each node once, and the hash of the members that end in it."""
    spark = arrays.sparkSession
    texts.small_batches(spark)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = store.materialise(arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "turns")
    ranges = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    path = store.shared_dir(spark, "nodes")
    ranges.mapInArrow(sweep, PART_SCHEMA).write.partitionBy("open").parquet(path)
    parts = spark.read.schema(PART_SCHEMA).parquet(path)
    closed = parts.filter("not open")
    # the open stacks: two paths for each range, however many rows it has
    edges = parts.filter("open").coalesce(1).sortWithinPartitions("part", "stage", "depth")
    stitched = store.materialise(edges.mapInArrow(stitch, STITCHED), "stitched")
    nodes = closed.select("parent", *NODE).unionByName(stitched.select("parent", *NODE))
    names = closed.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("refs"))
    pieces = stitched.select(F.col("conv_id").alias("parent_conv_id"), F.inline(F.arrays_zip("ids", "refs"))).filter("refs > 0")
    names = names.unionByName(pieces.select(F.col("ids").alias("parent"), "parent_conv_id", "refs"))
    below = skew.join_counted(nodes.filter("parent is not null"), names, ["parent"], "refs", nodes.count())
    top = nodes.filter("parent is null").select(*NODE, F.lit(None).cast("long").alias("parent_conv_id"))
    return below.select(*NODE, "parent_conv_id").unionByName(top).select("conv_id", "depth", "parent_conv_id", *NODE[2:])


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of a trie over ``conversations`` as they are, each with the role and text of its last turn (the root has none)."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    turns = conversations.filter("conv_id is not null").withColumn("digest", _digest()).withColumn("depth", F.row_number().over(order).cast("long"))
    last = turns.select("conv_id", "depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes.join(last, ["conv_id", "depth"], "left")
