"""Connected components of a link table, without collecting it (used by near-duplicate detection)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


#: Links that one task joins at the end of the rounds.
ONE_TASK = 100_000


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of a bounded link table, by union and find."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "to"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node from undirected links (a, b); each component has one root.

    Every round maps a node to the first of itself and its neighbours, in the nodes' own order or in an order
    drawn anew for the round, and links the images. Links shrink geometrically; neighbours are never gathered,
    only their minimum is kept, so a node with very many links is one partial aggregate. Each round's tables
    are written to the shared folder, which ends their lineage. The last ONE_TASK links are joined by one task.
    """
    links = store.materialise(links.filter("a <> b").select("a", "b").distinct(), "links")
    maps, turn = [], 0
    while left_over := links.count():
        if left_over <= ONE_TASK:
            kind = links.schema["a"].dataType.simpleString()
            maps.append(store.materialise(links.coalesce(1).mapInArrow(_join_all, f"node {kind}, to {kind}"), "step"))
            break
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def rank(c: str, turn: int = turn):
            return F.struct((F.xxhash64(F.lit(turn), F.col(c)) if turn % 2 else F.lit(0).cast("long")).alias("k"), F.col(c).alias("v"))

        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = best.select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("to"))
        step = store.materialise(step, "step")
        maps.append(step)
        left = links.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a")
        moved = left.join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b").filter("x <> y")
        links = store.materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        turn += 1
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root"))

    def compose(first: DataFrame, then: DataFrame) -> DataFrame:
        nxt = then.withColumnsRenamed({"node": "root", "to": "next"})
        return first.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return reduce(compose, maps[1:], maps[0].withColumnRenamed("to", "root"))
