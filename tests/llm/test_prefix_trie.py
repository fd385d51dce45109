import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, words int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain_arrays(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in own.items()}


def plain_trie(convs):
    """Every node by its whole prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


def trie(arrays):
    return sorted(map(tuple, pt.prefix_trie(arrays).collect()), key=str)


def random_rows(seed, convs=120, kinds=3, most=6):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c * rng.choice([1, 1, 3]), t, rng.choice(["u", "a"]), " ".join(["w"] * rng.randrange(kinds))) for t in range(rng.randrange(1, most))]
    return rows


ODD = [(5, 1, "u", "a b"), (5, None, None, None), (5, 1, "u", "a b"), (None, 0, "u", "x"), (-7, 0, "u", "long " * 50000), (-7, 2, "", "ü x\ty"), (9, 3, "u", "x"), (9, 1, "a", "y"), (6, None, "", ""), (6, 1, "u", "a b"), (6, 1, "u", "a b")]


@pytest.mark.parametrize("rows", [random_rows(1), random_rows(2, 60, 2, 9), ODD, [(c, t, "u", "same") for c in range(300) for t in range(3)]])
def test_trie_equals_the_plain_one(spark, rows):
    assert trie(pt.turn_arrays(frame(spark, rows))) == plain_trie(plain_arrays(rows))


def test_many_ranges(spark):
    """More ranges than most nodes have members, and one group that fills several."""
    rows = random_rows(3, 200, 2, 5) + [(1000 + c, t, "u", "w") for c in range(400) for t in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(pt.turn_arrays(frame(spark, rows))) == plain_trie(plain_arrays(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=14), st.lists(st.integers(0, 14), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ranges_cut_anywhere_give_the_same_nodes(convs, cuts):
    """The sweep and the stitching alone, the sorted rows cut at any places."""
    turns = {c: [("u", "w " * k) for k in x] for c, x in enumerate(convs)}
    key = lambda c: b"".join(bytes.fromhex(digest(*t)) for t in turns[c])
    order = sorted(turns, key=lambda c: (key(c), c))
    edges = sorted({0, len(order), *(k for k in cuts if k < len(order))})
    nodes, names, opened = [], {}, []
    for part, (a, b) in enumerate(zip(edges, edges[1:])):
        run = pt.Sweep(part)
        for c in order[a:b]:
            run.add(c, key(c), [len(t[1].split()) for t in turns[c]])
        run.end()
        rows = [dict(zip(pt._PART.names, r)) for r in run.out]
        nodes += [r for r in rows if not r["open"]]
        opened.append(sorted((r for r in rows if r["open"]), key=lambda r: (r["stage"], r["depth"])))
    whole = pt.Stitch()
    for rows in opened:
        whole.add(iter(rows))
    whole.end()
    names = {r["id"]: r["conv_id"] for r in nodes} | {i: r["conv_id"] for r in whole.out for i in r["ids"]}
    refs = {r["id"]: r["n_children"] for r in nodes} | {i: n for r in whole.out for i, n in zip(r["ids"], r["refs"])}
    every = nodes + whole.out
    for i, n in refs.items():
        assert n == sum(r["parent"] == i for r in every)
    got = [(r["conv_id"], r["depth"], names.get(r["parent"]), *(r[c] for c in pt.NODE[2:])) for r in every]
    assert sorted(got, key=str) == plain_trie(turns)


@pytest.mark.parametrize("rows", [random_rows(5, 90), ODD])
def test_shared_heads(spark, rows):
    own = plain_arrays(rows)
    base = lambda c: c - int(c / 20) * 20
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - base(c), [])[:h] + turns[h:]
    assert any(not t for t in want.values()) or rows is ODD
    arrays = pt.turn_arrays(frame(spark, rows), F.col("conv_id") - F.col("conv_id") % 20)
    got = pt.share_heads(arrays, F.crc32(F.col("conv_id").cast("string")) % 4, 3)
    assert {r["conv_id"]: [t["digest"] for t in r["turns"]] for r in got.collect()} == {c: [digest(*t) for t in x] for c, x in want.items()}
    assert trie(got) == plain_trie(want)


def test_texts_of_the_nodes(spark):
    df = frame(spark, ODD)
    own = plain_arrays(ODD)
    for r in pt.node_texts(pt.prefix_trie(pt.turn_arrays(df)), df).collect():
        assert (r["role"], r["text"]) == (own[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))


def test_empty_table(spark):
    assert pt.prefix_trie(pt.turn_arrays(frame(spark, []))).collect() == []
