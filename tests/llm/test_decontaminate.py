import hashlib
import random

import numpy as np

from tandem.llm import decontaminate as dc
from tandem.llm import texts


def brute(docs, items, window, share=20):
    where = {}
    for i, t in items:
        w = texts.words_of((t or "").encode())
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            where.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = texts.words_of((t or "").encode())
        hit, found = set(), set()
        for n in {len(k) for k in where}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in where:
                    hit |= set(range(p, p + n))
                    found |= where[tuple(w[p : p + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(w)))
    return out


def test_suffix_array_sorts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        ids = rng.integers(0, 3, n).astype(np.int32)
        order = dc.suffix_array(ids, n + 1)

        def key(p):
            tail = ids[p:].tolist()
            return tail[: tail.index(0)] if 0 in tail else tail

        keys = [key(p) for p in order.tolist()]
        assert keys == sorted(keys) and sorted(order.tolist()) == np.flatnonzero(ids).tolist()


def rows(df):
    return sorted(map(str, (tuple(r)[:6] for r in df.collect())))


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, None if i == 3 else " ".join(rng.choice("abcD") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(7, "a b"), (7, "a b"), (None, "c a b a b a"), (900, ""), (901, "x " * 40000)]
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(12)] + [(20, None), (None, "d d d"), (21, "a b"), (21, "a b")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1, 1 << 20):
        got = dc.contamination_report(d, b, window=4, block_bytes=block)
        assert rows(got) == sorted(map(str, brute(docs, items, 4)))
    kept = dc.decontaminate(d, b, window=4)
    assert kept.columns == d.columns
    assert kept.count() == sum(not r[5] for r in brute(docs, items, 4))


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "q a b c d x"), (2, "a b c"), (3, "a b c d")], "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(9, "a b c d e")], "item_id long, text string")
    got = {(r["item_word"], r["length"], r["doc_id"], r["doc_word"]) for r in dc.longest_match_report(d, b, least=3).collect()}
    assert got == {(0, 4, 1, 1), (0, 4, 3, 0), (1, 3, 1, 2), (1, 3, 3, 1)}


def test_empty_tables(spark):
    d, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination_report(d, b).first()["n_hit"] == 0
    assert dc.contamination_report(none, b).count() == 0


def test_blocks_one_after_the_other(spark):
    rng = random.Random(8)
    texts_ = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    items = [(k, " ".join(texts_[k].split()[:20]) or None) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = dc.contamination_report(docs, bench), dc.contamination_report(docs, bench, block_bytes=64)
    assert len(dc.test_blocks(bench, 64)) > 5
    assert sorted(map(tuple, one.drop("item_ids").collect())) == sorted(map(tuple, many.drop("item_ids").collect()))
