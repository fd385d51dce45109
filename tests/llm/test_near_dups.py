import random

import numpy as np
import pytest

from tandem.llm import near_dups as nd


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, u in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
    return row[-1]


def changed(rng, a, n, fresh=99):
    b = list(a)
    for _ in range(n):
        i, kind = rng.randrange(len(b) + 1), rng.randrange(3)
        if kind == 0:
            b.insert(i, fresh)
        elif i < len(b) and kind == 1:
            b[i] = fresh
        elif i < len(b) and len(b) > 1:
            del b[i]
    return b


@pytest.mark.parametrize("often, short", [(1024, 4096), (1024, 0), (0, 0)])
def test_alignment_equals_dynamic_programming(monkeypatch, often, short):
    monkeypatch.setattr(nd._Windows, "OFTEN", often)
    monkeypatch.setattr(nd._Windows, "SHORT", short)
    rng, seen = random.Random(1), set()
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randint(1, 40))]
        b = changed(rng, a, rng.randint(0, 10))
        x, y, d = np.array(a, np.uint32), np.array(b, np.uint32), distance(a, b)
        for reach in (0, 1, 3, 8, 60):
            got = nd.banded_distance(x, y, reach)
            assert got == d if d <= reach else got > reach
        assert nd.alike(x, y) == (5 * d <= max(len(a), len(b)))
        seen.add(nd.alike(x, y))
    assert seen == {True, False}


def test_alignment_of_very_long_texts_in_small_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    x = (rng.zipf(1.3, 100_000) % 50_000).astype(np.uint32)
    y = x.copy()
    y[rng.integers(0, len(y), 20)] = 60_000
    tracemalloc.start()
    assert nd.alike(x, y)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    docs, group = [], {}
    for g in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(90, 200))]
        for k in range(rng.choice([1, 2, 6])):
            docs.append(" ".join(base if k < 2 else edited(rng, base, 1)))
            group[len(docs) - 1] = g
    for k in range(30):  # share a passage and little else: no copies
        docs.append(" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(35)]))
        group[len(docs) - 1] = 1000 + k
    return docs, group


def test_classes(spark, corpus):
    docs, group = corpus
    extra = [(900, None), (901, None), (902, ""), (903, ""), (904, "##"), (905, "two words"), (906, "Two, words!"), (907, "z " * 30000)]
    rows = [(i, t, 5) for i, t in enumerate(docs)] + [(i, t, 5) for i, t in extra] + [(900, None, 5), (0, docs[0], 5)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class_id int").repartition(4)).collect()
    assert len(got) == len(rows)
    cls = {r["doc_id"]: r["class_id"] for r in got}
    firsts = {}
    for i, g in sorted(group.items()):
        firsts.setdefault(g, i)
    assert {i: cls[i] for i in group} == {i: firsts[g] for i, g in group.items()}
    assert [cls[i] for i in range(900, 908)] == [900, 901, 902, 902, 904, 905, 905, 907]


def test_one_of_each_class_stays(spark, corpus):
    docs, group = corpus
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(0, docs[0], "en", "s", len(docs[0])), (None, docs[0], "en", "s", 1), (901, None, None, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = nd.drop_near_duplicates(d)
    assert kept.columns == d.columns
    firsts = {}
    for i, g in sorted(group.items()):
        firsts.setdefault(g, i)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*firsts.values(), 901])


def starred(seed, n_words, copies):
    """An original and copies at 0.82 of it, each with a run of words of its own, most of which are no copies of each other."""
    rng = random.Random(seed)
    base = [f"s{seed}w{i}" for i in range(n_words)]
    rows = [base]
    for _ in range(copies):
        at, own = rng.randrange(1, n_words * 4 // 5), n_words * 9 // 50
        rows.append(base[:at] + [f"new{rng.randrange(10**9)}" for _ in range(own)] + base[at + own :])
    return [" ".join(w) for w in rows]


def words_of(docs):
    import pyarrow as pa

    sign = nd.Signer(pa.chunked_array([pa.array(docs, pa.string())]))
    return [sign.words[a:b] for a, b in zip(sign.edge, sign.edge[1:])]


def brute_links(words):
    """All alike pairs by the plain table; pairs too far apart in length or words are left out."""
    codes = np.unique(np.concatenate(words), return_inverse=True)[1]
    own = [np.unique(c, return_counts=True) for c in np.split(codes, np.cumsum([len(w) for w in words])[:-1])]
    bag = np.zeros(codes.max() + 1, np.int64)
    for i, (mine, times) in enumerate(own):
        bag[mine] = times
        for j in range(i + 1, len(words)):
            short, longer = sorted((len(words[i]), len(words[j])))
            if short and 5 * (longer - short) <= longer and 5 * (longer - np.minimum(bag[own[j][0]], own[j][1]).sum()) <= longer:
                if np.array_equal(words[i], words[j]) or 5 * quick_distance(words[i], words[j]) <= longer:
                    yield i, j
        bag[mine] = 0


def quick_distance(x, y):
    """The plain table, a row at a time: the running minimum takes the step along the row."""
    at = np.arange(len(y) + 1)
    row = at.copy()
    for i, u in enumerate(x.tolist(), 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != u))
        row = np.minimum.accumulate(np.concatenate([[i], step]) - at) + at
    return int(row[-1])


def brute_classes(docs):
    first = list(range(len(docs)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, j in brute_links(words_of(docs)):
        a, b = sorted((find(i), find(j)))
        first[b] = a
    return [find(i) for i in range(len(docs))]


SF001 = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not __import__("os").path.exists(SF001), reason="no test data")
def test_recall_against_all_pairs(spark):
    """Of all alike pairs of different texts in the table, the share whose ends are in one class; and no class joins others."""
    docs = spark.read.parquet(SF001)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    cls = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs).collect()}
    words, links, parent = words_of([t for _, t in rows]), [], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in brute_links(words):
        links.append((rows[i][0], rows[j][0]))
        parent[find(rows[i][0])] = find(rows[j][0])
    found = sum(cls[a] == cls[b] for a, b in links)
    print("alike pairs", len(links), "in one class", found)
    assert len(links) > 100 and found >= 0.98 * len(links)
    texts = {i: t for i, t in rows}
    assert all(find(i) == find(c) or texts[i] == texts[c] for i, c in cls.items())


@pytest.mark.parametrize("block", [nd.BLOCK, 16])
def test_star_of_independent_copies(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    big = starred(1, 200, 600 if block == nd.BLOCK else 60)
    docs = big + starred(2, 200, 40) + starred(3, 200, 3)
    want = brute_classes(docs) if block == 16 else [0] * len(big) + [len(big)] * 41 + [len(big) + 41] * 4
    got = nd.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()
    assert [c for _, c in sorted((r["doc_id"], r["class_id"]) for r in got)] == want


def test_rows_without_an_id_are_compared(spark):
    base = [f"w{i}" for i in range(150)]
    one, two, far = base[:70] + ["x"] + base[71:], base[:90] + ["y"] + base[91:], [f"f{i}" for i in range(150)]
    d = spark.createDataFrame([(None, " ".join(t)) for t in (base, one, two, far)], "doc_id long, text string")
    assert sorted(r["class_size"] for r in nd.near_duplicates(d).collect()) == [1, 3, 3, 3]
    assert nd.drop_near_duplicates(d).count() == 2


def test_clashing_columns_and_maps(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 2, {"k": 1}), (1, text + "!", "b", 3, {"k": 2}), (2, text, "c", 4, None), (3, None, "d", 5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _node string, _id int, _kept map<string,int>")
    assert [tuple(r) for r in nd.drop_near_duplicates(d).orderBy("doc_id").collect()] == [(1, text, "a", 2, {"k": 1}), (3, None, "d", 5, None)]
    assert {(r["doc_id"], r["class_id"], r["class_size"]) for r in nd.near_duplicates(d.withColumn("root", d["doc_id"])).collect()} == {(1, 1, 3), (2, 1, 3), (3, 3, 1)}


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(d).count() == 0


@pytest.mark.parametrize("one_task", [100_000, 5])
def test_components(spark, monkeypatch, one_task):
    from tandem.llm import components as comp

    monkeypatch.setattr(comp, "ONE_TASK", one_task)
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), *[(100, 101 + k) for k in range(50)]]
    got = {r["node"]: r["root"] for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in (1, 2, 3, 4)}) == 1 and len({got[k] for k in range(100, 151)}) == 1
    assert len(set(got.values())) == 3 and 20 not in got
