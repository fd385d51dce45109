import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tandem.llm import mixing, store, url_lists, warc


def test_knapsack_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted({rng.randint(1, 30) for _ in range(rng.randint(1, 8))})
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(0, 200)
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(n * t for n, t in zip(lengths, taken)) == max(r for r in reach if r <= budget)


def test_fit_lengths_fills_the_budget():
    rng = np.random.default_rng(1)
    lengths = np.arange(0, 400)
    counts = rng.integers(0, 50, 400)
    total = int((lengths * counts).sum())
    for share in (0.1, 0.5, 0.93):
        taken = mixing.fit_lengths(lengths, counts, int(total * share), limit=2000)
        assert (taken <= counts).all() and int((lengths * taken).sum()) == int(total * share)


def targets_of(sizes):
    """The contract's targets, source by source."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if 3 * sizes[s] < weight[s] * level}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_fit_lengths_of_very_long_documents():
    lengths = np.array([99_999, 100_000, 100_001], np.int64)
    assert mixing.fit_lengths(lengths, np.ones(3, np.int64), 120_000).tolist() == [0, 0, 1]
    assert mixing.fit_lengths(lengths, np.ones(3, np.int64), 100_000).tolist() == [0, 1, 0]
    assert mixing.fit_lengths(lengths, np.ones(3, np.int64), 99_998).tolist() == [0, 0, 0]


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "é", "", None, "z"])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", None), (None, "x y", "b"), (905, "dup", "tiny"), (906, "", "a"), (906, "", "a"), (902, "v " * 30000, "z")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(5)
    got = mixing.mix_report(docs.drop("size")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets_of(sizes)
    of = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1 or s == "z" and abs(taken[s] - t) <= 30000, (s, taken[s], t)
    again = mixing.mix_report(docs.drop("size").repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in got if r["size"]}
    found = {}
    for r in mixed.filter("text is not null and trim(text) <> ''").collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {k: v for k, v in copies.items() if v}


def test_empty_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(docs).count() == 0 and mixing.mix_documents(docs).count() == 0


# --- WARC -----------------------------------------------------------------------------------------------------------------------


def test_round_trip(spark):
    big = "é" * 100000
    rows = [(3, "http://a/ b\n", "same"), (1, None, "same"), (2, "", "same"), (9, "http://x", None), (8, "u", ""), (None, "u", "same"), (None, "u", "lone"), (7, "u", big), (1, "again", "same"), (-5, "u", "neg")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    files = warc.write_warc(pages, store.shared_dir(spark, "w"))
    got = warc.read_warc(spark, files).collect()
    assert not any(r["gap"] for r in got)

    def expect(i, html):
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if same else None
        response = first is None or i == first
        return (i, len(data), warc.sha1_32(data), "response" if response else "revisit", None if response else first)

    have = sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)))
    assert have == sorted(map(str, (expect(i, h) for i, _, h in rows)))


def records(n):
    return [warc.encode_record(k, f"http://h/{k}", f"page {k} ".encode() * 20, None) for k in range(n)]


def test_salvage_after_damage():
    parts = records(6)
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + b"junk\x1f\x8b\x08junk" + parts[3] + parts[4][:-9] + parts[5]
    out = list(warc.salvage(data))
    assert [warc.page_of(r["id"]) for kind, r, _, _ in out if kind == "record"] == [0, 1, 3, 5]
    gaps = [(a, b) for kind, _, a, b in out if kind == "gap"]
    at = [0, *np.cumsum([len(parts[0]), len(parts[1]), len(broken) + 11, len(parts[3]), len(parts[4]) - 9])]
    assert gaps == [(at[2], at[3]), (at[4], at[5])]
    covered = sorted((a, b) for _, _, a, b in out)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_salvage_of_plain_archives_and_bad_digests():
    plain = [gzip.decompress(p) for p in records(3)]
    bad = plain[1].replace(b"page 1 page", b"page X page", 1)
    out = list(warc.salvage(plain[0] + bad + plain[2]))
    assert [kind for kind, *_ in out] == ["record", "gap", "record"] and "digest" in out[1][1]
    assert list(warc.salvage(b"")) == [] and next(iter(warc.salvage(b"nothing here")))[0] == "gap"


def test_sha1_is_plain_base32():
    assert warc.sha1_32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20


# --- URL lists ----------------------------------------------------------------------------------------------------------------------


def test_as_of_lists(spark):
    entries = spark.createDataFrame(
        [("domain", "Bad.com", "x", "add", "2024-01-10"), ("domain", "bad.com", "x", "remove", "2024-02-01"), ("domain", "a.bad.com", "y", "add", "2024-01-20"), ("prefix", "ok.org/p/q", "z", "add", "2024-01-01"),
         ("domain", "tie.com", "a", "add", "2024-01-05"), ("domain", "tie.com", "b", "add", "2024-01-05"), ("domain", "tie.com", "c", "remove", "2024-01-05"), (None, "n.com", "a", "add", "2024-01-01"), ("domain", "d.com", "a", "add", None)],
        "kind string, value string, category string, action string, dated string",
    )
    cases = [
        ("http://bad.com/x", "2024-01-10 00:00:00", "bad.com"), ("http://bad.com/x", "2024-01-09 23:59:59", None), ("http://bad.com", "2024-02-01 00:00:00", None),
        ("https://U:p@W.A.bad.com:80/y", "2024-01-25 00:00:00", "a.bad.com"), ("http://notbad.com", "2024-01-15 00:00:00", None), ("http://ok.org/p/q/r?x", "2024-01-15 00:00:00", "ok.org/p/q"),
        ("http://ok.org/p/qq", "2024-01-15 00:00:00", None), ("http://tie.com", "2024-01-06 00:00:00", "tie.com"), (None, "2024-01-15 00:00:00", None), ("nonsense", "2024-01-15 00:00:00", None),
        ("http://bad.com", None, None), ("http://n.com", "2024-01-15 00:00:00", None), ("http://d.com", "2024-01-15 00:00:00", None), ("http://bad.com/" + "s/" * 3000, "2024-01-15 00:00:00", "bad.com"),
    ]
    rows = [(i, u, t, w) for i, (u, t, w) in enumerate(cases)] * 2
    got = url_lists.apply_lists(spark.createDataFrame(rows, "page_id long, url string, fetched_at string, want string"), entries).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["list_value"] == r["want"] and r["blocked"] == (r["want"] is not None), r
    assert {r["list_category"] for r in got if r["list_value"] == "tie.com"} == {"b"}
    none = entries.filter("kind = 'no'")
    assert not any(r["blocked"] for r in url_lists.apply_lists(spark.createDataFrame(rows, "page_id long, url string, fetched_at string, want string"), none).collect())


def test_mix_of_repeated_rows(spark):
    rows = [(7, "a b c d e", "x", k) for k in range(100)] + [(8, "w " * 1000, "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int").repartition(3)
    got = mixing.mix_report(docs, weights=(1.0, 3.2)).collect()
    mine = [r for r in got if r["doc_id"] == 7]
    target = mine[0]["target"]
    assert len(got) == 101 and len(mine) == 100 and abs(sum(r["taken"] for r in mine) - target) < 5
    assert max(r["taken"] for r in mine) <= 15
    mixed = mixing.mix_documents(docs, weights=(1.0, 3.2))
    assert mixed.columns == docs.columns and abs(5 * mixed.filter("source = 'x'").count() - target) < 5


def test_fit_of_long_documents_is_the_best_sum():
    lengths, counts = np.array([1000, 50000, 70000]), np.array([5, 1, 3])
    assert (lengths * mixing.fit_lengths(lengths, counts, 150000)).sum() == 145000
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 70_000, 8))
        counts = rng.integers(1, 30, len(lengths))
        budget = int((lengths * counts).sum() * rng.uniform(0.05, 0.95))
        taken = mixing.fit_lengths(lengths, counts, budget)
        rest = budget - int((lengths * taken).sum())
        assert 0 <= rest and (taken <= counts).all() and rest < lengths[taken < counts].min()


def test_salvage_of_plain_archives_is_linear():
    import time

    record = gzip.decompress(warc.encode_record(1, "http://a", b"x" * 200, None))
    took = []
    for n in (4000, 16000):
        start = time.time()
        assert sum(k == "record" for k, *_ in warc.salvage(record * n)) == n
        took.append(time.time() - start)
    assert took[1] < 10 * took[0]


def test_archive_files_are_read_through_a_window(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STEP", 700)
    monkeypatch.setattr(warc, "PART", 100)
    data = bytearray(b"".join(warc.encode_record(k, "http://a", bytes([65 + k]) * 900, None) for k in range(9)))
    data[20:29] = b"?" * 9
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    got = [(k, a, b) for k, _, a, b in warc.salvage(warc.Archive.open(f"file://{tmp_path}/a.warc.gz"))]
    assert got == [(k, a, b) for k, _, a, b in warc.salvage(bytes(data))] and got[0][0] == "gap" and len(got) == 9


def test_shared_payloads_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "same" if k % 3 else None) for k in range(30)], "page_id long, url string, html string")
    want = {(r["page_id"], r["refers_to"]) for r in warc.with_roles(pages).collect()}
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    assert {(r["page_id"], r["refers_to"]) for r in warc.with_roles(pages).collect()} == want == {(k, None if k in (0, 1) else int(k % 3 > 0)) for k in range(30)}
    empty = pages.filter("page_id < 0")
    assert warc.read_warc(spark, warc.write_warc(empty, store.shared_dir(spark, "w"))).count() == 0


def test_list_values_and_clashing_columns(spark):
    entries = spark.createDataFrame([("prefix", "OK.org/Foo/", "c", "add", "2024-01-01"), ("domain", "Bad.COM.", "d", "add", "2024-01-01")], "kind string, value string, category string, action string, dated string")
    urls = ["http://ok.org/Foo/x", "http://ok.org/foo/x", "http://OK.org./Foo", "http://a.bad.com/", "http://bad.com.:80/", None]
    pages = spark.createDataFrame([(k, u, "2024-02-01 00:00:00", "mine", "p", "h") for k, u in enumerate(urls)], "page_id int, url string, fetched_at string, _path string, _best string, host string")
    got = url_lists.apply_lists(pages, entries)
    assert got.columns == ["page_id", "url", "fetched_at", "_path", "_best", "host", "blocked", "list_kind", "list_value", "list_category", "listed_since"]
    rows = got.orderBy("page_id").collect()
    assert [r["blocked"] for r in rows] == [True, False, True, True, True, False]
    assert {r["_path"] for r in rows} == {"mine"} and [r["host"] for r in rows] == ["ok.org", "ok.org", "ok.org", "a.bad.com", "bad.com", None]
    assert url_lists.apply_lists(pages.filter("page_id < 0"), entries).count() == 0
    assert url_lists.apply_lists(pages, entries.filter("kind is null")).filter("blocked").count() == 0


def test_rows_that_differ_in_another_column_only(spark):
    """Ten rows of one id and text: each is a document of its own, in the report and in the mix."""
    rows = [(1, "a b c", "s", m) for m in range(10)] + [(k, "x " * (k % 5 + 1), "t", 0) for k in range(2, 40)] + [(99, "y y", "s", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, meta int").repartition(3)
    got = mixing.mix_documents(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_documents(docs.repartition(5)).collect()))
    times, stands = Counter(map(tuple, got)), Counter(rows)
    assert set(times) <= set(stands) and all(times[r] <= 3 * stands[r] for r in times)
    size = {"a b c": 3, "y y": 2}
    taken = sum(r["taken"] for r in mixing.mix_report(docs).collect() if r["doc_id"] in (1, 99))
    assert sum(size[r["text"]] for r in got if r["source"] == "s") == taken
    one = {r[3] for r in times if r[0] == 1}
    assert len(one) >= min(10, sum(n for r, n in times.items() if r[0] == 1))


@pytest.mark.parametrize("lengths, counts, budget, best", [([40000, 30001, 7], [5, 5, 3], 150_003, 150_001), ([9_000_000, 7_000_000], [3, 3], 25_000_000, 25_000_000)])
def test_taken_documents_are_swapped_for_a_better_sum(lengths, counts, budget, best):
    lengths, counts = np.array(lengths), np.array(counts)
    taken = mixing.fit_lengths(lengths, counts, budget)
    assert (taken <= counts).all() and (lengths * taken).sum() == best
