import math

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int"


def plain(rows, every=100):
    """The whole computation, pair by pair."""
    taken = []
    for k, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        taken.append((k, vec_id, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, vec_id, label, a in taken:
        if vec_id is None or vec_id % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v)), last(i), i, y) for n, i, y, v in taken if n != k)
        for s, _, i, y in [r for r in scored if r[3] == label][:5]:
            inside = [(j, -t) for t, _, j, z in scored if z != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(vec_id, i, n + 1, j, -s, t) for n, (j, t) in enumerate(inside)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, x, y, "x", 1) for i, x, y in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hn.mine_hard_negatives(df, lambda i: i % 100 == 0, **kw).collect()), key=str)


def test_equals_the_whole_computation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)) * 0.3
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 4))) for i in range(900)]
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=7)).tolist(), int(i % 2)) for i in range(60)]
    rows += [(200, [1.0, 2.0, 3.0], 1)] * 3 + [(300, [0.0] * 7, 0), (400, [], 1), (None, [1.0, 2.0, 3.0, 4.0], 0), (None, [2.0] * 7, 1)]
    rows += [(500, None, 1), (501, [None, 1.0], 1), (502, [float("nan")] * 7, 0), (503, [float("inf")] * 7, 0), (504, [1.0] * 7, None)]
    rows += [(600 + k, [0.5] * 7, k % 2) for k in range(40)] + [(600, [0.5] * 7, 0)]  # many equal vectors
    assert mined(spark, rows) == plain(rows)


def test_one_label_and_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 1.0], 1)]) == []  # no anchor
    assert mined(spark, [(100, [1.0, 2.0], 0), (2, [1.0, 1.0], 0)]) == []  # no other label
    assert mined(spark, [(100, [1e30, 2.0], 0), (1, [1e30, 1.0], 0), (2, [1e30, 1.0], 1)]) != []  # held at the limit


def test_small_steps(monkeypatch):
    """One part and one block in this process, with steps of a few rows and pairs, against all pairs."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(400, 6)) * 0.3).astype(np.int64)
    v[200:260] = v[7]  # many equal vectors
    label, books = np.arange(400) % 3, hn.fit_codebooks(v)
    codes, bound = hn.encode(v, books)
    lists = pa.array(v.tolist(), pa.list_(pa.int64()))
    table = pa.table({"row": np.arange(400), "vec_id": np.arange(400) * 5, "label": label, "v": lists, "codes": [c.tobytes() for c in codes], "bound": bound})
    dots = v @ v.T
    for step, pairs in ((2048, 1 << 15), (16, 8)):
        monkeypatch.setattr(hn, "STEP_ROWS", step)
        monkeypatch.setattr(hn, "STEP_PAIRS", pairs)
        rows, asked = hn.Rows(table, 6), table.slice(0, 40)
        best = hn.positives_of(rows, hn.Anchors(asked, books, 6), 5)
        firsts = {k: sorted((-dots[k, i], i * 5) for i in range(400) if i != k and label[i] == label[k])[:5] for k in range(40)}
        assert [(g, -s, i) for g, s, i in zip(best.group, best.score, best.vec_id)] == [(k, s, i) for k in range(40) for s, i in firsts[k]]
        windows = [[{"positive_score": int(-s)} for s, _ in firsts[k]] for k in range(40)]
        found, wide = hn.windows_of(rows, hn.Anchors(asked.append_column("windows", pa.array(windows)), books, 6), 5, 80, 100)
        want = []
        for k in range(40):
            for w, (s, _) in enumerate(firsts[k]):
                inside = sorted((-dots[k, i], i * 5) for i in range(400) if label[i] != label[k] and -80 * s <= 100 * dots[k, i] <= -100 * s)[:5]
                want += [(k * wide + w, t, i) for t, i in inside]
        assert [(g, -s, i) for g, s, i in zip(found.group, found.score, found.vec_id)] == want


@pytest.mark.parametrize("spread", [0.1, 5.0, 1e4])
def test_bounds_hold_and_filter(spread):
    rng = np.random.default_rng(4)
    v = np.floor(256 * spread * rng.normal(size=(3000, 64))).astype(np.int64)
    books = hn.fit_codebooks(v[:2000])
    codes, bound = hn.encode(v, books)
    unit = v[:50] / np.linalg.norm(v[:50], axis=1)[:, None]
    tables = np.matmul(books, unit.reshape(50, -1, hn.SUB).transpose(1, 2, 0).astype(np.float32))
    score, true = hn.look_up(tables, codes), v @ unit.T
    assert (np.abs(score - true) <= bound[:, None]).all()
    fifth = np.partition(score - bound[:, None], -5, axis=0)[-5]
    assert ((score + bound[:, None]) >= fifth).mean() < 0.1  # 0.067 of these rows go on, which have no structure at all
