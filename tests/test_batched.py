import numpy as np
import pyarrow as pa
import pytest

from tandem.operators import batched, neural

TEXTS = [["a"], [], ["b", "c", "a"], list("abcdefghij") * 3, ["c"] * 40, ["x", "y"], ["a", "b", "c", "d", "e"]]


@pytest.mark.parametrize("kind, more", [("mean", {}), ("cnn", {}), ("self_att", {}), ("dense", {}), *[(k, {"pooling": p, "both_ways": w}) for k in ("gru", "lstm") for p in ("mean", "max", "mean+max", "last") for w in (True, False)]])
def test_batches_equal_one_report_at_a_time(kind, more):
    encoder = neural.Encoder.random(kind, dims=6, seed=1, **more)
    together = batched.encode(encoder, TEXTS)
    assert np.allclose(together, [encoder(t) for t in TEXTS])
    for some in batched.batches_of(np.array([max(1, len(t)) for t in TEXTS]), cells=12):
        assert np.allclose(batched.encode(encoder, [TEXTS[k] for k in some]), together[some])


def test_batches_are_whole_and_bounded():
    lengths = np.array([5, 1, 100, 3, 3, 9])
    got = list(batched.batches_of(lengths, cells=20))
    assert sorted(np.concatenate(got).tolist()) == list(range(6))
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= 20 for b in got)


def test_scores_by_stored_vectors(spark):
    encoder, model = neural.Encoder.random("gru", dims=5, seed=2), neural.PairClassifier.random(20, 7, seed=3)
    seqs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(99, None)], "bug_id long, tokens array<string>").repartition(2)
    vectors = batched.encode_reports(seqs, encoder)
    assert {r["bug_id"]: len(r["vec"]) for r in vectors.collect()} == {**{k: 20 for k in range(len(TEXTS))}, 99: 20}
    pairs = spark.createDataFrame([(0, 1), (2, 3), (3, 2), (99, 5)], "bug1 long, bug2 long")
    got = {(r["bug1"], r["bug2"]): r["score"] for r in batched.score_vectors(pairs, vectors, model).collect()}
    vec = lambda k: encoder(TEXTS[k] if k < 99 else [])
    assert set(got) == {(0, 1), (2, 3), (3, 2), (99, 5)} and all(abs(s - model(vec(a), vec(b))) < 1e-12 for (a, b), s in got.items())


def test_long_texts_align_in_blocks(monkeypatch):
    model = neural.SoftAlignment.random(dims=4, seed=1)
    for attention in ("dot", "general", "parikh", "tan"):
        model.attention = attention
        whole = model(TEXTS[3], TEXTS[4])
        monkeypatch.setattr(neural, "ALIGN_CELLS", 50)
        assert abs(model(TEXTS[3], TEXTS[4]) - whole) < 1e-12
        monkeypatch.undo()


def test_report_scores_equal_loops(spark):
    encoder = neural.Encoder.random("cnn", dims=5, seed=4, activation="tanh")
    seqs = spark.createDataFrame(list(enumerate(TEXTS)), "bug_id long, tokens array<string>")
    codes = [(k, "ab"[k % 2] if k else None, k % 3, k * 2) for k in range(len(TEXTS))]
    reports = spark.createDataFrame(codes, "bug_id long, component string, priority long, day long")
    pairs = spark.createDataFrame([(0, 2), (2, 4), (3, 6), (1, 1)], "bug1 long, bug2 long")
    w = (1.2, 0.8, 0.5, 2.0, -1.5)
    for r in batched.score_reports(pairs, batched.encode_reports(seqs, encoder), reports, w).collect():
        (_, c1, p1, d1), (_, c2, p2, d2) = codes[r["bug1"]], codes[r["bug2"]]
        u, v = encoder(TEXTS[r["bug1"]]), encoder(TEXTS[r["bug2"]])
        z = w[0] * (c1 is not None and c1 == c2) + w[1] / (1 + abs(p1 - p2)) + w[2] / (1 + abs(d1 - d2)) + w[3] * (u @ v) / np.linalg.norm(u) / np.linalg.norm(v) + w[4]
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-12


@pytest.mark.parametrize("kind", ["cnn", "gru"])
def test_encoders_from_files(tmp_path, kind):
    encoder = neural.Encoder.random(kind, dims=4, seed=6, pooling="last", activation="tanh")
    neural.save_encoder(encoder, str(tmp_path / "e.npz"))
    again = neural.load_encoder(str(tmp_path / "e.npz"))
    assert all((again(t) == encoder(t)).all() for t in TEXTS) and again.pooling == "last"


def by_words(m, x, y):
    """The matching of x with y, one word after the other."""
    out = []
    weigh = lambda q, rows: sum(w * r for w, r in zip(neural.align(m.attention, q[None], rows, m.weights)[0], rows))
    for word in x:
        if m.matching == "none":
            out.append(word)
            continue
        context = {"mean": lambda: sum(y) / len(y), "partial_compare": lambda: weigh(sum(x) / len(x), y), "full": lambda: weigh(word, y)}[m.matching]()
        found = neural.compare(m.comparison, word[None], context[None], m.weights)[0]
        out.append(found + word if m.matching != "full" or m.residual else found)
    return np.array(out)


@pytest.mark.parametrize("matching", neural.MATCHINGS)
@pytest.mark.parametrize("aggregation", neural.AGGREGATIONS)
def test_forms_of_the_pair_model(matching, aggregation):
    m = neural.SoftAlignment.random(dims=5, seed=7, matching=matching, aggregation=aggregation, residual=True)
    x, y = (neural.word_vectors(TEXTS[k], 5).astype(np.float64) for k in (3, 2))
    if matching == "partial":
        weights = neural.align(m.attention, y.mean(axis=0)[None], x, m.weights)[0]
        assert np.allclose(m.matched(x, y), sum(w * r for w, r in zip(weights, x))[None])
    else:
        assert np.allclose(m.matched(x, y), by_words(m, x, y))
    assert 0 < m(TEXTS[3], TEXTS[2]) < 1 and abs(m(TEXTS[3], TEXTS[2]) - m(TEXTS[2], TEXTS[3])) < 1e-12
    assert 0 < m([], TEXTS[2]) < 1


def test_unknown_forms_are_errors():
    for more in ({"matching": "other"}, {"aggregation": "mean+max"}):
        m = neural.SoftAlignment.random(dims=3, seed=1, **more)
        m.aggregation = "other"
        with pytest.raises(ValueError):
            m(["a"], ["b"])


def test_pairs_of_copies_are_scored_once_for_their_texts(spark, tmp_path):
    class Counted:
        """Notes each call in a file of its own."""

        def __init__(self, folder):
            self.folder = folder

        def __call__(self, a, b):
            import uuid

            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            return float(10 * len(a) + len(b))

    seqs = spark.createDataFrame([(k, ["x"] * (1 + k // 10)) for k in range(20)], "bug_id long, tokens array<string>")
    texts = spark.createDataFrame([(k, k // 10 * 10) for k in range(20)], "bug_id long, root long")
    ids = [(a, b) for a in range(20) for b in range(a + 1, 20)]
    pairs = spark.createDataFrame(ids, "bug1 long, bug2 long")
    got = {(r["bug1"], r["bug2"]): r["score"] for r in neural.score_pairs(pairs, seqs, Counted(str(tmp_path)), texts).collect()}
    assert got == {(a, b): float(10 * (1 + a // 10) + 1 + b // 10) for a, b in ids}
    assert len(list(tmp_path.iterdir())) == 3  # pairs of texts: first, second, both


def test_many_words_have_the_vectors_of_single_ones():
    words = [f"w{k}" for k in range(neural.MANY_WORDS)] + ["", "é"]
    assert np.array_equal(neural.word_vectors(words, 5), np.concatenate([neural.word_vectors([w], 5) for w in words]))


def test_a_word_gets_its_vector_once_for_all_batches_of_a_part(monkeypatch):
    """Lists become codes; batches are small here, so the same words stand in many of them."""
    asked, whole = [], batched.word_vectors
    monkeypatch.setattr(batched, "word_vectors", lambda words, dims: asked.extend(words) or whole(words, dims))
    monkeypatch.setattr(batched, "CELLS", 12)
    encoder = neural.Encoder.random("cnn", 6, 1)
    lists = pa.array([["no"], *[list(t) for t in TEXTS] * 3, None], pa.list_(pa.string())).slice(1)
    for words in (1 << 21, 7):
        monkeypatch.setattr(batched, "WORDS", words)
        asked.clear()
        got = np.full((len(lists), 18), np.nan)
        for some, vectors in batched.encode_lists(encoder, lists):
            got[some] = vectors
        assert words == 7 or len(asked) == len(set(asked))
        assert np.allclose(got, np.concatenate([batched.encode(encoder, [t or []]) for t in lists.to_pylist()]))
