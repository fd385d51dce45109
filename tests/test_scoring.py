import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions.draws import draw
from tandem.operators import evaluation, metrics, neural, pairs, ranking, scoring, topics
from tandem.sources.shared import written


def test_bm25f_by_hand(spark):
    terms = "bug_id long, n int, token string, tf_sum long, tf_desc long, len_sum long, len_desc long"
    docs = spark.createDataFrame([(2, 1, "t", 1, 1, 1, 1)], terms)
    q = spark.createDataFrame([(1, 1, "t", 1, 0, 1, 1)], terms)
    idf = spark.createDataFrame([(1, "t", 2.0)], "n int, token string, idf double")
    avg = spark.createDataFrame([(1, 1.0, 1.0)], "n int, avg_sum double, avg_desc double")
    w = scoring.Bm25fWeights(w_sum=2, w_desc=1, b_sum=0, b_desc=0, k1=1, k3=0)
    got = scoring.bm25f_ext(q, docs, idf, avg, uni=w, bi=w, w_uni=1, w_bi=1).first()
    assert got["score"] == pytest.approx(1.5)


def test_rep_extras(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1, 1, 1)], "bug_id long, product string, component string, severity int, version int, priority int").alias("q")
    other = spark.createDataFrame([(2, "a", "y", 2, 2, 4)], "bug_id long, product string, component string, severity int, version int, priority int").alias("c")
    w = scoring.RepWeights(component=1, sub_component=1, report_type=1, version=1, priority=1)
    assert rows.crossJoin(other).select(scoring.rep_extras(w).alias("s")).first()["s"] == pytest.approx(1.75)


def test_losses(spark):
    d = spark.range(1)

    def value(c):
        return d.select(c.cast("double").alias("x")).first()["x"]

    assert value(scoring.cosine_loss(F.lit(0.9), F.lit(1), 0.2)) == pytest.approx(0.1)
    assert value(scoring.cosine_loss(F.lit(0.5), F.lit(0), 0.2)) == pytest.approx(0.3)
    assert value(scoring.contrastive_loss(F.lit(0.4), F.lit(0), 0.3)) == pytest.approx(0.16)
    assert value(scoring.triplet_loss(F.lit(0.6), F.lit(0.55), 0.1)) == pytest.approx(0.05)


def test_first_hit_grouped_and_not(spark):
    ranked = spark.createDataFrame([(1, 1, "A", False), (1, 2, "A", False), (1, 3, "B", False), (1, 4, "T", True)], "anchor long, rank int, master string, is_dup boolean")
    assert ranking.first_hit(ranked).first()["pos"] == 3
    assert ranking.first_hit(ranked, grouped=False).first()["pos"] == 4
    anchors = spark.createDataFrame([(1,), (2,)], "anchor long")
    hits = spark.createDataFrame([(1, 1)], "anchor long, pos int")
    assert metrics.mean_reciprocal_rank(anchors, hits).first()["map"] == 0.5


def test_confusion(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "y int, p int")
    m = metrics.binary_metrics(d, "y", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.6, 0.5, 0.5)
    iou = {r["cls"]: r["iou"] for r in metrics.class_metrics(metrics.confusion(d, "y", "p")).collect()}
    assert iou[1] == pytest.approx(1 / 3)


def test_pair_key_is_numeric(spark):
    assert spark.range(1).select(pairs.pair_key(F.lit(10), F.lit(9)).alias("k")).first()["k"] == "9|10"


def test_mixture_rates(spark):
    with pytest.raises(ValueError):
        pairs.mixture([(spark.range(1), 0.5)])


def test_neural_forward_passes():
    for kind in ("mean", "cnn", "lstm", "gru", "self_att", "dense"):
        v = neural.Encoder.random(kind, dims=6, seed=1)(["a", "b", "c"])
        assert np.isfinite(v).all() and v.ndim == 1
    for att in ("dot", "general", "parikh", "tan"):
        for cmp in ("nn", "submult_nn"):
            s = neural.SoftAlignment.random(dims=6, seed=1, attention=att, comparison=cmp)
            assert 0 <= s(["a", "b"], ["b", "c"]) <= 1 and s(["a"], ["b", "c"]) == pytest.approx(s(["b", "c"], ["a"]))
    w = neural.align("dot", np.ones((2, 3)), np.ones((4, 3)), {}, mask=np.array([[True, True, False, False]] * 2))
    assert np.allclose(w[:, :2], 0.5) and np.allclose(w[:, 2:], 0)


def test_duplicate_topics_separate_words():
    docs = [[0, 1, 0, 1] * 4, [0, 1, 1] * 4, [2, 3, 2, 3] * 4, [3, 2, 2] * 4]
    m = topics.DuplicateTopics(2, alpha=0.1, seed=3).fit(docs, [0, 0, 1, 1], 4, sweeps=60)
    assert m.theta[0].argmax() != m.theta[1].argmax() and m.theta.max(axis=1).min() > 0.8


def test_sweeps_over_all_postings_separate_words(spark):
    docs = [[0, 1, 0, 1] * 4, [0, 1, 1] * 4, [2, 3, 2, 3] * 4, [3, 2, 2] * 4]
    rows = [(i, i // 2, f"w{w}", d.count(w)) for i, d in enumerate(docs) for w in set(d)]
    df = spark.createDataFrame(rows, "bug_id long, root long, token string, tf long")
    state = topics.start_topics(df, 2)
    before = topics.log_likelihood(state, 2, 0.1)
    for n in range(1, 11):  # counts are kept by every sweep
        state = written(topics.sweep(state, 2, 4, n, 0.1, 0.01), "state")
        assert sorted((r["bug_id"], r["token"], r["k0"] + r["k1"]) for r in state.collect()) == sorted((i, w, n_) for i, _, w, n_ in rows)
    assert topics.log_likelihood(state, 2, 0.1) > before
    mixed = {r["root"]: r["theta0"] for r in topics.set_mixtures(state, 2, 0.1).collect()}
    assert abs(mixed[0] - mixed[1]) > 0.8
    new = spark.createDataFrame([(9, "w2", 4), (9, "w3", 4), (8, "other", 2)], "bug_id long, token string, tf long")
    theta = {r["bug_id"]: r["theta0"] for r in topics.infer_topics(new, topics.topic_words(state, 2), 2, 10, 0.1).collect()}
    assert abs(theta[9] - mixed[1]) < 0.1 and theta[8] == 0.5


def test_topics_of_an_empty_table(spark):
    none = spark.createDataFrame([], "bug_id long, root long, token string, tf long")
    state = topics.fit_duplicate_topics(none, 2, 2)
    assert state.collect() == [] == topics.set_mixtures(state, 2).collect() == topics.infer_topics(none, topics.topic_words(state, 2), 2, 2).collect()


def test_a_ranking_run_counts_what_it_did(spark):
    rows = [(1, 10, 100, False, 0.9), (1, 11, 101, True, 0.8), (1, 12, 100, False, 0.7), (2, 10, 100, True, 0.5), (3, 10, 100, False, 0.5)]
    scored = spark.createDataFrame(rows, "anchor long, cand long, master long, is_dup boolean, score double")
    anchors = spark.createDataFrame([(1,), (2,), (3,), (4,)], "anchor long")
    record, done = evaluation.run_ranking(anchors, scored, ks=range(1, 3), label="x")
    got = {(r["name"], r["k"]): (r["value"], r["n_hits"], r["n_queries"]) for r in record.collect()}
    assert got == {("recall_rate_x", 1): (0.25, 1, 4), ("recall_rate_x", 2): (0.5, 2, 4), ("MAP_x", 0): (0.375, 2, 4)}
    assert (done.label, done.queries, done.candidates) == ("x", 4, 5) and done.seconds > 0 and done.queries_per_second > 0
    record, done = evaluation.run_ranking(anchors.limit(0), scored)
    assert done.queries == 0 and done.candidates == 5 and all(r["n_queries"] == 0 for r in record.collect())


def test_a_sweep_of_weights_meets_each_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(c), float(rng.integers(0, 3)) / 2, float(rng.integers(1, 3)) / 2, bool(rng.random() < 0.2)) for a in range(6) for c in rng.permutation(40)]
    df = spark.createDataFrame(rows, "anchor long, cand long, a double, b double, is_dup boolean")
    want = {}
    for i in range(11):
        want[i / 10] = 0.0
        for anchor in range(6):
            order = sorted(((-round(i / 10 * a + (1 - i / 10) * b, 9), c, d) for x, c, a, b, d in rows if x == anchor))
            want[i / 10] += 1 / (1 + [d for *_, d in order].index(True))
    got = {r["alpha"]: r["total"] for r in scoring.alpha_sweep(df, 10).collect()}
    assert got == pytest.approx(want)
    plan = scoring.alpha_sweep(df, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "below" in plan and plan.index("Generate") < plan.index("AS below")  # weights are spread over counts, above the pairs' own aggregate


def test_occurrences_are_dealt_by_the_numbers_of_draw(spark):
    rows = [(1, 1, "a|b", 3), (20, 1, "é", 1), (20, 1, "x", 40)]
    df = spark.createDataFrame(rows, "bug_id long, root long, token string, tf long")
    dealt = topics.start_topics(df, 3)
    assert "MapInArrow" in dealt._jdf.queryExecution().executedPlan().toString()
    each = df.select("bug_id", "token", F.explode(F.sequence(F.lit(0), F.col("tf").cast("int") - 1)).alias("j"))
    each = each.withColumn("k", F.pmod(draw("bug_id", "token", "j", seed=0), F.lit(3)))
    want = sorted((r["bug_id"], r["token"], r["k"], r["count"]) for r in each.groupBy("bug_id", "token", "k").count().collect())
    assert sorted((r["bug_id"], r["token"], k, r[f"k{k}"]) for r in dealt.collect() for k in range(3) if r[f"k{k}"]) == want


def test_rounds_of_inference_write_no_table(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "bug_id long, token string, tf long")
    words = spark.createDataFrame([("a", 0.7, 0.1), ("b", 0.2, 0.5)], "token string, phi0 double, phi1 double")
    monkeypatch.setattr(topics, "written", None)
    got = {r["bug_id"]: (r["theta0"], r["theta1"]) for r in topics.infer_topics(rows, words, 2, 2).collect()}
    x, y = 0.5, 0.5
    for _ in range(2):
        e = 2 * 0.7 * x / (0.7 * x + 0.1 * y) + 0.2 * x / (0.2 * x + 0.5 * y)
        x, y = (e + 1) / 5, (3 - e + 1) / 5
    assert got[1] == pytest.approx((x, y)) and got[2] == (0.5, 0.5)
