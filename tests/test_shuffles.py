"""Plans of the term features: what is grouped within a report is not shuffled again."""

import random

from pyspark.sql import functions as F

from tandem.operators import features, scoring


def _reports(spark):
    return spark.createDataFrame([(1, "a b", "c d a"), (2, "b", ""), (3, "a c", "a c")], "bug_id long, short_desc string, description string")


def test_postings_are_counted_where_they_arise(spark):
    post = features.postings(_reports(spark), lambda t: F.split(t, " "))
    plan = features.relative_tf(post)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    got = {tuple(r) for r in post.filter("bug_id = 3 and n = 1").select("field", "token", "tf").collect()}
    assert got == {("sum", "a", 1), ("sum", "c", 1), ("desc", "a", 1), ("desc", "c", 1)}


def test_bm25f_in_blocks_of_queries_equals_one_block(spark, monkeypatch):
    terms = scoring.bm25f_terms(features.postings(_reports(spark), lambda t: F.split(t, " "))).cache()
    idf = terms.select("n", "token").distinct().withColumn("idf", F.length("token") + 0.5)
    averages = terms.groupBy("n").agg(F.avg("len_sum").alias("avg_sum"), F.avg("len_desc").alias("avg_desc"))

    def scores():
        return sorted((r.anchor, r.cand, round(r.score, 9)) for r in scoring.bm25f_ext(terms, terms, idf, averages).collect())

    whole = scores()
    monkeypatch.setattr(scoring, "QUERY_TERMS", 3)
    assert len(whole) == 4 and scores() == whole


def test_pairs_are_summed_where_their_documents_are(spark, monkeypatch):
    rng = random.Random(4)
    d = [(c, n, f"t{t}", rng.random()) for c in range(60) for n in (1, 2) for t in range(12) if rng.random() < 0.3]
    q = [(c, n, t, float(rng.randint(0, 3))) for c, n, t, _ in d if c % 10 == 0]
    docs = scoring.bags(spark.createDataFrame([*d, (None, 1, "t1", 1.0)], "cand long, n int, token string, dw double")).withColumn("mark", F.struct((F.col("cand") % 3).alias("x")))
    query = spark.createDataFrame([*q, (None, 1, "t1", 1.0)], "anchor long, n int, token string, iw double")
    want = {}
    for a, n, t, iw in q:
        for c, m, u, dw in d:
            if (n, t) == (m, u) and a != c:
                want.setdefault((a, c), [0.0, 0.0])[n - 1] += iw * dw
    for block, step, part in ((400_000, 1 << 20, 1_000_000), (9, 7, 20)):
        for name, value in (("QUERY_TERMS", block), ("STEP_CELLS", step), ("PART_TERMS", part)):
            monkeypatch.setattr(scoring, name, value)
        sums = scoring.pair_sums(scoring.query_files(query), docs)
        got = {(r.anchor, r.cand): (round(r.uni, 9), round(r.bi, 9), r.mark.x) for r in sums.collect()}
        assert got == {k: (round(u, 9), round(b, 9), k[1] % 3) for k, (u, b) in want.items()}  # sums of 0 are pairs too
    # the pairs themselves are not shuffled: only the documents' terms are, before they meet the queries
    plan = sums._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(plan) > 1 and "Exchange" not in plan[0]


def test_best_scores_equal_the_order_of_all_pairs(spark):
    rows = [(a, c, round((c * 7919 + a) % 101 / 16, 6)) for a in range(3) for c in range(400)] + [(9, 5, 0.5)]
    docs = spark.createDataFrame([(c,) for c in range(400)], "cand long")
    pairs = spark.createDataFrame(rows, "anchor long, cand long, score double")
    got = {(r.anchor, r["rank"]): (r.cand, r.score) for r in scoring.best_scores(lambda some: pairs.join(some, "cand"), docs, 25).collect()}
    want = {}
    for a in (0, 1, 2, 9):
        best = sorted(((s, c) for b, c, s in rows if b == a), reverse=True)[:25]
        want |= {(a, k + 1): (c, s) for k, (s, c) in enumerate(best)}
    assert got == want


def test_term_lines_count_their_postings_once(spark):
    """The postings are written once, and no text is split again for the ids of their tokens."""
    from tandem.plans.catalog import queries

    out = queries()["dbrd_lines"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
