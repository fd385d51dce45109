import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.operators import negatives, pairs, scoring
from tandem.operators.pairs import pair_key


def reports(spark, sets):
    """Sets of the given sizes, ids in order."""
    rows = [(i, s) for s, size in enumerate(sets) for i in range(sum(sets[:s]), sum(sets[: s + 1]))]
    return spark.createDataFrame(rows, "bug_id long, root long")


def test_primes_and_walks():
    assert all(p == 2 or all(p % d for d in range(2, int(p**0.5) + 1)) for p in negatives.PRIMES if p < 10**7)
    for p in (2, 3, 11):
        assert all(sorted((a + i * b) % p for i in range(p)) == list(range(p)) for a in range(p) for b in range(1, p))


def test_quotas_are_full_and_no_pair_stands_twice(spark):
    r = reports(spark, [1] * 40 + [20] * 3 + [50])
    got = negatives.random_negatives(r, r, 3).collect()
    sets = {x["bug_id"]: x["root"] for x in r.collect()}
    assert Counter(x["bug1"] for x in got) == dict.fromkeys(sets, 3)
    assert len({tuple(sorted((x["bug1"], x["bug2"]))) for x in got}) == len(got)
    assert all(sets[x["bug1"]] != sets[x["bug2"]] for x in got)
    assert set(got) == set(negatives.random_negatives(r, r, 3).collect())
    assert set(got) != set(negatives.random_negatives(r, r, 3, seed=1).collect())


def test_used_up_candidates_end_the_walk(spark):
    r = reports(spark, [3, 4])
    anchors = r.filter("root = 0")
    got = negatives.random_negatives(anchors, r, 9).collect()
    assert len(got) == 12 == len({(x["bug1"], x["bug2"]) for x in got})  # all four others, no anchor among them
    both = negatives.random_negatives(r, r, 9).collect()
    assert len({tuple(sorted((x["bug1"], x["bug2"]))) for x in both}) == len(both) == 12  # each pair from one side
    assert negatives.random_negatives(r.limit(0), r, 2).collect() == [] == negatives.random_negatives(r, r.limit(0), 2).collect()
    assert negatives.random_negatives(anchors, anchors, 2).collect() == []


def test_rare_losses_are_found(spark):
    r = reports(spark, [1] * 300)
    got = negatives.non_zero_negatives(r.filter("bug_id < 5"), r, lambda df: df.withColumn("loss", (F.col("bug2") % 97 == 96).cast("int")), 4).collect()
    assert Counter(x["bug1"] for x in got) == dict.fromkeys(range(5), 3) and all(x["bug2"] in (96, 193, 290) for x in got)


def test_masters_halves_and_lists(spark):
    r = reports(spark, [2] * 30)
    used = r.filter("bug_id % 2 = 1").select(pair_key(F.col("bug_id"), F.col("bug_id") - 1).alias("key"))
    got = negatives.unseen_master_negatives(r.filter("bug_id % 2 = 1"), r.filter("bug_id % 2 = 0"), used, 40).collect()
    assert Counter(x["bug1"] for x in got) == {i: 29 for i in range(1, 60, 2)} and all(x["bug2"] != x["bug1"] - 1 for x in got)
    half = negatives.half_anchored_negatives(r, r.filter("bug_id % 2 = 1"), 101).collect()
    assert Counter(x["origin"] for x in half) == {"random": 51, "duplicate": 50}
    assert len({tuple(sorted((x["bug1"], x["bug2"]))) for x in half}) == 101
    listed = r.withColumns({"product": F.when(F.col("bug_id") < 4, "a").otherwise("b"), "component": F.col("bug_id") % 3})
    mix = negatives.product_mix_negatives(listed, listed, 6).collect()
    assert len({(x["bug1"], x["bug2"], x["level"]) for x in mix}) == len(mix)
    of = {x["bug_id"]: x for x in listed.collect()}
    assert all(of[x["bug1"]]["product"] == of[x["bug2"]]["product"] for x in mix if x["level"] != "*")
    assert all(of[x["bug1"]]["component"] == of[x["bug2"]]["component"] for x in mix if x["level"] == "c")


def test_labels_are_checked_in_the_job(spark):
    sets = reports(spark, [2, 2])
    good = spark.createDataFrame([(0, 1, 1), (0, 2, 0), (3, 1, -1)], "bug1 long, bug2 long, label int")
    assert sorted(map(tuple, pairs.verified(good, sets).collect())) == [(0, 1, 1), (0, 2, 0), (3, 1, -1)]
    for bad in ((0, 1, 0), (0, 2, 1), (0, 9, 0)):
        with pytest.raises(Exception, match="wrong label"):
            pairs.verified(good.union(spark.createDataFrame([bad], good.schema)), sets).collect()


def test_repeated_negatives_end_a_strict_job(spark):
    t = spark.createDataFrame([(1, 2, 3), (1, 4, 5)], "anchor long, pos long, neg long")
    assert sorted(map(tuple, pairs.pairs_from_triplets(t, strict=True).collect())) == [(1, 2, 1), (1, 3, -1), (1, 4, 1), (1, 5, -1)]
    again = t.union(spark.createDataFrame([(1, 6, 3)], t.schema))
    assert pairs.pairs_from_triplets(again).count() == 5
    with pytest.raises(Exception, match="negative repeats"):
        pairs.pairs_from_triplets(again, strict=True).collect()


def test_support_vectors_are_judged_on_rows_they_have_not_seen(spark):
    rng = random.Random(1)
    rows = [(i, -i, i % 2, [i % 2 + rng.gauss(0, 0.2), rng.gauss(0, 1)]) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, label int, features array<double>")
    got = scoring.svm_predictions(df, F.col("a") % 5 == 0).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and len(held) == 80 and sum(r["prediction"] == r["label"] for r in held) > 75


def test_tables_of_all_reports_are_not_broadcast(spark):
    """Their compressed bytes stay below the broadcast limit long after they are too large for the driver."""
    from tandem.plans import negatives as plans

    reports = spark.range(400).selectExpr("id as bug_id", "id % 40 as root", "'a' as product", "1 as component", "id % 7 as priority")
    drawn = negatives.random_negatives(reports.filter("bug_id % 2 = 0"), reports, 3)
    assert "Broadcast" not in plans._priorities(drawn, reports)._jdf.queryExecution().sparkPlan().toString()
    seen = []

    def allowed(df):
        seen.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.filter("root1 <> root2")

    anchors = reports.selectExpr("bug_id as bug1", "root as root1", "'*' as list", "cast(2 as long) as quota")
    assert negatives.walk(anchors, reports.selectExpr("bug_id as bug2", "root as root2", "'*' as list"), allowed).count() == 800
    assert seen and "Broadcast" not in seen[0]
