import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import candidates, ranking, scoring
from tandem.operators.places import OPEN, hit_places, weight_above
from tandem.plans import retrieval

DAY = 86400
SCHEMA = "bug_id long, creation_ts timestamp, root long, product string, component long, severity long, version long, priority long, day long"


@pytest.fixture(scope="module")
def reports(spark):
    """Sets of one product and component, and sets that change them; short and long gaps, equal times, null products and scores."""
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(600):
        root = (i * 7) % 29
        ts = start + dt.timedelta(seconds=((i * i * 37) % 101) * DAY // 3 + (i % 3) * 3600)
        product = None if root == 28 else "ab"[(root + (i % 5 == 0 and root > 20)) % 2]
        rows.append(((i * 389) % 600, ts, root, product, root % 3, i % 3, root % 4, i % 4 if i % 97 else None, (ts - dt.datetime(1970, 1, 1)).days))
    return spark.createDataFrame(rows, SCHEMA).cache()


def scored(anchors, reports, window):
    listed = candidates.sun_pairs(anchors, reports, window, retrieval.SCORED_BY)
    return listed.select("anchor", "cand", F.col("c.root").alias("master"), "is_dup", F.round(scoring.rep_extras(), 6).alias("score"))


@pytest.mark.parametrize("window", [1, 4])
@pytest.mark.parametrize("grouped", [True, False])
def test_places_equal_ranked_lists(spark, reports, window, grouped):
    asked, counts = F.col("bug_id") % 2 == 0, None if grouped else F.col("severity") < 2
    lists = scored(reports.filter(asked), reports, window).filter("score is not null")
    if counts is not None:
        lists = lists.join(reports.filter(counts).select(F.col("bug_id").alias("cand")), "cand", "left_semi")
    want = {r.anchor: r.pos for r in ranking.first_hit(ranking.recommend(lists), grouped).collect()}
    args = retrieval.SCORED_BY, ("product", "component"), F.round(scoring.rep_extras(), 6), scoring.most_unequal() + 1e-6
    got = {r.anchor: r.pos for r in hit_places(reports, asked, window, *args, grouped, counts).collect()}
    sure = {a: p for a, p in got.items() if p != OPEN}
    assert len(sure) > 100 and set(want) <= set(got)
    assert sure == {a: want[a] for a in sure}


def test_weights_above_equal_loops():
    rng = np.random.default_rng(1)
    key, weight = rng.integers(0, 50, 300), rng.integers(-1, 2, 300)
    upto, least = rng.integers(0, 301, 80), rng.integers(0, 60, 80)
    want = [int(weight[:u][key[:u] > k].sum()) for u, k in zip(upto, least)]
    assert weight_above(key, weight, upto, least).tolist() == want
    assert weight_above(key[:0], weight[:0], upto * 0, least).tolist() == [0] * 80


def test_places_list_no_pairs(spark, reports, monkeypatch):
    """Before, every pair of one product and component was met."""
    whole = reports.filter("root <= 20").withColumn("priority", F.coalesce("priority", F.lit(9)))  # no set changes its product
    want = {tuple(r) for r in ranking.first_hit(ranking.recommend(scored(whole, whole, 7))).select("anchor", "pos").collect()}
    monkeypatch.setattr(candidates, "sun_pairs", None)
    assert {tuple(r) for r in retrieval._places(whole, F.lit(True)).collect()} == want


def test_sets_that_change_groups(spark, reports):
    whole = reports.withColumn("priority", F.coalesce("priority", F.lit(9)))
    want = {tuple(r) for r in ranking.first_hit(ranking.recommend(scored(whole, whole, 7))).select("anchor", "pos").collect()}
    assert {tuple(r) for r in retrieval._places(whole, F.lit(True)).collect()} == want


@pytest.mark.parametrize("name", ["ranking_run", "rr_validation", "rr_by_year"])
def test_queries_of_places_list_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(candidates, "sun_pairs", None)
    assert getattr(retrieval, name)(spark, "/root/testdata/sf0.001").count()


def test_every_report_is_an_anchor(spark):
    """Before, only ids divisible by 100 were asked for."""
    sf = "/root/testdata/sf0.001"
    n = retrieval.event_reports(spark, sf).count()
    assert retrieval.candidates_deshmukh(spark, sf).count() == n
    assert retrieval.map_mrr(spark, sf).first().n_queries == retrieval.flagged_events(spark, sf).filter("is_dup").count() > n // 2
    assert retrieval.first_hit_rank(spark, sf).filter("anchor % 100 <> 0").count() > n // 2
