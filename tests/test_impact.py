import random
from collections import defaultdict

from pyspark.sql import functions as F

from tandem.operators import impact
from tandem.sources.shared import written


def tables(spark, seed, docs=300, tokens=60):
    """Documents of tokens that grow common, whole-number weights so that ties occur."""
    rng = random.Random(seed)
    d = [(c, 1, f"t{t}", float(rng.randint(1, 3))) for c in range(docs) for t in range(tokens) if rng.random() < 1 / (t + 1) ** 0.7]
    q = [(-1 - a, 1, f"t{t}", float(rng.randint(0, 4)) / (1 if t > 5 else 16)) for a in range(6) for t in rng.sample(range(tokens), 12 if a else 1)]
    docs_ = written(spark.createDataFrame(d, "cand long, n int, token string, dw double"), "docs")
    return spark.createDataFrame(q, "anchor long, n int, token string, iw double"), docs_, q, d


def plain(q, d, k, allowed, extra):
    lists, out = defaultdict(list), []
    for c, _, t, w in d:
        lists[t].append((c, w))
    for a in sorted({r[0] for r in q}):
        sums = defaultdict(float)
        for _, _, t, iw in (r for r in q if r[0] == a):
            for c, w in lists[t]:
                sums[c] += iw * w
        best = sorted(((-round(s + extra(c), 6), -c) for c, s in sums.items() if allowed(c)))[:k]
        out += [(a, -c, -s, n + 1) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_lists_equal_the_full_computation(spark):
    for seed, k in ((1, 3), (2, 20), (3, 500)):
        q, docs, qs, ds = tables(spark, seed)
        got = impact.best_lists(q, docs, k, lambda df: df.filter("cand % 7 <> 0"))
        assert sorted(map(tuple, got.collect())) == plain(qs, ds, k, lambda c: c % 7, lambda c: 0.0)
        more = impact.best_lists(q, docs, k, lambda df: df, lambda df: df.withColumn("extra", (F.col("cand") % 3).cast("double")), 2.0)
        assert sorted(map(tuple, more.collect())) == plain(qs, ds, k, lambda c: True, lambda c: c % 3)


def test_common_tokens_of_little_weight_are_not_joined(spark, monkeypatch):
    d = [(c, 1, "the", 1.0) for c in range(2000)] + [(c, 1, f"rare{c % 50}", 1.0) for c in range(2000)]
    docs = written(spark.createDataFrame(d, "cand long, n int, token string, dw double"), "docs")
    q = spark.createDataFrame([(-1, 1, "the", 0.1), (-1, 1, "rare3", 5.0)], "anchor long, n int, token string, iw double")
    joined = []
    plain_join = impact._joined
    monkeypatch.setattr(impact, "_joined", lambda terms, docs_: joined.append(terms.join(docs_, ["n", "token"]).count()) or plain_join(terms, docs_))
    got = impact.best_lists(q, docs, 5, lambda df: df)
    assert [(r["cand"], r["score"]) for r in got.orderBy("rank").collect()] == [(1953 - 50 * k, 5.1) for k in range(5)]
    assert max(joined) == 40  # of 2,040 rows


def test_empty_tables(spark):
    q, docs, _, _ = tables(spark, 1, docs=5, tokens=14)
    assert impact.best_lists(q.limit(0), docs, 3, lambda df: df).collect() == []
    assert impact.best_lists(q, written(docs.limit(0), "none"), 3, lambda df: df).collect() == []
