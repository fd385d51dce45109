"""Best k candidates of stated queries by a sum over shared tokens, without joining common tokens.

A score is the sum of query weight x document weight over the shared tokens, maybe plus a bounded extra of the pair. The inverted list of a token
carries its greatest document weight (``peak``), so query weight x peak bounds what the token can add. For each query

1. the tokens that may add most for each row of their lists are joined first, until SEEDS x k rows are met, and the best k documents
   of these are scored in full: the kth score is a threshold that the final kth score reaches;
2. tokens are left aside, those that add least for each row first, as long as their bounds together stay below EASY of the threshold: a document
   with no other token cannot reach it. The other tokens' lists are joined and summed;
3. documents whose sum with the bounds of what was left aside (and of the extra) reaches the threshold are completed by their own
   tokens, by a join on document and token.

Bounds are compared with a margin above the rounding of sums, so the lists are exactly those of the full computation. Where a query has
fewer than k documents after the first step, its threshold is 0 and all its tokens are joined. The more documents there are to each
k, the higher the threshold and the fewer rows are joined; nothing else depends on the data.

Weights must not be negative. Partial sums come before each shuffle; the join on a common token happens only for queries that need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import scoring

SEEDS, EASY = 5, 0.6
#: More than sums of doubles differ by their order.
MARGIN = 1e-6


def bm25f_weights(queries: DataFrame, docs: DataFrame, idf: DataFrame, averages: DataFrame, uni=scoring.Bm25fWeights(), bi=scoring.Bm25fWeights(), w_uni: float = 0.9, w_bi: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(anchor, n, token, iw) and (cand, n, token, dw): the score of BM25F_ext is the sum of iw x dw."""
    q, d = scoring.bm25f_sides(queries, docs, idf, averages, uni, bi)
    return q.withColumn("iw", F.col("iw") * F.when(F.col("n") == 1, w_uni).otherwise(w_bi)), d


def full_scores(pairs: DataFrame, query: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, cand, sum) of given pairs over the given query tokens; a pair without a shared token is left out."""
    terms = pairs.select("anchor", "cand").join(query.select("anchor", "n", "token", "iw"), "anchor").join(docs, ["cand", "n", "token"])
    return terms.groupBy("anchor", "cand").agg(F.sum(F.col("iw") * F.col("dw")).alias("sum"))


def _joined(query: DataFrame, docs: DataFrame) -> DataFrame:
    return query.select("anchor", "n", "token", "iw").join(docs, ["n", "token"]).groupBy("anchor", "cand").agg(F.sum(F.col("iw") * F.col("dw")).alias("sum"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(anchor, kth): the kth highest ``score`` of each query that has k."""
    order = Window.partitionBy("anchor").orderBy(F.desc("score"))
    return scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).filter(F.col("_r") == k).select("anchor", F.col("score").alias("kth"))


def best_lists(query: DataFrame, docs: DataFrame, k: int, allowed: Callable[[DataFrame], DataFrame], extra: Callable[[DataFrame], DataFrame] | None = None, most_extra: float = 0.0) -> DataFrame:
    """(anchor, cand, score, rank) of the k best candidates of each query; ties (of scores rounded to six digits) to the greater id.

    ``query``: anchor, n, token, iw; ``docs``: cand, n, token, dw (a written table). ``allowed`` filters pairs (anchor, cand, ...);
    ``extra`` adds the column ``extra``, from 0 to ``most_extra``. A candidate shares a token with its query."""
    peaks = docs.groupBy("n", "token").agg(F.max("dw").alias("peak"), F.count(F.lit(1)).alias("df"))
    terms = written(query.join(peaks, ["n", "token"]).withColumn("bound", F.col("iw") * F.col("peak")), "terms")

    def scored(sums: DataFrame) -> DataFrame:
        sums = extra(sums) if extra else sums.withColumn("extra", F.lit(0.0))
        return sums.withColumn("score", F.round(F.col("sum") + F.col("extra"), 6))

    gain = [F.desc(F.col("bound") / F.col("df")), "n", "token"]
    before = F.sum("df").over(Window.partitionBy("anchor").orderBy(*gain).rowsBetween(Window.unboundedPreceding, -1))  # a query's tokens
    seeds = terms.withColumn("_b", F.coalesce(before, F.lit(0))).filter(F.col("_b") < SEEDS * k)
    first = allowed(_joined(seeds, docs))
    order = Window.partitionBy("anchor").orderBy(F.desc("sum"), "cand")
    chosen = written(first.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("anchor", "cand"), "chosen")
    threshold = written(_kth(scored(full_scores(chosen, terms, docs)), k), "threshold")
    # the bounds of the tokens left aside, those with the least gain first
    upto = F.sum("bound").over(Window.partitionBy("anchor").orderBy(F.col("bound") / F.col("df"), "n", "token").rowsBetween(Window.unboundedPreceding, 0))
    room = EASY * F.col("kth") - F.lit(float(most_extra))
    sides = terms.join(threshold, "anchor", "left").withColumn("kth", F.coalesce("kth", F.lit(0.0))).withColumn("aside", upto < room)
    sides = written(sides, "sides")
    aside = sides.filter("aside")
    rest = sides.groupBy("anchor", "kth").agg(F.sum(F.when(F.col("aside"), F.col("bound")).otherwise(0.0)).alias("rest"))
    sums = allowed(_joined(sides.filter("not aside"), docs)).join(rest, "anchor")
    able = written(sums.filter(F.col("sum") + F.col("rest") + most_extra >= F.col("kth") - MARGIN).select("anchor", "cand", "sum"), "able")
    more = full_scores(able, aside, docs).withColumnRenamed("sum", "more")
    done = able.join(more, ["anchor", "cand"], "left").withColumn("sum", F.col("sum") + F.coalesce("more", F.lit(0.0))).drop("more")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.desc("cand"))
    return scored(done).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("anchor", "cand", "score", "rank")
