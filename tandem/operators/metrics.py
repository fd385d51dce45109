"""Evaluation: recall rate at k, mean reciprocal rank, classification and confusion metrics, distances, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-15


def recall_rate(anchors: DataFrame, hits: DataFrame, ks: range = range(1, 21)) -> DataFrame:
    """(k, n_hits, n_queries, rate) over all anchors; an anchor without a hit is a miss."""
    j = anchors.select("anchor").join(hits, "anchor", "left")
    per_k = j.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    n = F.count(F.lit(1))
    hit = F.count_if(F.coalesce(F.col("pos") <= F.col("k"), F.lit(False)))
    return per_k.groupBy("k").agg(hit.alias("n_hits"), n.alias("n_queries"), (hit / n).alias("rate"))


def mean_reciprocal_rank(anchors: DataFrame, hits: DataFrame) -> DataFrame:
    j = anchors.select("anchor").join(hits, "anchor", "left")
    return j.agg(F.avg(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))).alias("map"), F.count(F.lit(1)).alias("n_queries"))


def binary_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    tp = F.count_if((F.col(y) == 1) & (F.col(yhat) == 1))
    fp = F.count_if((F.col(y) == 0) & (F.col(yhat) == 1))
    fn = F.count_if((F.col(y) == 1) & (F.col(yhat) == 0))
    right = F.count_if(F.col(y) == F.col(yhat))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return df.agg((right / F.count(F.lit(1))).alias("accuracy"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def confusion(df: DataFrame, y: str, yhat: str, classes: int = 2) -> DataFrame:
    """(y, yhat, n) of all cells; rows with a label out of range are ignored."""
    return df.filter(F.col(y).between(0, classes - 1) & F.col(yhat).between(0, classes - 1)).groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def normalised(cells: DataFrame, by: str) -> DataFrame:
    """Share of a cell in all rows (``samples``), its true class (``recall``) or its predicted class (``precision``)."""
    from pyspark.sql import Window

    over = {"samples": Window.partitionBy(), "recall": Window.partitionBy("y"), "precision": Window.partitionBy("yhat")}[by]
    return cells.withColumn("share", F.col("n") / F.sum("n").over(over))


def class_metrics(cells: DataFrame) -> DataFrame:
    """(cls, tp, precision, recall, iou) of each class."""
    rows = cells.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("true_n"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("yhat").alias("cls")).agg(F.sum("n").alias("pred_n"))
    j = rows.join(cols, "cls", "full").na.fill(0)
    tp, t, p = F.col("tp"), F.col("true_n"), F.col("pred_n")
    return j.select("cls", "tp", (tp / (p + EPSILON)).alias("precision"), (tp / (t + EPSILON)).alias("recall"), (tp / (t + p - tp + EPSILON)).alias("iou"))


def distance_to_target(df: DataFrame, label: str, score: Column) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.avg(F.abs(F.col(label) - score)).alias("distance"), F.count(F.lit(1)).alias("n"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def by_year(hits: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(year, n_queries, n_hits, n_first) by the anchors' years."""
    j = anchors.select("anchor", F.year("creation_ts").alias("year"), F.month("creation_ts").alias("month")).join(hits, "anchor", "left")
    hit = F.coalesce(F.col("pos") <= k, F.lit(False))
    return j.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(hit).alias("n_hits"), F.count_if(F.coalesce(F.col("pos") == 1, F.lit(False))).alias("n_first"))


def label_counts(pairs: DataFrame) -> DataFrame:
    """One row: positive and negative labels, and negatives for each positive."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)
    return pairs.agg(pos.alias("n_positive"), neg.alias("n_negative"), F.try_divide(neg, pos).alias("ratio"))


def run_statistics(runs: DataFrame) -> DataFrame:
    """(method, mean, std, n) over runs (method, run, value); the deviation is that of the runs themselves."""
    return runs.groupBy("method").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def long_recall(runs: DataFrame) -> DataFrame:
    """(method, run, k, rate) from an array of rates by k (from 1) in ``rates``."""
    return runs.select("method", "run", F.posexplode("rates").alias("p", "rate")).select("method", "run", (F.col("p") + 1).alias("k"), "rate")


def metric_rows(precision: Column, recall: Column, epsilon: float = EPSILON) -> Column:
    """An array of (name, value) for a metric log, F1 with an epsilon in its divisor."""
    f1 = 2 * precision * recall / (precision + recall + epsilon)
    return F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in (("precision", precision), ("recall", recall), ("f1", f1))])
