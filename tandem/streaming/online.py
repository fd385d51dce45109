"""Online matching: arriving reports meet the reports stored before them.

A report may only match earlier ones, so a stream of reports can be linked micro-batch by micro-batch. Each batch joins
the stored postings by token (an equi-join; the store is a partitioned table, the batch is small), keeps the k
best, writes them, and appends its own postings. Batch numbers name the output folders, so a batch that is tried again
overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features, ranking


def batch_postings(reports: DataFrame) -> DataFrame:
    return features.postings(reports, lambda t: tx.dbrd_tokens(t, drop_stops=False), (1,)).groupBy("bug_id", "token").agg(F.sum("tf").alias("tf"))


def overlap_scores(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(anchor, cand, score): shared tokens over the root of the product of both sizes."""
    size_b = batch.groupBy("bug_id").agg(F.count(F.lit(1)).alias("nb"))
    size_s = stored.groupBy("bug_id").agg(F.count(F.lit(1)).alias("ns"))
    shared = batch.select(F.col("bug_id").alias("anchor"), "token").join(stored.select(F.col("bug_id").alias("cand"), "token"), "token").filter("cand < anchor").groupBy("anchor", "cand").agg(F.count(F.lit(1)).alias("n"))
    j = shared.join(size_b.withColumnRenamed("bug_id", "anchor"), "anchor").join(size_s.withColumnRenamed("bug_id", "cand"), "cand")
    return j.select("anchor", "cand", (F.col("n") / F.sqrt(F.col("nb") * F.col("ns"))).alias("score"))


def matcher(spark: SparkSession, store: str, out: str, k: int = 5) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over streams of (bug_id, short_desc, description)."""

    def match(batch: DataFrame, number: int) -> None:
        batch_postings(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")
        stored = spark.read.parquet(store).filter(F.col("batch") <= number)
        own = stored.filter(F.col("batch") == number)
        ranking.recommend(overlap_scores(own, stored), k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return match


def windowed_counts(reports: DataFrame, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """Reports by product in time windows, late rows accepted up to ``late``."""
    return reports.withWatermark("creation_ts", late).groupBy(F.window("creation_ts", width), "product").agg(F.count(F.lit(1)).alias("n"))
