"""Temporal splits. Rows are ordered by (creation_ts, bug_id); a duplicate is not the first of its set.

Running counts over all rows use two levels: counts by day, whose sums are small, then counts within a day, so
no task orders the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw

ORDER = ("creation_ts", "bug_id")


def flag_duplicates(reports: DataFrame, root: str = "root") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(root).orderBy(*ORDER))
    return reports.withColumn("is_dup", place > 1)


def running_count(df: DataFrame, flag, name: str) -> DataFrame:
    """Adds how many rows up to and with this one, in the order of time and id, have the flag."""
    day = F.to_date("creation_ts")
    f = F.coalesce(flag.cast("long"), F.lit(0).cast("long"))
    daily = df.groupBy(day.alias("_day")).agg(F.sum(f).alias("_n"))
    before = daily.select("_day", (F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))  # a row a day
    inner = F.sum(f).over(Window.partitionBy("_day").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_day", day).join(before, "_day").withColumn(name, F.col("_before") + inner).drop("_day", "_before")


def split_percent(flagged: DataFrame, p: float) -> DataFrame:
    """The last share p of the duplicates is for test; the row of the cut duplicate still trains."""
    n = flagged.filter("is_dup").count()
    cut = int((1 - p) * n)
    counted = running_count(flagged, F.col("is_dup"), "_upto")
    train = (F.col("_upto") - F.col("is_dup").cast("long")) <= cut
    return counted.withColumn("split", F.when(train, "train").otherwise("test")).drop("_upto")


def split_first_n(flagged: DataFrame, n: int, start: str | None = None) -> DataFrame:
    """Trains until n duplicates (from ``start`` on, if given) were seen before a row; rows before start train."""
    late = F.lit(True) if start is None else F.col("creation_ts") >= F.lit(start).cast("timestamp")
    dup = F.col("is_dup") & late
    counted = running_count(flagged, dup, "_upto")
    before = F.col("_upto") - dup.cast("long")
    return counted.withColumn("split", F.when(~late | (before < n), "train").otherwise("test")).drop("_upto")


def split_date(flagged: DataFrame, date: str) -> DataFrame:
    return flagged.withColumn("split", F.when(F.col("creation_ts") < F.lit(date).cast("timestamp"), "train").otherwise("test"))


def carve_validation(flagged: DataFrame, r: float) -> DataFrame:
    """Adds ``part`` (train or validation) by the last share r of the duplicates, the cut duplicate inclusive."""
    n = flagged.filter("is_dup").count()
    v = int((1 - r) * n)
    counted = running_count(flagged, F.col("is_dup"), "_upto")
    train = (F.col("_upto") - F.col("is_dup").cast("long")) <= v
    return counted.withColumn("part", F.when(train, "train").otherwise("validation")).drop("_upto")


def carve_validation_by_date(flagged: DataFrame, date: str) -> DataFrame:
    return flagged.withColumn("part", F.when(F.col("creation_ts") < F.lit(date).cast("timestamp"), "train").otherwise("validation"))


def folds(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Fold number by hash."""
    return df.withColumn("fold", F.pmod(draw("bug_id", seed=seed), F.lit(k)))
