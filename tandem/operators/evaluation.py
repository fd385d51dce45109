"""A whole ranking run: lists scored once, ranked and judged, with a record of what was done.

Scored pairs are written once, so ranking and the count of candidates (from the files' own row counts) read them without scoring again; the
places of the first hits are one row for each query, from which every metric is read. (``DataFrame.observe`` would count on the way, but a session that
has observed can no longer send fitted models with a training summary to its tasks.)"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import metrics, ranking


@dataclass(frozen=True)
class Throughput:
    """What a run did: queries, scored candidates, seconds."""

    label: str
    queries: int
    candidates: int
    seconds: float

    @property
    def queries_per_second(self) -> float:
        return self.queries / self.seconds if self.seconds else 0.0


def run_ranking(anchors: DataFrame, scored: DataFrame, grouped: bool = True, ks: range = range(1, 21), label: str = "") -> tuple[DataFrame, Throughput]:
    """(name, k, value, n_hits, n_queries): recall rate at each k and MAP (k is 0) over all ``anchors`` (anchor), whose names end in the
    label, and the run's throughput. ``scored``: anchor, cand, master, is_dup, score. An anchor without candidates or without a true one
    among them is a miss, and so has no reciprocal place. Without anchors the values are null."""
    began = time.monotonic()
    lists = written(scored.select("anchor", "cand", "master", "is_dup", "score"), "scored")
    record, places = run_places(anchors, ranking.first_hit(ranking.recommend(lists), grouped), ks, label)
    done = time.monotonic() - began
    return record, Throughput(label, places.count(), lists.count(), done)


def run_places(anchors: DataFrame, hits: DataFrame, ks: range = range(1, 21), label: str = "") -> tuple[DataFrame, DataFrame]:
    """The record of ``run_ranking`` from the places of the first hits (anchor, pos), and the written places of all anchors."""
    places = written(anchors.select("anchor").join(hits, "anchor", "left"), "places")
    end = f"_{label}" if label else ""
    queries = places.select("anchor")
    found = places.filter("pos is not null")
    rates = metrics.recall_rate(queries, found, ks).select(F.lit(f"recall_rate{end}").alias("name"), F.col("k").cast("long").alias("k"), F.col("rate").alias("value"), "n_hits", "n_queries")
    whole = places.agg(F.avg(F.coalesce(1.0 / F.col("pos"), F.lit(0.0))).alias("value"), F.count("pos").alias("n_hits"), F.count(F.lit(1)).alias("n_queries"))
    whole = whole.select(F.lit(f"MAP{end}").alias("name"), F.lit(0).cast("long").alias("k"), "value", "n_hits", "n_queries")
    return rates.unionByName(whole), places
