"""Queries of drawn samples and negatives, and the SQL of those that stand in other modules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import STEPS, draw_sql
from ..operators import candidates, metrics, pairs, splits
from ..sources.views import DOC_REPORTS, EVENT_REPORTS, doc_reports, event_reports, table
from .entity import FLAGGED, flagged_events
from .registry import SQL, query

#: The positive pairs of the document reports.
PAIRS = f"{DOC_REPORTS}, pp AS (SELECT a.bug_id AS bug1, b.bug_id AS bug2, 1 AS label FROM rd a JOIN rd b USING (root) WHERE a.bug_id < b.bug_id)"


SQL["sample_anchors"] = f"SELECT event_id FROM events ORDER BY {draw_sql('event_id', seed=5)}, event_id LIMIT 100"
SQL["proportion_sample"] = f"WITH {PAIRS} SELECT * FROM pp WHERE {draw_sql('bug1', 'bug2')} % {STEPS} < {STEPS // 2}"
SQL["random_split"] = f"WITH {PAIRS}, d AS (SELECT *, ({draw_sql('bug1', 'bug2')} % {STEPS}) / {float(STEPS)} AS place FROM pp) SELECT bug1, bug2, label, CASE WHEN place < 0.8 THEN 'train' WHEN place < 0.9 THEN 'validation' ELSE 'test' END AS split FROM d"
SQL["random_inversion"] = f"WITH {PAIRS}, d AS (SELECT *, {draw_sql('bug1', 'bug2')} % {STEPS} < {STEPS // 2} AS swap FROM pp) SELECT CASE WHEN swap THEN bug2 ELSE bug1 END AS bug1, CASE WHEN swap THEN bug1 ELSE bug2 END AS bug2, label FROM d"


@query(f"WITH {DOC_REPORTS} SELECT bug_id, {draw_sql('bug_id', seed=0)} % 5 AS fold FROM rd")
def fold_numbers(spark, sf_dir):
    return splits.folds(doc_reports(spark, sf_dir).select("bug_id"), 5)


@query(f"WITH {FLAGGED} SELECT bug_id, is_dup, CASE WHEN creation_ts < TIMESTAMP '2024-01-20 00:00:00' THEN 'train' ELSE 'validation' END AS part FROM fl")
def validation_by_date(spark, sf_dir):
    return splits.carve_validation_by_date(flagged_events(spark, sf_dir), "2024-01-20").select("bug_id", "is_dup", "part")


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS n_positive, count(*) FILTER (WHERE toxic <> 1) AS n_negative, count(*) FILTER (WHERE toxic <> 1) / count(*) FILTER (WHERE toxic = 1) AS ratio FROM labels")
def label_counts(spark, sf_dir):
    return metrics.label_counts(table(spark, sf_dir, "labels").select(F.col("toxic").alias("label")))


@query(f"WITH {EVENT_REPORTS}, v AS (SELECT product AS method, user_id % 10 AS run, avg(value) AS value FROM re JOIN events ON event_id = bug_id GROUP BY 1, 2) SELECT method, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM v GROUP BY method")
def run_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 10).alias("run")).agg(F.avg("value").alias("value"))
    return metrics.run_statistics(e).select("method", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("WITH v AS (SELECT event_type AS method, user_id AS run, list(value ORDER BY event_id)[1:20] AS rates FROM events GROUP BY 1, 2) SELECT method, run, unnest(range(1, len(rates) + 1)) AS k, unnest(rates) AS rate FROM v")
def recall_long(spark, sf_dir):
    """Arrays of up to 20 values, as those of recall rates at 1 to 20, in long form."""
    nth = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    first = table(spark, sf_dir, "events").withColumn("nth", nth).filter("nth <= 20")  # pruned before they are gathered
    e = first.groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("run")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    runs = e.select("method", "run", F.transform("v", lambda x: x["value"]).alias("rates"))
    return metrics.long_recall(runs)


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM labels),
m AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
SELECT unnest(['precision', 'recall', 'f1']) AS name, round(unnest([p, r, 2 * p * r / (p + r + 1e-15)]), 9) AS value FROM m""")
def metric_log(spark, sf_dir):
    m = metrics.binary_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select(F.inline(metrics.metric_rows(F.col("precision"), F.col("recall")))).select("name", F.round("value", 9).alias("value"))


_PRESELECT = f"""WITH {EVENT_REPORTS}, pl AS (SELECT bug_id, row_number() OVER (ORDER BY creation_ts, bug_id) AS place FROM re),
dr AS (SELECT bug_id AS anchor, {draw_sql('bug_id', 'i')} % (place - 1) + 1 AS place, i FROM pl, range(10) t(i) WHERE place > 1), once AS (SELECT anchor, place, min(i) AS i FROM dr GROUP BY 1, 2)
SELECT anchor, row_number() OVER (PARTITION BY anchor ORDER BY {{order}}) AS pos, bug_id AS cand FROM once JOIN pl USING (place)"""


def _preselected(spark, sf_dir, by_date: bool):
    r = event_reports(spark, sf_dir).select("bug_id", "creation_ts")
    out = candidates.random_preselect(r, r, 10, by_date)
    return out.select("anchor", F.col("pos").cast("long").alias("pos"), "cand")


@query(_PRESELECT.format(order="i"))
def preselect_random(spark, sf_dir):
    return _preselected(spark, sf_dir, False)


@query(_PRESELECT.format(order="place DESC"))
def preselect_random_by_date(spark, sf_dir):
    return _preselected(spark, sf_dir, True)
