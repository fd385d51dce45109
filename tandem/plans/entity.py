"""Queries of scans, filters, entity resolution, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, pairs, resolve, splits
from ..sources import reports as rp
from ..sources.views import DOC_REPORTS, EVENT_REPORTS, ORDER_REPORTS, doc_reports, event_reports, order_reports, table
from .registry import query


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.flag_duplicates(event_reports(spark, sf_dir))


FLAGGED = f"{EVENT_REPORTS}, fl AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY creation_ts, bug_id) > 1 AS is_dup FROM re)"
RUNNING = "rc AS (SELECT *, sum(CASE WHEN is_dup THEN 1 ELSE 0 END) OVER (ORDER BY creation_ts, bug_id ROWS UNBOUNDED PRECEDING) AS upto FROM fl)"


# --- scans and filters ---------------------------------------------------------------------------------------------


@query(f"WITH {DOC_REPORTS} SELECT count(*) AS n, CAST(sum(CASE WHEN trim(description) = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty FROM rd")
def scan_empty_desc(spark, sf_dir):
    return doc_reports(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("description") == "").alias("n_empty"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang", "source", "n_chars")


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events) WHERE k = 1")
def dedup_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type", F.to_date("ts")))
    return resolve.first_wins(e, "key", ["event_id"]).select("event_id", "user_id", "event_type", "ts")


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, creation_ts, product FROM re WHERE creation_ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'")
def filter_period(spark, sf_dir):
    t = F.col("creation_ts")
    return event_reports(spark, sf_dir).filter((t >= F.lit("2024-01-08 00:00:00").cast("timestamp")) & (t <= F.lit("2024-01-20 23:59:59").cast("timestamp"))).select("bug_id", "creation_ts", "product")


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, creation_ts FROM re WHERE creation_ts <= TIMESTAMP '2024-01-15 23:59:59'")
def filter_until_date(spark, sf_dir):
    return event_reports(spark, sf_dir).filter(F.col("creation_ts") <= F.lit("2024-01-15 23:59:59").cast("timestamp")).select("bug_id", "creation_ts")


@query(f"WITH {DOC_REPORTS} SELECT bug_id, length(short_desc) AS n_summary, length(description) AS n_description FROM rd WHERE trim(short_desc) <> '' AND trim(description) <> ''")
def filter_nonempty(spark, sf_dir):
    return doc_reports(spark, sf_dir).filter("trim(short_desc) <> '' and trim(description) <> ''").select("bug_id", F.length("short_desc").cast("long").alias("n_summary"), F.length("description").cast("long").alias("n_description"))


@query(f"WITH {ORDER_REPORTS} SELECT bug_id, status FROM ro WHERE status NOT IN ('O', 'P')")
def filter_open_status(spark, sf_dir):
    return order_reports(spark, sf_dir).filter(~F.col("status").isin("O", "P")).select("bug_id", "status")


@query("SELECT e.event_id AS bug_id, e.event_type FROM events e WHERE e.event_id <= (SELECT max(event_id) * 3 / 4 FROM events) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)")
def filter_bugs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg((F.max("event_id") * 3 / 4).alias("top"))
    black = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"))
    return e.join(F.broadcast(top), F.col("event_id") <= F.col("top")).join(black, "event_id", "left_anti").select(F.col("event_id").alias("bug_id"), "event_type")  # one row


@query(f"WITH {EVENT_REPORTS} SELECT a.bug_id, CASE WHEN a.dup_id IS NOT NULL THEN 'DUPLICATE' WHEN EXISTS (SELECT 1 FROM re b WHERE b.dup_id = a.bug_id) THEN 'DMASTER' ELSE 'NDUPLICATE' END AS resolution FROM re a")
def resolution_normalise(spark, sf_dir):
    return resolve.normalise_resolution(event_reports(spark, sf_dir)).select("bug_id", "resolution")


@query(f"WITH {DOC_REPORTS} SELECT bug_id, md5(regexp_replace(short_desc, '^\\s+|\\s+$', '', 'g') || chr(10) || description) AS text_md5 FROM rd")
def concat_sum_desc(spark, sf_dir):
    from ..functions import text as tx

    return doc_reports(spark, sf_dir).select("bug_id", F.md5(tx.summary_and_description(F.col("short_desc"), F.col("description"))).alias("text_md5"))


@query("SELECT event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def timestamp_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("raw", F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0200")))
    t = rp.parse_ts(F.col("raw"))
    return e.select("event_id", rp.day_number(t).alias("day"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, CAST(floor(epoch(creation_ts) / 86400) AS BIGINT) AS day FROM re")
def timestamp_days(spark, sf_dir):
    return event_reports(spark, sf_dir).select("bug_id", rp.day_number(F.col("creation_ts")).alias("day"))


@query("SELECT max(event_id) AS max_id FROM events")
def max_id(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max("event_id").alias("max_id"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events WHERE props IS NOT NULL")
def json_path(spark, sf_dir):
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.element_at(F.from_json("props", "map<string,string>"), key).alias("first_value"))


# --- entity resolution -----------------------------------------------------------------------------------------------


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, coalesce(dup_id, bug_id) AS master_id FROM re")
def master_id(spark, sf_dir):
    return resolve.master_ids(event_reports(spark, sf_dir)).select("bug_id", "master_id")


@query(f"WITH {DOC_REPORTS} SELECT master_id, bug_id FROM (SELECT dup_id AS master_id, bug_id FROM rd WHERE dup_id IS NOT NULL UNION SELECT DISTINCT dup_id, dup_id FROM rd WHERE dup_id IS NOT NULL)")
def master_set(spark, sf_dir):
    return resolve.master_sets(doc_reports(spark, sf_dir)).select("master_id", "bug_id")


def _broken(spark, sf_dir):
    """Event reports whose set heads are not in the table: their duplicates name absent masters."""
    r = event_reports(spark, sf_dir).withColumn("dup_id", F.when(F.col("bug_id") != F.col("root"), F.col("root")))
    return r.filter(~((F.col("bug_id") == F.col("root")) & (F.col("severity") < 3)))


BROKEN = f"{EVENT_REPORTS}, br AS (SELECT * REPLACE (CASE WHEN bug_id <> root THEN root END AS dup_id) FROM re WHERE NOT (bug_id = root AND severity < 3)), ab AS (SELECT * FROM br WHERE dup_id IS NOT NULL AND dup_id NOT IN (SELECT bug_id FROM br)), he AS (SELECT dup_id AS gone, arg_min(bug_id, (creation_ts, bug_id)) AS heir, count(*) AS n FROM ab GROUP BY dup_id)"


@query(f"WITH {BROKEN} SELECT b.bug_id, coalesce(CASE WHEN heir IS NULL THEN dup_id WHEN heir <> bug_id THEN heir END, -1) AS dup_id FROM br b LEFT JOIN he ON b.dup_id = he.gone")
def missing_master_repair(spark, sf_dir):
    return resolve.repair_missing_masters(_broken(spark, sf_dir)).select("bug_id", F.coalesce("dup_id", F.lit(-1)).alias("dup_id"))


@query(f"WITH {BROKEN} SELECT b.bug_id, coalesce(CASE WHEN gone IS NULL THEN dup_id END, -1) AS dup_id FROM br b LEFT JOIN he ON b.dup_id = he.gone")
def missing_master_dissolve(spark, sf_dir):
    return resolve.dissolve_missing_masters(_broken(spark, sf_dir)).select("bug_id", F.coalesce("dup_id", F.lit(-1)).alias("dup_id"))


@query(f"WITH {BROKEN} SELECT b.bug_id, coalesce(CASE WHEN gone IS NULL THEN dup_id WHEN n > 1 AND heir <> bug_id THEN heir END, -1) AS dup_id FROM br b LEFT JOIN he ON b.dup_id = he.gone")
def missing_master_elect(spark, sf_dir):
    return resolve.dissolve_missing_masters(_broken(spark, sf_dir), keep_larger=True).select("bug_id", F.coalesce("dup_id", F.lit(-1)).alias("dup_id"))


@query(f"WITH {EVENT_REPORTS}, nx AS (SELECT *, lead(bug_id) OVER (PARTITION BY root ORDER BY creation_ts, bug_id) AS nx FROM re), cy AS (SELECT bug_id, creation_ts, CASE WHEN bug_id = root THEN nx ELSE dup_id END AS dup_id FROM nx) SELECT a.bug_id, coalesce(CASE WHEN b.bug_id IS NOT NULL AND (a.creation_ts, a.bug_id) < (b.creation_ts, b.bug_id) THEN NULL ELSE a.dup_id END, -1) AS dup_id FROM cy a LEFT JOIN cy b ON a.dup_id = b.bug_id AND b.dup_id = a.bug_id")
def cycle2_removal(spark, sf_dir):
    nxt = F.lead("bug_id").over(Window.partitionBy("root").orderBy("creation_ts", "bug_id"))
    r = event_reports(spark, sf_dir).withColumn("dup_id", F.when(F.col("bug_id") == F.col("root"), nxt).otherwise(F.col("dup_id")))
    return resolve.cut_two_cycles(r).select("bug_id", F.coalesce("dup_id", F.lit(-1)).alias("dup_id"))


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, coalesce(dup_id, -1) AS dup_id FROM re")
def cycle_removal(spark, sf_dir):
    """Every set's head is made to repeat its newest member: one cycle a set, whose oldest link is cut again."""
    newest = F.last("bug_id").over(Window.partitionBy("root").orderBy("creation_ts", "bug_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = event_reports(spark, sf_dir).withColumn("dup_id", F.when((F.col("bug_id") == F.col("root")) & (newest != F.col("root")), newest).otherwise(F.col("dup_id")))
    return resolve.cut_cycles(r).select("bug_id", F.coalesce("dup_id", F.lit(-1)).alias("dup_id"))


@query(f"WITH RECURSIVE {EVENT_REPORTS}, ch AS (SELECT bug_id, bug_id AS root FROM re WHERE dup_id IS NULL UNION ALL SELECT re.bug_id, ch.root FROM re JOIN ch ON re.dup_id = ch.bug_id) SELECT bug_id, root FROM ch")
def chain_closure(spark, sf_dir):
    return resolve.chain_roots(event_reports(spark, sf_dir))


@query(f"WITH {BROKEN} SELECT bug_id FROM br WHERE dup_id IS NULL OR dup_id IN (SELECT bug_id FROM br)")
def drop_orphan_dups(spark, sf_dir):
    return resolve.drop_orphans(_broken(spark, sf_dir)).select("bug_id")


@query(f"WITH {ORDER_REPORTS} SELECT bug_id, first_value(bug_id) OVER (PARTITION BY set_id ORDER BY creation_ts, bug_id) AS new_master FROM ro")
def master_reelect(spark, sf_dir):
    return resolve.elect_oldest(order_reports(spark, sf_dir).withColumnRenamed("set_id", "root")).select("bug_id", "new_master")


@query(f"WITH {ORDER_REPORTS}, s AS (SELECT set_id, min(bug_id) AS low, arg_min(bug_id, (creation_ts, bug_id)) AS old FROM ro GROUP BY set_id) SELECT CASE WHEN bug_id = old THEN low WHEN bug_id = low THEN old ELSE bug_id END AS bug_id, bug_id AS original_bug_id FROM ro JOIN s USING (set_id)")
def id_swap(spark, sf_dir):
    return resolve.swap_ids(order_reports(spark, sf_dir).withColumnRenamed("set_id", "root")).select("bug_id", "original_bug_id")


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, root FROM re WHERE root IN (SELECT root FROM re GROUP BY root HAVING count(*) > 1)")
def set_membership(spark, sf_dir):
    return resolve.set_members(event_reports(spark, sf_dir)).select("bug_id", "root")


# --- splits ------------------------------------------------------------------------------------------------------------


@query(f"WITH {FLAGGED} SELECT bug_id, is_dup FROM fl")
def dup_flag(spark, sf_dir):
    return flagged_events(spark, sf_dir).select("bug_id", "is_dup")


@query(f"WITH {FLAGGED}, {RUNNING} SELECT bug_id, CASE WHEN upto - CAST(is_dup AS INT) <= (SELECT CAST(floor((1 - 0.4::DOUBLE) * count(*)) AS BIGINT) FROM fl WHERE is_dup) THEN 'train' ELSE 'test' END AS split FROM rc")
def split_percent(spark, sf_dir):
    return splits.split_percent(flagged_events(spark, sf_dir), 0.4).select("bug_id", "split")


N_AFTER = "upto2 AS (SELECT *, sum(CASE WHEN is_dup AND creation_ts >= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END) OVER (ORDER BY creation_ts, bug_id ROWS UNBOUNDED PRECEDING) - CAST(is_dup AND creation_ts >= TIMESTAMP '2024-01-10' AS INT) AS before FROM fl)"


@query(f"WITH {FLAGGED}, {N_AFTER} SELECT bug_id, CASE WHEN creation_ts < TIMESTAMP '2024-01-10' OR before < 2000 THEN 'train' ELSE 'test' END AS split FROM upto2")
def split_n_after_date(spark, sf_dir):
    return splits.split_first_n(flagged_events(spark, sf_dir), 2000, "2024-01-10").select("bug_id", "split")


@query(f"WITH {FLAGGED}, {RUNNING} SELECT bug_id, CASE WHEN upto - CAST(is_dup AS INT) < 3000 THEN 'train' ELSE 'test' END AS split FROM rc")
def split_first_n(spark, sf_dir):
    return splits.split_first_n(flagged_events(spark, sf_dir), 3000).select("bug_id", "split")


@query(f"WITH {FLAGGED} SELECT bug_id, CASE WHEN creation_ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split FROM fl")
def split_date(spark, sf_dir):
    return splits.split_date(flagged_events(spark, sf_dir), "2024-01-20").select("bug_id", "split")


@query(f"WITH {FLAGGED}, {RUNNING} SELECT bug_id, CASE WHEN upto - CAST(is_dup AS INT) <= (SELECT CAST(floor((1 - 0.05::DOUBLE) * count(*)) AS BIGINT) FROM fl WHERE is_dup) THEN 'train' ELSE 'validation' END AS part FROM rc")
def validation_carve(spark, sf_dir):
    return splits.carve_validation(flagged_events(spark, sf_dir), 0.05).select("bug_id", "part")


@query(f"WITH {FLAGGED} SELECT CASE WHEN creation_ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(*) FILTER (WHERE is_dup) AS n_dup FROM fl GROUP BY 1")
def split_counts(spark, sf_dir):
    return splits.split_date(flagged_events(spark, sf_dir), "2024-01-20").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_dup").alias("n_dup"))


@query(f"WITH {ORDER_REPORTS} SELECT bug_id, creation_ts, row_number() OVER (ORDER BY creation_ts, bug_id) AS place FROM ro")
def global_sort(spark, sf_dir):
    r = order_reports(spark, sf_dir).select("bug_id", "creation_ts")
    return splits.running_count(r, F.lit(True), "place")


@query("SELECT o_orderkey AS bug_id, ntile(7) OVER (ORDER BY o_orderkey) AS chunk FROM orders")
def chunks_ntile(spark, sf_dir):
    """Chunks of equal size up to one: the first n mod 7 have one more."""
    r = pairs.dense_places(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bug_id")))
    total = r.agg(F.count(F.lit(1)).alias("n"))
    size, more = F.floor(F.col("n") / 7), F.col("n") % 7
    edge = more * (size + 1)
    chunk = F.when(F.col("place") < edge, F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - edge) / size))
    return r.join(F.broadcast(total)).select("bug_id", (chunk + 1).cast("long").alias("chunk"))  # one row


@query(f"WITH {FLAGGED}, p AS (SELECT bug_id, root, CASE WHEN creation_ts < TIMESTAMP '2024-01-20' THEN 'main' ELSE 'aux' END AS part FROM fl WHERE is_dup) SELECT DISTINCT bug_id FROM p")
def union_ids(spark, sf_dir):
    f = flagged_events(spark, sf_dir).filter("is_dup")
    main = f.filter(F.col("creation_ts") < F.lit("2024-01-20").cast("timestamp"))
    aux = f.filter(F.col("creation_ts") >= F.lit("2024-01-18").cast("timestamp"))
    return main.select("bug_id").union(aux.select("bug_id")).distinct()


# --- positive pairs and keys ----------------------------------------------------------------------------------------------


@query(f"WITH {DOC_REPORTS} SELECT a.bug_id AS bug1, b.bug_id AS bug2, 1 AS label FROM rd a JOIN rd b ON a.root = b.root AND a.bug_id < b.bug_id")
def positive_pairs(spark, sf_dir):
    return pairs.positive_pairs(doc_reports(spark, sf_dir).select("bug_id", "root"))


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, least(bug_id, dup_id) || '|' || greatest(bug_id, dup_id) AS key FROM re WHERE dup_id IS NOT NULL")
def pair_key(spark, sf_dir):
    return event_reports(spark, sf_dir).filter("dup_id is not null").select("bug_id", pairs.pair_key(F.col("bug_id"), F.col("dup_id")).alias("key"))


@query(f"WITH {EVENT_REPORTS} SELECT least(bug_id, dup_id) || '|' || greatest(bug_id, dup_id) AS key, 2 AS n FROM re WHERE dup_id IS NOT NULL AND severity = 0")
def cross_split_pairs(spark, sf_dir):
    """Each pair stands in a split by its day; those of severity 0 stand in a second one, too."""
    r = event_reports(spark, sf_dir).filter("dup_id is not null").select(F.col("bug_id").alias("bug1"), F.col("dup_id").alias("bug2"), F.lit(1).alias("label"), (F.col("day") % 3).cast("string").alias("split"), "severity")
    twice = r.filter("severity = 0").select(F.col("bug2").alias("bug1"), F.col("bug1").alias("bug2"), "label", F.lit("again").alias("split"), "severity")
    return pairs.cross_split_pairs(r.unionByName(twice)).select("key", F.col("n").cast("int").alias("n"))


TRIPLETS = f"{EVENT_REPORTS}, tr AS (SELECT bug_id AS anchor, dup_id AS pos, root AS other, lag(bug_id) OVER (PARTITION BY product ORDER BY creation_ts, bug_id) AS neg FROM re), t3 AS (SELECT anchor, pos, neg FROM tr WHERE pos IS NOT NULL AND neg IS NOT NULL)"


def _triplets(spark, sf_dir):
    neg = F.lag("bug_id").over(Window.partitionBy("product").orderBy("creation_ts", "bug_id"))
    return event_reports(spark, sf_dir).select(F.col("bug_id").alias("anchor"), F.col("dup_id").alias("pos"), neg.alias("neg")).filter("pos is not null and neg is not null")


@query(f"WITH {TRIPLETS} SELECT anchor AS bug1, pos AS bug2, 1 AS label FROM t3 UNION SELECT anchor, neg, -1 FROM t3")
def pairs_from_triplets(spark, sf_dir):
    return pairs.pairs_from_triplets(_triplets(spark, sf_dir))


@query(f"WITH {EVENT_REPORTS} SELECT a.bug_id AS bug1, b.bug_id AS bug2, a.product, b.component FROM re a JOIN re b ON a.dup_id = b.bug_id")
def pair_reports(spark, sf_dir):
    r = event_reports(spark, sf_dir)
    other = r.select(F.col("bug_id").alias("bug2"), F.col("component"))
    return r.filter("dup_id is not null").select(F.col("bug_id").alias("bug1"), F.col("dup_id").alias("bug2"), "product").join(other, "bug2").select("bug1", "bug2", "product", "component")


@query("SELECT CAST(a AS BIGINT) AS bug_id, count(*) AS degree FROM (SELECT doc_id AS a, f AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE f < doc_id UNION SELECT f, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE f < doc_id) GROUP BY a")
def adjacency(spark, sf_dir):
    r = doc_reports(spark, sf_dir).filter("dup_id is not null")
    both = r.select("bug_id", F.col("dup_id").alias("other")).union(r.select("dup_id", "bug_id")).distinct()
    return both.groupBy("bug_id").agg(F.count(F.lit(1)).alias("degree"))


@query(f"WITH {DOC_REPORTS}, p AS (SELECT bug_id, dup_id FROM rd WHERE dup_id IS NOT NULL) SELECT bug_id FROM (SELECT bug_id FROM p UNION SELECT dup_id FROM p) EXCEPT SELECT dup_id FROM p")
def duplicates_of_pairs(spark, sf_dir):
    p = doc_reports(spark, sf_dir).filter("dup_id is not null").select("bug_id", "dup_id")
    every = p.select("bug_id").union(p.select("dup_id")).distinct()
    return every.join(p.select(F.col("dup_id").alias("bug_id")), "bug_id", "left_anti")


@query(f"WITH {DOC_REPORTS}, s AS (SELECT root FROM rd WHERE bug_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY root HAVING count(*) > 1) SELECT root FROM s")
def sets_less_blacklist(spark, sf_dir):
    black = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("bug_id"))
    return doc_reports(spark, sf_dir).join(black, "bug_id", "left_anti").groupBy("root").count().filter("count > 1").select("root")


@query(f"WITH {EVENT_REPORTS} SELECT bug_id AS bug1, dup_id AS bug2 FROM re WHERE dup_id IS NOT NULL AND NOT (bug_id NOT IN (SELECT bug_id FROM re WHERE severity < 3) AND dup_id NOT IN (SELECT bug_id FROM re WHERE severity < 3))")
def pairs_touching_main(spark, sf_dir):
    r = event_reports(spark, sf_dir)
    main = r.filter("severity < 3").select(F.col("bug_id").alias("m"))
    p = r.filter("dup_id is not null").select(F.col("bug_id").alias("bug1"), F.col("dup_id").alias("bug2"))
    one = p.join(main, F.col("bug1") == F.col("m"), "left_semi")
    return one.union(p.join(main, F.col("bug2") == F.col("m"), "left_semi")).distinct()


# --- lexicon-like aggregates of columns --------------------------------------------------------------------------------------


@query("SELECT 'event_type' AS field, value, row_number() OVER (ORDER BY value) AS code FROM (SELECT DISTINCT lower(event_type) AS value FROM events) UNION ALL SELECT 'user_id', value, row_number() OVER (ORDER BY value) FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events)")
def categorical_lexicon(spark, sf_dir):
    return features.categorical_values(table(spark, sf_dir, "events"), ["event_type", "user_id"]).select("field", "value", F.col("code").cast("long").alias("code"))


@query(f"WITH {EVENT_REPORTS} SELECT 'product' AS level, lower(product) AS key, bug_id FROM re UNION ALL SELECT 'component', lower(product) || '|' || component, bug_id FROM re")
def inverted_lists(spark, sf_dir):
    return features.inverted_lists(event_reports(spark, sf_dir)).select("level", "key", "bug_id")


@query(f"WITH {ORDER_REPORTS} SELECT bug_id, dense_rank() OVER (ORDER BY priority) - 1 AS code FROM ro")
def sorted_codes(spark, sf_dir):
    return features.sorted_codes(order_reports(spark, sf_dir), "priority", "code").select("bug_id", F.col("code").cast("long").alias("code"))


@query(f"""WITH {EVENT_REPORTS}, tr AS (SELECT * FROM re WHERE bug_id % 3 > 0), p AS (SELECT v, row_number() OVER (ORDER BY v) AS code FROM (SELECT DISTINCT lower(product) AS v FROM tr WHERE product <> 'click')), c AS (SELECT v, row_number() OVER (ORDER BY v) AS code FROM (SELECT DISTINCT CAST(component AS VARCHAR) AS v FROM tr)),
  y AS (SELECT v, row_number() OVER (ORDER BY v) AS code FROM (SELECT DISTINCT CAST(priority AS VARCHAR) AS v FROM tr))
  SELECT bug_id, coalesce(p.code, 0) AS product, coalesce(c.code, 0) AS component, coalesce(y.code, 0) AS priority, day FROM re LEFT JOIN p ON p.v = lower(product) LEFT JOIN c ON c.v = CAST(component AS VARCHAR) LEFT JOIN y ON y.v = CAST(priority AS VARCHAR)""")
def categorical_encode(spark, sf_dir):
    """Codes of a lexicon fitted on two thirds of the reports, without one of the products, which is then unknown (0)."""
    r = event_reports(spark, sf_dir)
    fields = ["product", "component", "priority"]
    seen = r.filter("bug_id % 3 > 0").withColumn("product", F.when(F.col("product") != "click", F.col("product")))
    return features.encode_categories(r, features.categorical_values(seen, fields), fields).select("bug_id", *fields, "day")


@query("SELECT event_type AS token, CAST(min(event_id) AS BIGINT) AS first_seen, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS token_id FROM events GROUP BY event_type")
def first_seen_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("token"), F.col("event_id").alias("ordinal"))
    firsts = e.groupBy("token").agg(F.min("ordinal").alias("first_seen"))
    return features.lexicon(e).join(firsts, "token").select("token", "first_seen", "token_id")
