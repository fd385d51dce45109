"""The star-schema and text tables seen as report tables, on Spark and as SQL text of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports: each repeats the event before it of its user and type, so that chains arise."""
    e = table(spark, sf_dir, "events")
    chain = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("bug_id"),
        F.lag("event_id").over(chain).alias("dup_id"),
        F.first("event_id").over(chain).alias("root"),
        F.col("ts").alias("creation_ts"),
        F.col("event_type").alias("product"),
        (F.col("user_id") % 10).alias("component"),
        (F.floor(F.abs("value")).cast("long") % 5).alias("severity"),
        (F.floor(F.abs("value")).cast("long") % 7).alias("priority"),
        (F.col("user_id") % 4).alias("version"),
        F.floor(F.unix_timestamp("ts") / 86400).cast("long").alias("day"),
    )


EVENT_REPORTS = """re AS (SELECT event_id AS bug_id, lag(event_id) OVER w AS dup_id, first_value(event_id) OVER w AS root, ts AS creation_ts,
  event_type AS product, user_id % 10 AS component, CAST(floor(abs(value)) AS BIGINT) % 5 AS severity, CAST(floor(abs(value)) AS BIGINT) % 7 AS priority,
  user_id % 4 AS version, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def doc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text reports: first line and rest; an exact copy repeats the first document of its text."""
    d = table(spark, sf_dir, "documents").withColumn("_text", F.coalesce(F.sha2("text", 256), F.lit("")))
    # only texts that stand twice are looked up, by digest: their first ids are partial minima, and no text is sorted
    copies = d.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    d = d.join(copies, "_text", "left")
    first = F.coalesce("_first", "doc_id")
    cut = F.instr("text", "\n")
    return d.select(
        F.col("doc_id").alias("bug_id"),
        F.when(first < F.col("doc_id"), first).alias("dup_id"),
        first.alias("root"),
        F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("short_desc"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("description"),
        F.col("source").alias("product"),
        F.col("lang").alias("component"),
        "text",
        "n_chars",
    )


DOC_REPORTS = """rd AS (SELECT doc_id AS bug_id, CASE WHEN f < doc_id THEN f END AS dup_id, f AS root,
  CASE WHEN cut > 0 THEN text[1:cut - 1] ELSE text END AS short_desc, CASE WHEN cut > 0 THEN text[cut + 1:] ELSE '' END AS description,
  source AS product, lang AS component, text, n_chars
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS f, instr(text, chr(10)) AS cut FROM documents))"""

#: SQL of functions.text.tokens_alnum(lower(x)).
TOKENS_SQL = r"list_filter(string_split(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g'), ' '), lambda t: t <> '')"


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports with many equal times; a customer's orders are one set."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("bug_id"), F.col("o_orderdate").alias("creation_ts"), F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


ORDER_REPORTS = "ro AS (SELECT o_orderkey AS bug_id, o_orderdate AS creation_ts, o_custkey AS set_id, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"


def turn_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as text reports: the first sentence and the rest; a conversation is one set, and version
    numbers rise with the conversations."""
    t = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    text = F.coalesce("text", F.lit(""))
    cut = F.instr(text, ".")
    return t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("bug_id"),
        F.col("conv_id").alias("root"),
        F.when(cut > 0, F.substring(text, F.lit(1), cut)).otherwise(text).alias("short_desc"),
        F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise("").alias("description"),
        F.col("role").alias("product"),
        (F.length(text).cast("long") % 4).alias("component"),
        (F.col("turn") % 2).alias("severity"),
        F.floor(F.col("conv_id") / 4).cast("long").alias("version"),
        F.col("turn").alias("priority"),
    )


TURN_REPORTS = """rt AS (SELECT conv_id * 100 + turn AS bug_id, conv_id AS root, CASE WHEN cut > 0 THEN text[1:cut] ELSE text END AS short_desc, CASE WHEN cut > 0 THEN text[cut + 1:] ELSE '' END AS description,
  role AS product, length(text) % 4 AS component, turn % 2 AS severity, CAST(floor(conv_id / 4) AS BIGINT) AS version, turn AS priority
  FROM (SELECT *, instr(text, '.') AS cut FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)))"""
