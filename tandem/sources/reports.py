"""Readers and writers of report files and of the files that tools around them use."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import placed

#: Raw report fields (JSON lines); a list instead of a text means empty.
REPORT_FIELDS = (
    "bug_id", "dup_id", "short_desc", "description", "product", "component", "version", "bug_severity", "priority",
    "bug_status", "resolution", "creation_ts", "original_bug_id",
)
REPORT_SCHEMA = ", ".join(f"{f} STRING" for f in REPORT_FIELDS)
#: Statuses of reports that are still open.
OPEN_STATUSES = ("UNCONFIRMED", "NEW", "ASSIGNED", "REOPENED", "READY")
TS_FORMAT = "yyyy-MM-dd HH:mm:ss Z"


def parse_ts(ts: Column, naive: bool = False) -> Column:
    """A timestamp with zone offset; ``naive`` ignores the offset."""
    if naive:
        return F.to_timestamp(F.substring(ts, 1, 19), "yyyy-MM-dd HH:mm:ss")
    return F.to_timestamp(ts, TS_FORMAT)


def day_number(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 86400).cast("long")


def normalise_reports(raw: DataFrame, naive: bool = False) -> DataFrame:
    """Text ids beside numeric ones, lists and blanks as empty texts, no dup_id as null, a parsed time."""

    def text(c: str) -> Column:
        return F.when(F.col(c).isNull() | F.col(c).rlike(r"^\s*\[.*\]\s*$"), "").otherwise(F.col(c))

    fixed = {c: text(c) for c in ("short_desc", "description")}
    dup = F.regexp_extract(F.coalesce(F.col("dup_id"), F.lit("")), r"^\D*(\d+)\D*$", 1)
    fixed |= {"dup_id": F.when(dup != "", dup), "creation_ts": parse_ts(F.col("creation_ts"), naive), "bug_id_num": F.col("bug_id").cast("long")}
    return raw.withColumns(fixed)


def read_reports(spark: SparkSession, path: str, naive: bool = False) -> DataFrame:
    """JSON lines, blank lines skipped; ``ordinal`` is the order in the files."""
    raw = spark.read.schema(REPORT_SCHEMA).json(path).filter("bug_id is not null")
    return normalise_reports(raw, naive).withColumn("ordinal", F.monotonically_increasing_id())


def write_reports(df: DataFrame, path: str) -> None:
    df.select(*[c for c in REPORT_FIELDS if c in df.columns]).write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(bug_id, position, is_duplicate) of a three-line split file: info, ids, duplicate ids."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l"))
    ids = lines.select(F.posexplode(F.filter(F.split(F.get("l", F.lit(1)), " "), lambda x: x != "")).alias("position", "bug_id"))
    dups = lines.select(F.explode(F.filter(F.split(F.coalesce(F.get("l", F.lit(2)), F.lit("")), " "), lambda x: x != "")).alias("_d")).distinct()
    return ids.join(dups, F.col("bug_id") == F.col("_d"), "left").select("bug_id", "position", F.col("_d").isNotNull().alias("is_duplicate"))


def write_split(df: DataFrame, path: str, info: str) -> None:
    """The three-line file; it is one line of ids by format, so one task writes it."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "bug_id"))), lambda r: r["bug_id"])
    dups = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_duplicate"), F.struct("position", "bug_id")))), lambda r: r["bug_id"])
    df.agg(F.concat_ws("\n", F.lit(info), F.array_join(ordered, " "), F.array_join(dups, " ")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bug1 STRING, bug2 STRING, label INT").csv(path)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("anchor STRING, pos STRING, neg STRING").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def load_pairs(pairs: DataFrame, ignore_non_duplicates: bool = False, drop_repeats: bool = False) -> DataFrame:
    """Checked pairs: labels are 1 or -1; repeats of an unordered pair go if asked."""
    good = F.when(F.col("label").isin(1, -1), F.col("label")).otherwise(F.raise_error(F.lit("a label is neither 1 nor -1")).cast("int"))
    out = pairs.withColumn("label", good)
    if ignore_non_duplicates:
        out = out.filter("label = 1")
    if drop_repeats:
        out = out.withColumn("_k", F.concat_ws("|", F.least("bug1", "bug2"), F.greatest("bug1", "bug2"))).dropDuplicates(["_k"]).drop("_k")
    return out


def read_pairs_with_footer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pair lines and, behind a blank line, one JSON object with ``validations``: (pairs, validations)."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\n\s*\n", 2).alias("p"))
    lines = whole.select(F.explode(F.split(F.get("p", F.lit(0)), "\n")).alias("l")).filter("trim(l) <> ''").select(F.split("l", ",").alias("c"))
    pairs = lines.select(F.get("c", F.lit(0)).alias("bug1"), F.get("c", F.lit(1)).alias("bug2"), F.trim(F.get("c", F.lit(2))).cast("int").alias("label"))
    foot = F.from_json(F.get("p", F.lit(1)), "validations ARRAY<STRUCT<k: DOUBLE, indexes: ARRAY<BIGINT>>>")
    return pairs, whole.select(F.inline(foot["validations"]))


def members_of_pairs(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports that a pair names, each once."""
    ids = pairs.select(F.col("bug1").alias("bug_id")).union(pairs.select("bug2")).distinct()
    return reports.join(ids, "bug_id", "left_semi").dropDuplicates(["bug_id"])


# --- key=value blocks of term frequencies -------------------------------------------------------------------------

#: Order of the lines of a block.
BLOCK_FIELDS = ("S-U", "S-B", "S-T", "D-U", "D-B", "D-T", "A-U", "A-B", "A-T")
BLOCK_CODES = ("VERSION", "COMPONENT", "SUB-COMPONENT", "TYPE", "PRIORITY")


def tf_text(pairs: Column) -> Column:
    """``id:tf,id:tf`` in id order from an array of (token_id, tf)."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws(":", p["token_id"].cast("string"), p["tf"].cast("string"))), ",")


def block_lines(blocks: DataFrame) -> DataFrame:
    """(bug_id, value): the text block of each report; columns are the fields as arrays, the codes and DID."""
    fields = [F.concat(F.lit(f"{f}="), tf_text(F.col(f"`{f}`"))) for f in BLOCK_FIELDS]
    codes = [F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in BLOCK_CODES]
    did = F.concat(F.lit("DID="), F.coalesce(F.col("DID").cast("string"), F.lit("")))
    return blocks.select("bug_id", F.concat_ws("\n", F.concat(F.lit("ID="), F.col("bug_id").cast("string")), *fields, did, *codes).alias("value"))


def read_blocks(spark: SparkSession, path: str, max_bug_id: int) -> DataFrame:
    """(bug_id, field, value) of every block with an id up to the given one."""
    blocks = spark.read.text(path, lineSep="\nID=").select(F.regexp_replace("value", "^ID=", "").alias("b"))
    head = F.split("b", "\n", 2)
    lines = blocks.select(F.trim(head[0]).cast("long").alias("bug_id"), F.explode(F.split(head[1], "\n")).alias("l")).filter(F.col("bug_id") <= max_bug_id)
    part = F.split("l", "=", 2)
    return lines.filter("l <> ''").select("bug_id", part[0].alias("field"), F.trim(part[1]).alias("value"))


def block_postings(blocks: DataFrame) -> DataFrame:
    """(bug_id, field, token_id, tf) of the term lines."""
    terms = blocks.filter(F.col("field").isin(*BLOCK_FIELDS) & (F.col("value") != "")).select("bug_id", "field", F.explode(F.split("value", ",")).alias("t"))
    return terms.select("bug_id", "field", F.split("t", ":")[0].cast("int").alias("token_id"), F.split("t", ":")[1].cast("int").alias("tf"))


def read_weights(text: str) -> list[tuple[str, str, float]]:
    """(section, label, number) of ``[label, ...] = number`` lines; a bracketed line without a number begins a section."""
    section, out = "", []
    for line in text.splitlines():
        head, closed, rest = line.strip().removeprefix("[").partition("]")
        if not closed or not line.strip().startswith("["):
            continue
        number = re.fullmatch(r"\s*=\s*(-?\d+(?:\.\d*)?)\s*", rest)
        if number:
            out.append((section, head.split(",")[0].strip(), float(number[1])))
        else:
            section = head.strip()
    return out


def timestamp_lines(reports: DataFrame) -> DataFrame:
    """``id=day`` lines in id order."""
    return reports.select("bug_id", F.concat_ws("=", F.col("bug_id").cast("string"), day_number(F.col("creation_ts")).cast("string")).alias("value")).orderBy("bug_id")


# --- rankings -----------------------------------------------------------------------------------------------------


def ranking_lines(ranked: DataFrame) -> DataFrame:
    """``anchor cand|score cand|score`` lines, scores rounded to 3."""
    each = F.struct("rank", F.concat_ws("|", F.col("cand").cast("string"), F.round("score", 3).cast("string")).alias("t"))
    row = F.transform(F.array_sort(F.collect_list(each)), lambda r: r["t"])
    return ranked.groupBy("anchor").agg(F.concat_ws(" ", F.col("anchor").cast("string"), F.array_join(row, " ")).alias("value"))


def read_ranking_json(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, bug, pos, score) of ``{id, pos: [[bug, pos, score]]}`` lines."""
    raw = spark.read.schema("id STRING, pos ARRAY<ARRAY<STRING>>").json(path)
    e = raw.select(F.col("id").alias("anchor"), F.explode("pos").alias("p"))
    return e.select("anchor", F.col("p")[0].alias("bug"), F.col("p")[1].cast("int").alias("pos"), F.col("p")[2].cast("double").alias("score"))


# --- vectors and lexicons -------------------------------------------------------------------------------------------


def read_vectors(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """(word, vec) of a text file of vectors; a first line of two numbers is a header."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).filter((F.size("p") > 2))
    out = parts.select(F.get("p", F.lit(0)).alias("word"), F.transform(F.slice("p", 2, 1 << 20), lambda x: x.cast("double")).alias("vec"))
    if dims:
        out = out.withColumn("vec", F.when(F.size("vec") == dims, F.col("vec")).otherwise(F.raise_error(F.lit("a vector of another size")).cast("array<double>")))
    return out


def merge_vectors(main: DataFrame, aux: DataFrame, key: str = "word") -> DataFrame:
    """All of main, and of aux what main lacks."""
    return main.unionByName(aux.join(main.select(key), key, "left_anti").select(*main.columns))


def vocabulary_vectors(vectors: DataFrame, vocabulary: DataFrame, dims: int, specials: tuple[str, ...] = ("</s>", "#UNK")) -> DataFrame:
    """Vectors of the vocabulary, and zero vectors of the special words that have none."""
    kept = vectors.join(vocabulary.select("word").distinct(), "word", "left_semi")
    rows = vectors.sparkSession.createDataFrame([(s,) for s in specials], "word string").withColumn("vec", F.array_repeat(F.lit(0.0), dims))
    return merge_vectors(kept, rows)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id): one token a line, its line number is its id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("token_id", "token"))
    return lines.select("token", F.col("token_id").cast("long"))


def write_lexicon(lex: DataFrame, path: str) -> None:
    lex.orderBy("token_id").select(F.col("token").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_categorical(spark: SparkSession, path: str) -> DataFrame:
    """(field, value, code) of a JSON object of field to values, the unknown value first."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("field", "values")).select("field", F.posexplode("values").alias("code", "value"))


# --- experiment documents ------------------------------------------------------------------------------------------


def changed_since(spark: SparkSession, path: str, schema: str, watermark: str) -> DataFrame:
    """JSON documents of files that changed after the watermark."""
    docs = spark.read.schema(schema).json(path)
    return docs.select("*", F.col("_metadata.file_modification_time").alias("changed")).filter(F.col("changed") > F.lit(watermark).cast("timestamp"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.select(*stored.columns).unionByName(stored.join(new.select(key), key, "left_anti"))


def best_runs(runs: DataFrame, metrics: DataFrame, metric_pattern: str, params: list[str], n: int = 50) -> DataFrame:
    """The n runs with the highest value of a matching metric, with some parameters of their config (JSON text)."""
    best = metrics.filter(F.col("name").rlike(metric_pattern)).groupBy("run_id", "name").agg(F.max(F.array_max("values")).alias("best"))
    shown = [F.get_json_object("config", f"$.{p}").alias(p.replace(".", "_")) for p in params]
    return runs.join(best, "run_id").select("run_id", "name", "best", *shown).orderBy(F.desc("best"), "run_id").limit(n)


def id_order(df: DataFrame, key: str = "bug_id") -> DataFrame:
    """Rows with a dense place by id, for files whose line order is meant."""
    return placed(df, [key], "place")


# --- logs ----------------------------------------------------------------------------------------------------------


def log_record(level: Column, message: Column, fields: dict[str, Column]) -> Column:
    """One JSON log line."""
    return F.to_json(F.struct(level.alias("level"), message.alias("message"), *[c.alias(k) for k, c in fields.items()]))
