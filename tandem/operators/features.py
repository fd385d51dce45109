"""Term features: postings, document frequencies, lengths, TF-IDF, lexicons, inverted lists, codes.

A postings table has a row for each (bug_id, field, n, token) with ``tf``; fields are ``sum`` and ``desc``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import placed


def postings(reports: DataFrame, tokenize=tx.dbrd_tokens, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Term frequencies of n-grams of each field; an empty field has the one token ``#EMPTY``.

    The texts are dealt by report before they become rows, so the postings, many times the texts, are not shuffled to be counted, nor
    by what else is grouped within a report. The number of parts is named, since few bytes of text are many rows for a task."""
    many = int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = reports.select("bug_id", "short_desc", "description").repartition(many, "bug_id").select(
        "bug_id",
        F.explode(F.create_map(F.lit("sum"), tx.or_empty_token(tokenize(F.coalesce("short_desc", F.lit("")))), F.lit("desc"), tx.or_empty_token(tokenize(F.coalesce("description", F.lit("")))))).alias("field", "tokens"),
    )

    def sized(n: int) -> Column:
        return F.transform(tx.ngrams(F.col("tokens"), n), lambda t: F.struct(F.lit(n).alias("n"), t.alias("token")))

    grams = F.flatten(F.array(*[sized(n) for n in sizes]))
    flat = parts.select("bug_id", "field", F.inline(grams))
    return flat.groupBy("bug_id", "field", "n", "token").agg(F.count(F.lit(1)).alias("tf"))


def relative_tf(post: DataFrame) -> DataFrame:
    w = Window.partitionBy("bug_id", "field", "n")
    return post.withColumn("rtf", F.col("tf") / F.sum("tf").over(w))


def doc_freq_of(reports: DataFrame, tokenize: Callable[[Column], Column], sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(n, token, df) straight from the reports: a report's distinct tokens are taken before they become rows, so
    only partial counts are shuffled."""
    fields = [tx.or_empty_token(tokenize(F.coalesce(c, F.lit("")))) for c in ("short_desc", "description")]
    both = reports.select(F.array(*fields).alias("fields"))

    def grams(n: int) -> Column:
        each = F.flatten(F.transform("fields", lambda t: tx.ngrams(t, n)))
        return F.transform(F.array_distinct(each), lambda t: F.struct(F.lit(n).alias("n"), t.alias("token")))

    every = both.select(F.inline(F.flatten(F.array(*[grams(n) for n in sizes]))))
    return every.groupBy("n", "token").agg(F.count(F.lit(1)).alias("df"))


def doc_freq(post: DataFrame) -> DataFrame:
    """(n, token, df) over both fields: a report counts once for a token."""
    return post.groupBy("n", "token", "bug_id").agg(F.lit(1).alias("_")).groupBy("n", "token").agg(F.count(F.lit(1)).alias("df"))


def idf_log2(df: DataFrame, n_docs: int) -> DataFrame:
    return df.withColumn("idf", F.log2(F.lit(float(n_docs)) / F.col("df")))


def field_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("bug_id", "field", "n").agg(F.sum("tf").alias("len"))


def average_lengths(post: DataFrame) -> DataFrame:
    return field_lengths(post).groupBy("field", "n").agg(F.avg("len").alias("avg_len"))


def fit_tfidf(tf: DataFrame, max_features: int | None = None) -> DataFrame:
    """(token, df) of the tokens, or of the most frequent ones; ``tf`` has bug_id, token, tf."""
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if max_features:
        df = df.orderBy(F.desc("total"), "token").limit(max_features)
    return df.select("token", "df")


def transform_tfidf(tf: DataFrame, fitted: DataFrame, n_docs: int, binary: bool = False) -> DataFrame:
    """(bug_id, token, w): smoothed TF-IDF of unit length over fitted tokens; ``binary`` counts a token once."""
    weight = (F.lit(1.0) if binary else F.col("tf")) * (F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)
    raw = tf.join(fitted, "token").select("bug_id", "token", weight.alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("bug_id"))))


def tfidf(tf: DataFrame, n_docs: int, binary: bool = False, max_features: int | None = None) -> DataFrame:
    return transform_tfidf(tf, fit_tfidf(tf, max_features), n_docs, binary)


def vocabulary(post: DataFrame, least: int = 2) -> DataFrame:
    """(token, cnt) of tokens that stand ``least`` times or more."""
    return post.groupBy("token").agg(F.sum("tf").alias("cnt")).filter(F.col("cnt") >= least)


def prune_lexicon(counts: DataFrame, least: int) -> DataFrame:
    """(token, cnt): kept tokens, and ``#UNK`` with the pruned mass."""
    unk = F.when(F.col("cnt") < least, "#UNK").otherwise(F.col("token"))
    return counts.groupBy(unk.alias("token")).agg(F.sum("cnt").alias("cnt"))


def lexicon(tokens: DataFrame) -> DataFrame:
    """(token, token_id, cnt) in order of first sight; ``tokens`` has token and ordinal.

    Places are counted in ranges of the ordinal first, so no task orders the whole vocabulary."""
    firsts = tokens.groupBy("token").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("cnt"))
    ranged = firsts.withColumn("_r", F.floor(F.col("first") / 4096))
    sizes = ranged.groupBy("_r").count()
    before = sizes.select("_r", (F.sum("count").over(Window.orderBy("_r")) - F.col("count")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("first", "token")) - 1 + F.col("_b")
    return ranged.join(before, "_r").select("token", place.cast("long").alias("token_id"), "cnt")


def encode(tokens: DataFrame, lex: DataFrame, unknown: int) -> DataFrame:
    """Adds token_id, that of the unknown symbol where the lexicon lacks the token."""
    return tokens.join(lex.select("token", "token_id"), "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(unknown).cast("long")))


def categorical_values(reports: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, code): distinct lower-cased values of each field; code 0 is left to the unknown value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("value")) for f in fields])
    values = reports.select(F.inline(pairs)).filter("value is not null").distinct()
    return values.withColumn("code", F.row_number().over(Window.partitionBy("field").orderBy("value")))


def encode_categories(reports: DataFrame, lex: DataFrame, fields: list[str]) -> DataFrame:
    """The fields' codes in place of their values, 0 for values that the lexicon (field, value, code) lacks."""
    out = reports
    for f in fields:
        own = lex.filter(F.col("field") == f).select(F.col("value").alias("_value"), F.col("code").cast("long").alias("_code"))
        out = out.join(own, F.lower(F.col(f).cast("string")) == F.col("_value"), "left").withColumn(f, F.coalesce("_code", F.lit(0).cast("long"))).drop("_value", "_code")
    return out


def sorted_codes(df: DataFrame, col: str, name: str) -> DataFrame:
    """Place of each value among the sorted distinct values, from 0; the distinct values are ranked, not the rows."""
    return df.join(placed(df.select(col).distinct(), [col], name), col)


def inverted_lists(reports: DataFrame) -> DataFrame:
    """(level, key, bug_id): reports by product, and by product and component, lower-cased."""
    product = F.lower("product")
    both = F.concat_ws("|", product, F.lower(F.col("component").cast("string")))
    return reports.select("bug_id", F.inline(F.array(F.struct(F.lit("product").alias("level"), product.alias("key")), F.struct(F.lit("component").alias("level"), both.alias("key")))))


def token_sets(reports: DataFrame, tokenize: Column) -> DataFrame:
    return reports.select("bug_id", F.explode(F.array_distinct(tokenize)).alias("token"))
