"""Sentences with abbreviations that are learned from the texts themselves.

A word type (lower-cased, without its last dot) is an abbreviation if it stands before a dot far more often than words do by
chance. Following the published likelihood ratio for such types, with a the type's number, d its number before a dot, and p the share of dots among all
words: 2 (log L(0.99) - log L(p)), L(x) = x^d (1 - x)^(a - d), times e^-n for the n characters that are no dots, times one more than the
dots inside, times n^-(a - d). A type is taken from LEAST on. Counts are partial aggregates over all texts.

A text is cut behind . ! or ? and white space before a capital or a digit; a cut behind the dot of an abbreviation is taken
back. Null texts have no sentence, empty ones one empty sentence; (id) is distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 0.3
#: White space of the word and sentence rules.
BLANK = r"[ \t\n\x0B\f\r]+"


def abbreviation_table(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(type, n, n_dot, score) of the abbreviations of ``texts`` (text)."""
    words = texts.select(F.explode(F.split(F.lower("text"), BLANK)).alias("word")).filter("word <> ''")
    dot = F.col("word").endswith(".")
    typed = words.select(F.when(dot, F.expr("left(word, length(word) - 1)")).otherwise(F.col("word")).alias("type"), dot.cast("long").alias("dot"))
    counts = typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("dot").alias("n_dot"))
    total = counts.agg(F.sum("n").alias("_all"), F.sum("n_dot").alias("_dots"))
    met = counts.filter(F.col("n_dot") > 0).filter(F.col("type").rlike(r"^[\p{L}.]*\p{L}$")).crossJoin(F.broadcast(total))  # one row
    bare = F.col("n") - F.col("n_dot")
    size = F.length(F.regexp_replace("type", r"\.", ""))
    share = F.col("_dots") / F.col("_all")

    def log_chance(x: Column) -> Column:
        return F.col("n_dot") * F.log(x) + F.when(bare > 0, bare * F.log(1 - x)).otherwise(0.0)

    ratio = 2 * (log_chance(F.lit(0.99)) - log_chance(share))
    score = ratio * F.exp(-size) * (F.length("type") - size + 1) * F.pow(size.cast("double"), -bare.cast("double"))
    return met.filter(share < 1).withColumn("score", score).filter(F.col("score") >= least).select("type", "n", "n_dot", "score")


def split_sentences(texts: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(id, sentences) of ``texts`` (id, text); ``abbreviations`` has the types."""
    marked = F.regexp_replace("text", rf"(?<=[.!?])({BLANK})(?=[\p{{Lu}}\p{{N}}])", "$1\u0001")
    parts = texts.filter("text is not null").select("id", F.posexplode(F.split(marked, "\u0001")).alias("i", "part"))
    # the last word, looked for at starts of words only, so that a long one is not met again from each of its characters
    last = F.lower(F.regexp_extract("part", r"(?<![^ \t\n\x0B\f\r])([^ \t\n\x0B\f\r]*)\.[ \t\n\x0B\f\r]*\z", 1))
    held = parts.withColumn("type", last).join(abbreviations.select("type", F.lit(True).alias("short")), "type", "left")
    order = Window.partitionBy("id").orderBy("i")  # the parts of one text
    opens = F.coalesce(F.lag("short").over(order), F.lit(False))
    numbered = held.withColumn("opens", (~opens).cast("int")).withColumn("no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # joined by sentence, then by text: both stay where the window has dealt the text
    lines = numbered.groupBy("id", "no").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("p"))
    joined = lines.select("id", F.struct("no", F.array_join(F.col("p.part"), "").alias("s")).alias("line"))
    lists = joined.groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("l"))
    return lists.select("id", F.transform("l", lambda x, i: F.when(i < F.size("l") - 1, F.regexp_replace(x["s"], BLANK + r"\z", "")).otherwise(x["s"])).alias("sentences"))
