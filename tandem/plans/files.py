"""Queries of the file formats: each writes its whole table in the format to the shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.draws import draw_sql
from ..operators import encoding
from ..sources import reports as rp
from ..sources.shared import placed, shared_path
from ..sources.views import DOC_REPORTS, EVENT_REPORTS, TOKENS_SQL, doc_reports, event_reports, table
from .drawn import PAIRS
from .registry import query
from .textual import aggressive_sql


def _raw_reports(spark, sf_dir):
    """Document reports in the raw fields; every third description is a list in brackets."""
    d = doc_reports(spark, sf_dir)
    text = F.when(F.col("bug_id") % 3 == 0, F.concat(F.lit("[\""), F.lit("a"), F.lit("\"]"))).otherwise(F.col("description"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("bug_id") * 3600), "yyyy-MM-dd HH:mm:ss")
    return d.select(F.col("bug_id").cast("string").alias("bug_id"), F.col("dup_id").cast("string").alias("dup_id"), "short_desc", text.alias("description"), "product", "component", F.concat(stamp, F.lit(" +0000")).alias("creation_ts"))


@query(f"WITH {DOC_REPORTS} SELECT bug_id, dup_id, md5(short_desc) AS summary_md5, md5(CASE WHEN bug_id % 3 = 0 THEN '' WHEN regexp_matches(description, '^\\s*\\[.*\\]\\s*$') THEN '' ELSE description END) AS description_md5, product, CAST(floor((1704067200 + bug_id * 3600) / 86400) AS BIGINT) AS day FROM rd")
def reports_json(spark, sf_dir):
    """JSON lines written, read, with lists emptied and times parsed."""
    path = shared_path(spark, "reports")
    rp.write_reports(_raw_reports(spark, sf_dir), path)
    r = rp.read_reports(spark, path)
    return r.select(F.col("bug_id_num").alias("bug_id"), F.col("dup_id").cast("long").alias("dup_id"), F.md5("short_desc").alias("summary_md5"), F.md5("description").alias("description_md5"), "product", rp.day_number(F.col("creation_ts")).alias("day"))


@query(f"WITH {DOC_REPORTS} SELECT CAST(bug_id AS VARCHAR) AS bug_id, row_number() OVER (ORDER BY bug_id) - 1 AS position, dup_id IS NOT NULL AS is_duplicate FROM rd")
def split_file(spark, sf_dir):
    """The format is one line of all ids, so one task writes and reads it."""
    path = shared_path(spark, "split")
    d = doc_reports(spark, sf_dir).select("bug_id", "dup_id")
    ordered = rp.id_order(d).select(F.col("bug_id").cast("string").alias("bug_id"), F.col("place").alias("position"), F.col("dup_id").isNotNull().alias("is_duplicate"))
    rp.write_split(ordered, path, "all documents")
    return rp.read_split(spark, path).select("bug_id", F.col("position").cast("long").alias("position"), "is_duplicate")


def _pairs(spark, sf_dir):
    d = doc_reports(spark, sf_dir).filter("dup_id is not null")
    both = F.array(F.struct(F.col("bug_id").alias("bug1"), F.col("root").alias("bug2")), F.struct(F.col("root").alias("bug1"), F.col("bug_id").alias("bug2")))
    label = F.when(F.col("bug_id") % 4 == 0, -1).otherwise(1)
    return d.select(F.explode(both).alias("p"), label.alias("label")).select(F.col("p.bug1").cast("string").alias("bug1"), F.col("p.bug2").cast("string").alias("bug2"), "label")


_PAIR_ROWS = f"{DOC_REPORTS}, pr AS (SELECT bug_id AS x, root AS y, CASE WHEN bug_id % 4 = 0 THEN -1 ELSE 1 END AS label FROM rd WHERE dup_id IS NOT NULL), ab AS (SELECT CAST(x AS VARCHAR) AS bug1, CAST(y AS VARCHAR) AS bug2, label FROM pr UNION ALL SELECT CAST(y AS VARCHAR), CAST(x AS VARCHAR), label FROM pr)"


@query(f"WITH {_PAIR_ROWS} SELECT bug1, bug2, label FROM ab")
def pairs_csv(spark, sf_dir):
    path = shared_path(spark, "pairs")
    rp.write_csv(_pairs(spark, sf_dir), path)
    return rp.read_pairs(spark, path)


@query(f"WITH {_PAIR_ROWS} SELECT DISTINCT least(bug1, bug2) AS lo, greatest(bug1, bug2) AS hi FROM ab WHERE label = 1")
def pairs_loaded(spark, sf_dir):
    """Duplicates only, each unordered pair once."""
    kept = rp.load_pairs(_pairs(spark, sf_dir), ignore_non_duplicates=True, drop_repeats=True)
    return kept.select(F.least("bug1", "bug2").alias("lo"), F.greatest("bug1", "bug2").alias("hi"))


@query(f"WITH {_PAIR_ROWS} SELECT CAST(bug_id AS VARCHAR) AS bug_id, n_chars FROM rd WHERE CAST(bug_id AS VARCHAR) IN (SELECT bug1 FROM ab)")
def reports_of_pairs(spark, sf_dir):
    r = doc_reports(spark, sf_dir).select(F.col("bug_id").cast("string").alias("bug_id"), "n_chars")
    return rp.members_of_pairs(_pairs(spark, sf_dir), r)


@query(f"WITH {DOC_REPORTS} SELECT CAST(bug_id AS VARCHAR) AS anchor, CAST(root AS VARCHAR) AS pos, CAST(bug_id + 1 AS VARCHAR) AS neg FROM rd WHERE dup_id IS NOT NULL")
def triplets_csv(spark, sf_dir):
    path = shared_path(spark, "triplets")
    d = doc_reports(spark, sf_dir).filter("dup_id is not null")
    rp.write_csv(d.select(F.col("bug_id").alias("anchor"), F.col("root").alias("pos"), (F.col("bug_id") + 1).alias("neg")), path)
    return rp.read_triplets(spark, path)


@query(f"WITH {_PAIR_ROWS} SELECT bug1, bug2, label, 'pairs' AS kind FROM ab UNION ALL SELECT bug1, bug2, label, 'footer' FROM ab UNION ALL SELECT CAST(k AS VARCHAR), CAST(i AS VARCHAR), 0, 'validation' FROM (VALUES (0.5, 1), (0.5, 2), (1.0, 3)) t(k, i) WHERE i > 0")
def pairs_with_footer(spark, sf_dir):
    """Pair files, and the form with one JSON object behind the pairs (one text by format)."""
    p = _pairs(spark, sf_dir)
    path = shared_path(spark, "footer")
    lines = p.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "bug1", "bug2", F.col("label").cast("string")))), "\n").alias("l"))
    foot = '{"validations": [{"k": 0.5, "indexes": [1, 2]}, {"k": 1.0, "indexes": [3]}]}'
    lines.select(F.concat("l", F.lit("\n\n" + foot)).alias("value")).coalesce(1).write.text(path)
    found, validations = rp.read_pairs_with_footer(spark, path)
    v = validations.select(F.col("k").cast("string").alias("bug1"), F.explode(F.col("indexes").cast("array<string>")).alias("bug2"), F.lit(0).alias("label"), F.lit("validation").alias("kind"))
    return p.withColumn("kind", F.lit("pairs")).unionByName(found.withColumn("kind", F.lit("footer"))).unionByName(v)


@query(f"WITH {EVENT_REPORTS} SELECT bug_id, CAST(bug_id AS VARCHAR) || '=' || CAST(day AS VARCHAR) AS value FROM re")
def timestamp_file(spark, sf_dir):
    return rp.timestamp_lines(event_reports(spark, sf_dir).select("bug_id", "creation_ts"))


def _blocks(spark, sf_dir):
    """Blocks with the letters' counts of each summary as terms."""
    e = event_reports(spark, sf_dir)
    terms = F.array(F.struct(F.col("component").cast("int").alias("token_id"), F.lit(2).alias("tf")), F.struct((F.col("version") + 20).cast("int").alias("token_id"), F.lit(1).alias("tf")))
    empty = F.expr("cast(array() as array<struct<token_id:int,tf:int>>)")
    fields = {f: terms if f.endswith("U") else empty for f in rp.BLOCK_FIELDS}
    return e.select("bug_id", *[c.alias(f) for f, c in fields.items()], F.col("dup_id").alias("DID"), *[F.col("severity").alias(c) for c in rp.BLOCK_CODES])


@query(f"WITH {EVENT_REPORTS}, f AS (SELECT bug_id, unnest(['S-U', 'D-U', 'A-U']) AS field, component, version FROM re WHERE bug_id <= 5000) SELECT bug_id, field, CAST(component AS INTEGER) AS token_id, 2 AS tf FROM f UNION ALL SELECT bug_id, field, CAST(version + 20 AS INTEGER), 1 FROM f")
def term_blocks(spark, sf_dir):
    """Blocks written and read up to an id, which is the reader's own parameter; their postings."""
    path = shared_path(spark, "blocks")
    rp.block_lines(_blocks(spark, sf_dir)).select("value").write.text(path)
    return rp.block_postings(rp.read_blocks(spark, path, 5000))


@query("SELECT * FROM (VALUES ('unigram', 'total weight', 0.9), ('unigram', 'k1', 1.5), ('unigram', 'k3', 0.1), ('bigram', 'k1', 2.0), ('bigram', 'component weight', 2.28)) t(section, label, value)")
def weight_file(spark, sf_dir):
    """A weight file of two sections (its text is the fixture)."""
    text = "[unigram] BM25F Parameter\n[total weight] = 0.9\n[k1, x] = 1.5\n[k3, x] = 0.1\n[bigram] BM25F Parameter\n[k1, x] = 2.0\n[component weight] = 2.28\n"
    return spark.createDataFrame(rp.read_weights(text), "section string, label string, value double")


def _ranked(spark, sf_dir):
    e = event_reports(spark, sf_dir).filter("dup_id is not null")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), (F.col("dup_id") + k).alias("cand"), (1.0 / F.lit(2**k)).alias("score")) for k in (1, 2, 3)])).alias("r")
    return e.select(F.col("bug_id").alias("anchor"), each).select("anchor", "r.*")


@query(f"WITH {EVENT_REPORTS} SELECT bug_id AS anchor, bug_id || ' ' || (dup_id + 1) || '|0.5 ' || (dup_id + 2) || '|0.25 ' || (dup_id + 3) || '|0.125' AS value FROM re WHERE dup_id IS NOT NULL")
def ranking_file(spark, sf_dir):
    return rp.ranking_lines(_ranked(spark, sf_dir))


@query(f"WITH {EVENT_REPORTS} SELECT CAST(bug_id AS VARCHAR) AS anchor, CAST(dup_id + k AS VARCHAR) AS bug, CAST(k AS INTEGER) AS pos, 1.0 / (1 << CAST(k AS INTEGER)) AS score FROM re, range(1, 4) t(k) WHERE dup_id IS NOT NULL")
def ranking_json(spark, sf_dir):
    path = shared_path(spark, "ranking")
    r = _ranked(spark, sf_dir)
    row = F.array(F.col("cand").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"))
    r.groupBy(F.col("anchor").cast("string").alias("id")).agg(F.collect_list(row).alias("pos")).write.json(path)
    return rp.read_ranking_json(spark, path)


@query(f"WITH {EVENT_REPORTS} SELECT bug_id AS anchor, CAST(k AS INTEGER) AS pos, dup_id + k AS cand FROM re, range(1, 4) t(k) WHERE dup_id IS NOT NULL")
def preselect_file(spark, sf_dir):
    """A preselect list as Parquet."""
    path = shared_path(spark, "preselect")
    _ranked(spark, sf_dir).select("anchor", F.col("rank").alias("pos"), "cand").write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {EVENT_REPORTS} SELECT bug_id AS report_id, CAST(k AS INTEGER) AS rank, dup_id + k AS neg_id, 1.0 / (1 << CAST(k AS INTEGER)) AS score FROM re, range(1, 4) t(k) WHERE dup_id IS NOT NULL")
def negative_matrix(spark, sf_dir):
    """A matrix of ranked negatives and scores as Parquet: a row of arrays for each report, read as cells."""
    path = shared_path(spark, "matrix")
    r = _ranked(spark, sf_dir).groupBy(F.col("anchor").alias("report_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "cand", "score"))).alias("row"))
    r.select("report_id", F.transform("row", lambda x: x["cand"]).alias("ids"), F.transform("row", lambda x: x["score"]).alias("scores")).write.parquet(path)
    m = spark.read.parquet(path)
    return m.select("report_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "c")).select("report_id", (F.col("p") + 1).alias("rank"), F.col("c.ids").alias("neg_id"), F.col("c.scores").alias("score"))


@query("SELECT 'w' || vec_id AS word, list_sum(list_transform(embedding, lambda x: CAST(round(round(CAST(x AS DOUBLE), 4) * 10000) AS BIGINT))) / 10000.0::DOUBLE AS total, len(embedding) AS dims FROM embeddings")
def vector_file(spark, sf_dir):
    path = shared_path(spark, "vectors")
    e = table(spark, sf_dir, "embeddings")
    digits = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string")), " ")
    e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), digits).alias("value")).write.text(path)
    v = rp.read_vectors(spark, path)
    parts = F.transform("vec", lambda x: F.round(x * 10000).cast("long"))  # whole numbers, so that the sum has one value in any order
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(10000.0)
    return v.select("word", total.alias("total"), F.size("vec").cast("long").alias("dims"))


_WORDS = f"{DOC_REPORTS}, wd AS (SELECT DISTINCT unnest({TOKENS_SQL.format('text')}) AS word FROM rd)"


@query(f"WITH {_WORDS} SELECT word, length(word) AS total FROM wd WHERE length(word) <= 4 UNION ALL SELECT unnest(['</s>', '#UNK']), 0")
def vocabulary_vectors(spark, sf_dir):
    """Vectors of the corpus' words out of vectors of all words of up to four letters, and the special words."""
    words = doc_reports(spark, sf_dir).select(F.explode(tx.tokens_alnum(F.lower("text"))).alias("word")).distinct()
    vectors = words.filter("length(word) <= 4").select("word", F.array(F.length("word").cast("double"), F.lit(0.0)).alias("vec"))
    out = rp.vocabulary_vectors(vectors, words, 2)
    return out.select("word", F.col("vec")[0].cast("long").alias("total"))


@query(f"WITH {_WORDS} SELECT word, CAST(length(word) AS DOUBLE) AS v0 FROM wd")
def subword_vectors(spark, sf_dir):
    """A vector for every word of the corpus by a model that knows all words (here: the word's length)."""
    words = doc_reports(spark, sf_dir).select(F.explode(tx.tokens_alnum(F.lower("text"))).alias("word"))
    return encoding.subword_vectors(words, lambda w: [float(len(w))]).select("word", F.col("vec")[0].alias("v0"))


@query(f"WITH {_WORDS} SELECT word AS token, row_number() OVER (ORDER BY word) - 1 AS token_id FROM wd")
def lexicon_file(spark, sf_dir):
    """One token a line, its line number is its id: one file by format."""
    path = shared_path(spark, "lexicon")
    words = doc_reports(spark, sf_dir).select(F.explode(tx.tokens_alnum(F.lower("text"))).alias("token")).distinct()
    rp.write_lexicon(placed(words, ["token"], "token_id"), path)
    return rp.read_lexicon(spark, path)


@query(f"WITH {PAIRS} SELECT bug1, bug2, part FROM (SELECT *, CASE WHEN {draw_sql('bug1', 'bug2')} % 2 = 0 THEN 'train' ELSE 'validation' END AS part FROM pp)")
def joined_parts(spark, sf_dir):
    """Training and validation pairs as files, joined by reading both."""
    from ..functions.draws import draw
    from ..operators import pairs

    p = pairs.positive_pairs(doc_reports(spark, sf_dir).select("bug_id", "root"))
    part = F.when(F.pmod(draw("bug1", "bug2"), F.lit(2)) == 0, "train").otherwise("validation")
    path = shared_path(spark, "parts")
    p.select("bug1", "bug2", part.alias("part")).write.partitionBy("part").parquet(path)
    one, two = (spark.read.parquet(f"{path}/part={name}").withColumn("part", F.lit(name)) for name in ("train", "validation"))
    return one.unionByName(two)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality + 10 ELSE quality END AS quality FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)")
def upserted_runs(spark, sf_dir):
    """Documents of files changed since a time replace stored ones of their key."""
    path = shared_path(spark, "runs")
    stored = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    stored.filter("doc_id % 2 = 0").withColumn("quality", F.col("quality") + 10).write.json(path)
    new = rp.changed_since(spark, path, "doc_id long, quality int", "2000-01-01 00:00:00")
    return rp.upsert(stored, new, "doc_id")


@query("WITH b AS (SELECT event_type AS name, user_id AS run_id, max(value) AS best FROM events WHERE event_type LIKE '%c%' GROUP BY 1, 2) SELECT run_id, name, best, CAST(run_id % 7 AS VARCHAR) AS net_size FROM b ORDER BY best DESC, run_id LIMIT 50")
def best_runs(spark, sf_dir):
    """The fifty best runs: the limit is the report's."""
    e = table(spark, sf_dir, "events")
    metrics = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("name")).agg(F.collect_list("value").alias("values"))
    runs = e.select(F.col("user_id").alias("run_id")).distinct().withColumn("config", F.format_string('{"net": {"size": %d}}', F.col("run_id") % 7))
    return rp.best_runs(runs, metrics, "c", ["net.size"])


@query("SELECT conv_id, turn, '{\"level\":\"INFO\",\"message\":\"' || role || '\",\"turn\":' || turn || '}' AS line FROM conversations")
def log_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rp.log_record(F.lit("INFO"), F.col("role"), {"turn": F.col("turn")}).alias("line"))


@query(f"WITH {DOC_REPORTS} SELECT bug_id, md5(regexp_replace(short_desc, '[^\\pL\\pN]+', '_', 'g')) AS text_md5 FROM rd")
def non_alnum_symbol(spark, sf_dir):
    return doc_reports(spark, sf_dir).select("bug_id", F.md5(tx.non_alnum(F.col("short_desc"), "_")).alias("text_md5"))


@query(f"WITH {DOC_REPORTS}, t AS (SELECT bug_id, 'S' AS field, {TOKENS_SQL.format('short_desc')} AS w FROM rd UNION ALL SELECT bug_id, 'D', {TOKENS_SQL.format('description')} FROM rd) SELECT bug_id, field, len(w) AS n, len(list_distinct(w)) AS n_distinct FROM t")
def bag_sizes(spark, sf_dir):
    """Tokens and distinct tokens of each field."""
    d = doc_reports(spark, sf_dir)
    parts = [d.select("bug_id", F.lit(f).alias("field"), tx.tokens_alnum(F.lower(c)).alias("w")) for f, c in (("S", "short_desc"), ("D", "description"))]
    return parts[0].unionByName(parts[1]).select("bug_id", "field", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


_CLEANED = f"SELECT '{{0}}' AS field, count(*) AS n, count(*) FILTER (WHERE trim(coalesce({aggressive_sql('{0}')}, '')) = '' AND trim({{0}}) <> '') AS n_erased FROM rd"


@query(f"WITH {DOC_REPORTS} " + " UNION ALL ".join(_CLEANED.replace("{0}", f) for f in ("short_desc", "description")))
def clean_counts(spark, sf_dir):
    """The clean job over two fields by the aggressive cleaner, with the number of fields that it leaves empty."""
    return tx.erased_counts(doc_reports(spark, sf_dir), dict.fromkeys(("short_desc", "description"), tx.cleaner("agg")))
